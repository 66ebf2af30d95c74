"""URL filters: host-suffix and path-prefix expressions, joined to rules on a short hash prefix.

Each url becomes a few expressions `host-suffix + path-prefix`.  Only the pairs of a number of labels and a path
length that some rule has are expanded, so the expansion is exact for any rule and bounded
by the rules, not by the url.  Expressions meet rules by an equi-join on 32 bits of SHA-256; the
whole digest then confirms, and the longest rule wins.

Nulls and texts without `://` have an empty host and path and match no rule.  Repeated rows are
judged alike, each one staying.  Rules with a null host or path, or an empty host, are ignored; of two rules with
equal host and path, block wins.  An empty rule table gives every url the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import Stage, table

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def _short(digest: Column) -> Column:
    """The first 32 bits."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


ADDED = ("host", "path", "rule", "verdict")


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict added; its own columns of those names are left out.  rules: host, path
    (from its slash on), verdict."""
    spark = urls.sparkSession
    stage = Stage(spark, "url-filter")
    rules = (rules.select("host", "path", "verdict")
             .filter("host IS NOT NULL AND path IS NOT NULL AND host <> ''")
             .groupBy(F.translate("host", *LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict")))
    # Shapes of rules, that is numbers of labels and of path characters that occur together.
    shapes = sorted(rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect())
    own = [c for c in urls.columns if c not in ADDED]
    parts = urls.select(*[urls[c] for c in own], host_of(urls[url]).alias("host"), path_of(urls[url]).alias("path"))
    if not shapes:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shape = F.explode(F.array(*[F.struct(F.lit(s.labels).alias("labels"), F.lit(s.chars).alias("chars")) for s in shapes]))
    asked = (parts.filter("host <> ''").select("host", "path").distinct()
             .select("host", "path", F.size(F.split("host", r"\.")).alias("n"), shape.alias("s"))
             .filter("n >= s.labels AND length(path) >= s.chars")
             .select("host", "path", _digest(F.expr("substring_index(host, '.', -s.labels)"), F.expr("substring(path, 1, s.chars)")).alias("digest")))
    asked = asked.withColumn("short", _short(F.col("digest")))
    known = rules.select(F.concat("host", "path").alias("rule"), "verdict", _digest(F.col("host"), F.col("path")).alias("full"), F.length("host").alias("h_len"))
    known = known.withColumn("short", _short(F.col("full")))
    best = (asked.join(known, "short").filter("digest = full")
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("len"), "h_len", "rule", "verdict")).alias("best"))
            .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("found")))
    # Written first: a join right on top of its own aggregation could not be split where very many rows have one url.
    best = stage.keep(best)
    return (parts.join(best, ["host", "path"], "left")
            .select(*[parts[c] for c in own], "host", "path", best["rule"], F.coalesce(best["found"], F.lit(default)).alias("verdict")))


#: The rules of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')) AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN hits USING (page_id)
"""
