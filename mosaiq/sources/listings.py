"""Listings that come as HTML pages: a row per page, parsed by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.functions.text import class_text, slug, strip_tags
from mosaiq.sources.leads import as_leads


def pages(spark: SparkSession, path: str) -> DataFrame:
    """html, url: the pages of a folder, one per file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.col("_metadata.file_path").alias("url"))


def _blocks(df: DataFrame, start: str) -> DataFrame:
    """url, pos, block: the stretches of each page that begin with a pattern, in order."""
    found = F.regexp_extract_all("html", F.lit(rf"(?s){start}.*?(?={start}|$)"), F.lit(0))
    return df.select("url", F.posexplode(found).alias("pos", "block"))


def _href(x: Column, css: str) -> Column:
    return F.nullif(F.regexp_extract(x, rf"""(?s)class="[^"]*\b{css}\b[^"]*".*?<a[^>]*href=["']([^"']+)["']""", 1), F.lit(""))


#: The first three digits of ZIP codes in the city's area.
AREA = ("189", "190", "191", "193", "194", "080", "081")


def parse_club_cards(df: DataFrame) -> DataFrame:
    """Leads of pages with a heading, an address and a details link per club.  A club is in the area if its ZIP code begins so."""
    cards = _blocks(df, r'<h3[^>]*class="fl-post-title"')
    name = strip_tags(F.regexp_extract("block", r"(?s)<h3[^>]*>(.*?)</h\d>", 1))
    address = class_text(F.col("block"), "grotto-address")
    link = _href(F.col("block"), "fl-post-more-link")
    zip_ = F.regexp_extract(address, r"\b(\d{5})(?:-\d{4})?\s*$", 1)
    extra = F.map_filter(F.create_map(F.lit("address"), address, F.lit("philadelphia_area"), F.substring(zip_, 1, 3).isin(*AREA).cast("string")), lambda _, v: v.isNotNull())
    native = F.coalesce(F.nullif(F.regexp_extract(link, r"/([^/]+)/?$", 1), F.lit("")), slug(name))
    return as_leads(cards.filter(name.isNotNull()), "nss_grottos", native_id=native, name=name, source_url=F.col("url"), website=link, kind_hint=F.lit("club"), extra=extra)


def club_cards(spark: SparkSession, path: str) -> DataFrame:
    return parse_club_cards(pages(spark, path))


def parse_grantee_cards(df: DataFrame) -> DataFrame:
    """Leads of pages with a card per grantee: a heading that links to its page, and labelled rows.  A page without cards gives none."""
    cards = _blocks(df, r'<(?:div|article)[^>]*class="[^"]*\bgrantee\b')
    title = F.regexp_extract("block", r"(?s)<h\d[^>]*>(.*?)</h\d>", 1)
    field = lambda label: strip_tags(F.regexp_extract("block", rf"(?s)<dt[^>]*>\s*{label}\s*</dt>\s*<dd[^>]*>(.*?)</dd>", 1))
    name, tag = strip_tags(title), field("Discipline")
    page = F.nullif(F.regexp_extract(title, r"""href=["']([^"']+)["']""", 1), F.lit(""))
    extra = F.map_filter(F.create_map(F.lit("grant_program"), field("Program"), F.lit("council_district"), field("Council District")), lambda _, v: v.isNotNull())
    native = F.coalesce(F.nullif(F.regexp_extract(page, r"/([^/]+)/?$", 1), F.lit("")), slug(name))
    site = F.nullif(F.regexp_extract("block", r"""(?s)<a[^>]*class="[^"]*\bwebsite\b[^"]*"[^>]*href=["']([^"']+)["']""", 1), F.lit(""))
    return as_leads(cards.filter(name.isNotNull()), "cultural_fund", native_id=native, name=name, source_url=F.col("url"), website=site, kind_hint=F.lit("grantee"),
                    tags_hint=F.array_compact(F.array(tag)), extra=extra)


def grantee_cards(spark: SparkSession, path: str) -> DataFrame:
    return parse_grantee_cards(pages(spark, path))


def parse_lineup(df: DataFrame, day: str) -> DataFrame:
    """Leads of a lineup: headings of divisions (h2) and mother clubs (h3) hold for the units (li) below them; `Name: theme` splits.

    The headings are carried down by a window over each page, which is one file."""
    parts = F.regexp_extract_all("html", F.lit(r"(?s)<(h2|h3|li)[\s>].*?</\1>"), F.lit(0))
    rows = df.select("url", F.posexplode(parts).alias("pos", "part")).select("url", "pos", F.substring("part", 2, 2).alias("tag"), strip_tags(F.col("part")).alias("text"))
    w = Window.partitionBy("url").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("division", F.last(F.when(F.col("tag") == "h2", F.col("text")), ignorenulls=True).over(w))
    # A new division ends the mother club.
    rows = rows.withColumn("mother", F.last(F.when(F.col("tag") == "h2", F.lit("")).when(F.col("tag") == "h3", F.col("text")), ignorenulls=True).over(w))
    rows = rows.filter("tag = 'li' AND text IS NOT NULL").withColumn("mother", F.nullif("mother", F.lit("")))
    name = F.trim(F.split_part("text", F.lit(": "), F.lit(1)))
    theme = F.nullif(F.trim(F.split_part("text", F.lit(": "), F.lit(2))), F.lit(""))
    rows = rows.withColumn("name", name).withColumn("theme", theme).withColumn("slug", slug(name))
    again = F.row_number().over(Window.partitionBy("slug").orderBy("url", "pos"))
    rows = rows.withColumn("native", F.when(again == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", again.cast("string"))))
    tags = F.array_compact(F.array(F.col("division"), F.concat(F.lit("Mother Club: "), "mother")))
    extra = F.map_filter(F.create_map(F.lit("mother_club"), F.col("mother"), F.lit(f"{day[:4]}_theme"), F.col("theme")), lambda _, v: v.isNotNull())
    return as_leads(rows, "mummers", native_id=F.col("native"), name=F.col("name"), source_url=F.col("url"), kind_hint=F.lit("parade_unit"), tags_hint=tags, extra=extra,
                    seen_at=F.array(F.struct(F.lit(day).alias("date"), F.concat(F.lit("In the lineup of the "), F.coalesce("division", F.lit("parade"))).alias("note"))))


def parade_lineup(spark: SparkSession, path: str, day: str = "2026-01-01") -> DataFrame:
    return parse_lineup(pages(spark, path), day)
