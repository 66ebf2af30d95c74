"""Benchmark decontamination, with DataFrame functions alone.

A window is 10 consecutive words of a benchmark item (or the whole of a shorter item).  To hold a
window a document must hold the window's rarest word, so that word is the window's necessary prefix
token under the global order of rarity, counted over all documents.  Document words meet windows by
an equi-join on that token; the token's position bounds where the window must lie and whether it fits,
and the words there are then compared one by one with the window.

Windows are broadcast in parts of at most PART windows and PART_BYTES of words on average, one pass over the documents for
each part: the benchmark is the stated query set, and a larger one costs more passes, not more memory.  A window carries the
number of its list of items, not the items: lists are joined when a document's hits are down to the distinct lists, so
a line that very many items share costs its list once a document, however often it stands there.

Null text has no words.  Repeated rows stay and are judged alike.  An empty benchmark hits nothing; an
empty table gives an empty result.  Windows of items without an id hit like all others; null counts as one
item (n_items, as in OP5_SQL), the last of `items`, and adds nothing to the joined ids (items_sha256).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import Stage, table

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that are broadcast at once.
PART, PART_BYTES = 200_000, 64_000_000
#: Stands after a document's words in the join, so that each document gives a row of its own.
MARK = "\x00"


def words_of(text: Column) -> Column:
    """The words, with an empty one before or after them where the text does not begin or end with a word.

    Those empty ones fit no window, so nothing trims them in the scan of all documents."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)  # lower() folds more than A-Z, but not in ASCII, where it is faster
    return F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, *LOWER)), BETWEEN)


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """window (array of words) and items: the distinct windows of benchmark(item_id, text)."""
    words = F.filter(words_of(F.col("text")), lambda w: w != "")
    w = benchmark.select("item_id", words.alias("words")).filter("size(words) > 0")
    return (w.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(size(words) - {size}, 0)), i -> slice(words, i + 1, {size}))")).alias("window"))
            .groupBy("window").agg(F.array_sort(F.transform(F.collect_set(F.struct(F.col("item_id").cast("string").alias("id"))), lambda s: s["id"])).alias("items")))  # collect_set alone leaves out nulls


def word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, n: how often each word of vocabulary(word) stands in all documents."""
    # explode() would make Spark infer a filter on the array's size and split each text twice.
    return (docs.select(F.explode_outer(words_of(F.col("text"))).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")))


def prefix_tokens(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows with token (their rarest word) and offset (its first position in the window)."""
    each = windows.select("window", "items", F.posexplode("window").alias("offset", "word")).join(counts, "word", "left")
    rarest = each.groupBy("window", "items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("t"))
    return rarest.select("window", "items", F.col("t.word").alias("token"), F.col("t.offset").alias("offset"))


def find_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), copies, n_words, hits: one row per distinct document.

    hits: array of (start, length, items) of every occurrence of a window; items is what the windows have under that name.  windows must be small enough to broadcast.
    """
    mark = F.array(F.lit(MARK))
    none = F.lit(None).cast(windows.schema["items"].dataType)
    listed = windows.select("token", "offset", "window", "items").unionByName(
        windows.sparkSession.range(1).select(F.lit(MARK).alias("token"), F.lit(0).alias("offset"), mark.alias("window"), none.alias("items")))
    d = docs.select("doc_id", F.xxhash64("text").alias("key"), F.concat(words_of(F.col("text")), mark).alias("words"))
    at = d.select("doc_id", "key", "words", F.posexplode_outer("words").alias("pos", "token"))
    fits = F.expr("pos >= offset AND pos - offset + size(window) <= size(words) AND slice(words, pos - offset + 1, size(window)) = window")
    found = at.join(F.broadcast(listed), "token").filter(fits)
    is_mark = F.col("token") == MARK
    n_words = F.expr("pos - if(words[0] = '', 1, 0) - if(pos > 1 AND words[pos - 1] = '', 1, 0)")
    return (found.select("doc_id", "key", F.when(is_mark, n_words).alias("n"),
                         F.when(~is_mark, F.struct((F.col("pos") - F.col("offset")).alias("start"), F.size("window").alias("length"), "items")).alias("hit"))
            .groupBy("doc_id", "key").agg(F.count("n").alias("copies"), F.max("n").alias("n_words"), F.collect_set("hit").alias("hits")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_hit, items (sorted ids as strings, null last), contaminated, text_key
    (xxhash64 of the text)."""
    spark = docs.sparkSession
    stage = Stage(spark, "decontaminate")
    docs = docs.select("doc_id", "text")
    listed = stage.keep(windows_of(benchmark.select("item_id", "text"), size))
    lists = stage.keep(listed.select("items").distinct().withColumn("list", F.monotonically_increasing_id()))
    windows = stage.keep(listed.join(lists, "items").select("window", F.col("list").alias("items")))
    stage.drop(listed)
    n, bytes_ = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("window", " "))), F.lit(0))).first()
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    # A vocabulary is at most `size` words a window, so it is broadcast under the same bound.
    counts = word_counts(docs, F.broadcast(vocabulary) if n <= PART and bytes_ <= PART_BYTES else vocabulary)
    # Written first: a join right on top of its own aggregation could not be split at a word that very many windows have.
    ready = stage.keep(prefix_tokens(windows, stage.keep(counts)))
    stage.drop(windows)
    parts = max(-(-n // PART), -(-bytes_ // PART_BYTES), 1)
    found = reduce(DataFrame.unionByName, [find_windows(docs, ready if parts == 1 else ready.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == k)) for k in range(parts)])
    if parts > 1:
        found = found.groupBy("doc_id", "key").agg(F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"))
    covered = F.expr("""aggregate(sort_array(hits), named_struct('n', 0, 'end', 0),
        (a, h) -> named_struct('n', a.n + greatest(0, h.start + h.length - greatest(h.start, a.end)), 'end', greatest(a.end, h.start + h.length)), a -> a.n)""")
    held = stage.keep(found.select("doc_id", "key", "copies", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: h["items"])).alias("lists")))
    named = (held.filter("n_hit > 0").select("doc_id", "key", F.explode("lists").alias("list")).join(lists, "list")
             .groupBy(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))  # a document's distinct lists
    out = held.join(named, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    return (out.select("doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "key", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
            .select("doc_id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"), F.col("key").alias("text_key")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN item_windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
