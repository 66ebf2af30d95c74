"""Substring dedup by level-wise doubling.

Levels are window lengths, each twice the one before, up to the length that counts: 13, 25 and 50 words, or 13, 25, 50,
100 and 200.  At a level below the last, the window with the smallest hash in a run of the full length stands for all of
that run's windows (the same one wherever the run stands), so a text sends one hash for many words.  Windows that
repeat across documents survive and alone are extended to twice the length; what stands nowhere else is dropped, until
nothing survives or the full length is reached.  There the windows that survived are hashed whole, and those that also
start in a document with a smaller id are removed.  No window that repeats at full length can be lost on the way,
because all windows within it repeat too.

Documents with equal word sequences are folded first: the one with the smallest id speaks for all,
and in the others every window repeats.  Groups of equal hashes are met by a partial aggregation and
a join back, never gathered, so a passage that a third of all rows share is dealt over many tasks.

Null text has no words.  A null doc_id sorts after all others.  Rows that repeat an id and a text are
judged alike and all stay.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import Stage, encoded, mix, ngrams, sieve, small, span_hashes, table, words

LAST = 2**63 - 1
NOTHING = hashlib.sha256(b"").hexdigest()
_NONE = np.uint64(2**64 - 1)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, starts, ends, first = words(texts)
    return span_hashes(data, starts, ends), first


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values."""
    size = 1
    while size * 2 <= n and len(h) > size:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:len(h) - (n - size)], h[n - size:]) if n > size else h


def _windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; first word of each text; the text of each window of `size` words and its start among all words."""
    h, first = _word_hashes(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    start = np.arange(max(0, len(h) - size + 1))
    start = start[row[start] == row[start + size - 1]] if len(start) else start
    return h, first, row[start], start


def _standing(h: np.ndarray, start: np.ndarray, size: int, length: int) -> np.ndarray:
    """The shorter window that stands for each window of the full size."""
    return _least(ngrams(h, length), size - length + 1)[start]


def lengths(size: int, first: int = 12) -> list[int]:
    """The levels below the full size: half of it, half of that, and so on, but none below `first` words save the half."""
    out = [-(-size // 2)]
    while -(-out[0] // 2) >= first:
        out.insert(0, -(-out[0] // 2))
    return out


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> pa.Array:
    """The distinct hashes of each of n rows, as lists."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.searchsorted(row[new], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(h[new].view(np.int64)))


def _alive(b: pa.RecordBatch, h: np.ndarray, row: np.ndarray, start: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which windows' standing window is among the row's surviving hashes (its column `halves`)."""
    n = b.column("halves").value_lengths().to_numpy(zero_copy_only=False)
    held = b.column("halves").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    mark = mix(np.arange(len(n)).astype(np.uint64) + np.uint64(77))
    return np.isin(_standing(h, start, size, length) ^ mark[row], held ^ np.repeat(mark, n))


def _first_level(size: int, length: int):
    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            texts = encoded(b.column("text"))
            h, first, row, start = _windows(texts, size)
            shas = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), b.column("key"), b.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(shas, pa.string()), _distinct(row, _standing(h, start, size, length), len(texts))],
                ["did", "key", "doc_id", "n_words", "sha", "halves"])

    return level


def _next_level(size: int, before: int, length: int):
    """The windows that survived, extended to twice the length."""
    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            h, _, row, start = _windows(encoded(b.column("text")), size)
            alive = _alive(b, h, row, start, size, before)
            row, start = row[alive], start[alive]
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("key"), _distinct(row, _standing(h, start, size, length), b.num_rows)], ["did", "key", "halves"])

    return level


def _last_level(size: int, before: int):
    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            h, first, row, start = _windows(encoded(b.column("text")), size)
            alive = _alive(b, h, row, start, size, before)
            row, start = row[alive], start[alive]
            whole = ngrams(h, size)[start] if len(start) else np.empty(0, np.uint64)
            # 16 more bits of hash over 32 bits of place.
            more = mix(whole + (mix(h[start] ^ (h[start + size // 2] << np.uint64(1)) ^ (h[start + size - 1] << np.uint64(2))))) >> np.uint64(48)
            at = (more << np.uint64(48)) | (start - first[row]).astype(np.uint64)
            did = b.column("did").to_numpy(zero_copy_only=False)[row]
            key = b.column("key").to_numpy(zero_copy_only=False)[row]
            for i in range(0, len(at), 200_000):
                j = i + 200_000
                yield pa.RecordBatch.from_arrays([pa.array(whole[i:j].view(np.int64)), pa.array(at[i:j].view(np.int64)), pa.array(did[i:j], pa.int64()), pa.array(key[i:j], pa.int64())], ["h", "at", "did", "key"])

    return level


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of `size` words from one of the starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:n]) > 0


def _apply(size: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            removed, shas, kept = [], [], []
            for text, starts in zip(encoded(b.column("text")), b.column("starts"), strict=True):
                w = text.split()
                gone = covered(np.asarray(starts.values.to_numpy(zero_copy_only=False), np.int64), size, len(w))
                left = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode())
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("key"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())],
                                             ["did", "key", "n_removed", "kept_sha256", "kept"])

    return apply


def substring_dedup(docs: DataFrame, size: int = 50, texts: bool = False, first: int = 12) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs(doc_id: long, text); with texts, also `kept`, the
    words that stay, for the rows that lost some but not all.  first: see lengths(); it changes the work, not the result."""
    spark = docs.sparkSession
    stage = Stage(spark, "substring-dedup", free=True)
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.xxhash64("text").alias("key"), "doc_id", "text")
    levels = lengths(size, first)
    level1 = stage.keep(docs.mapInArrow(_first_level(size, levels[0]), "did long, key long, doc_id long, n_words long, sha string, halves array<long>"))
    copies = level1.filter(F.col("n_words") >= size).groupBy("sha").agg(F.min("did").alias("first"), F.max("did").alias("last")).filter("first < last").select("sha", "first")
    copies = stage.keep(copies)
    # Only rows that may have copies go through the join: the lists of all others stay where they are.
    has_copies = sieve(copies.select(F.xxhash64("sha").alias("h")))(F.xxhash64("sha"))
    rows = level1.select("did", "key", "sha", "halves").filter("size(halves) > 0")
    firsts = stage.keep(rows.filter(has_copies).join(copies, "sha", "left").filter("first IS NULL OR first = did").select("did", "key", "halves"))
    standing = rows.filter(~has_copies).select("did", "key", "halves").union(firsts)
    texts_left, survivors = docs.select("did", "key", "text"), None
    for k, length in enumerate(levels):
        if k:
            standing = stage.keep(survivors.mapInArrow(_next_level(size, levels[k - 1], length), "did long, key long, halves array<long>"))
            texts_left = survivors.drop("halves")
        halves = standing.select("did", "key", F.explode("halves").alias("h"))
        # Written first: a join right on top of its own aggregation could not be split where one hash has very many rows.
        repeated = stage.keep(halves.groupBy("h").agg(F.min("did").alias("a"), F.max("did").alias("z")).filter("a < z").select("h"))
        alive = stage.keep(halves.join(repeated, "h", "left_semi").groupBy("did", "key").agg(F.collect_set("h").alias("halves")))
        if not k:  # most texts have nothing left, so they are not shuffled
            passes = sieve(alive.select(F.xxhash64("did", "key").alias("h")))
            texts_left = texts_left.filter(passes(F.xxhash64("did", "key")))
        before, survivors = survivors, stage.keep(texts_left.join(alive, ["did", "key"]), compression="zstd")
        stage.drop(repeated, alive, *([before, standing] if k else [firsts]))
        if survivors.isEmpty():
            break
    windows = survivors.mapInArrow(_last_level(size, length), "h long, at long, did long, key long")
    more = F.shiftrightunsigned("at", 48)
    earliest = windows.groupBy("h", more.alias("more")).agg(F.min("did").alias("a"), F.max("did").alias("z")).filter("a < z")
    earliest = stage.keep(earliest.select(F.col("h").alias("same"), "more", "a"))
    starts = (windows.join(earliest, (F.col("h") == F.col("same")) & (more == F.col("more")) & (F.col("did") > F.col("a")))
              .groupBy("did", "key")
              .agg(F.collect_set(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("starts")))  # a text's words, at most
    starts = stage.keep(starts)
    stage.drop(earliest)
    lost = survivors.select("did", "key", "text").join(starts, ["did", "key"])
    lost = lost.mapInArrow(_apply(size), "did long, key long, n_removed long, kept_sha256 string, kept string")
    lost = stage.keep(lost.dropDuplicates(["did", "key"]) if texts else lost.select("did", "key", "n_removed", "kept_sha256").distinct())
    stage.drop(starts, survivors)
    copy = F.col("first") < F.col("did")
    return (level1.select("did", "key", "doc_id", "n_words", "sha").join(copies, "sha", "left").join(lost, ["did", "key"], "left")
            .select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), *(["kept"] if texts else [])))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS a FROM places) WHERE a < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM again) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d)
         LEFT JOIN (SELECT doc_id AS g, unnest(ps) AS q FROM gone) ON doc_id = g AND p = q WHERE g IS NULL GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
