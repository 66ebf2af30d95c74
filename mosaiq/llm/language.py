"""Language identification with language-bitmask n-gram filters.

Character n-grams that are frequent in a language's sample go into a bit-sliced Bloom filter: each
slot holds one bit per language, in as many words of 64 bits as that takes, so the AND of a few slots gives the set of all languages that contain
an n-gram.  For a text, each language's popcount over the n-grams is corrected for the filter's false
positives (its share of set bits to the power of the number of hashes), and the largest wins; equal
counts go to the language that sorts first.

The sample is bounded: `per_language` distinct documents of each language, those with the smallest hash of
id and text, and `grams` n-grams of each (fewer, where there are more than 64 languages, see ALL_GRAMS).  Rows that cannot be among them are left out before any shuffle, by a bound on the hash that
follows from the language's count of rows, so a language that most rows have sends no more rows to a task than others.  Null or letterless text is `und` with score 0.  Repeated
rows are judged alike; a null doc_id is never learned from.  If nothing can be learned, all is `und`.
All languages with a letter in their texts are learned, however few those are.  Up to 6,400 of them the driver holds a fixed number of n-grams; beyond, 200 for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import Stage, mix, pair, small, table

SIZES = (2, 3, 4)
HASHES = 3
FEW, DAMPED = 500, 2000
#: N-grams of all languages together, about, and of each one however many those are.
ALL_GRAMS, LEAST_GRAMS = 1_280_000, 200
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def gram_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-case words (their ends marked), the row of each, and which rows have letters."""
    joined = "\n".join((t or "").replace("\n", " ").lower() for t in texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.concatenate([[0], np.cumsum(code == 10)[:-1]])
    letter = letter_table()[code]
    has = np.zeros(len(texts), bool)
    has[row[letter]] = True
    # One mark stands between words, whatever stood there.
    keep = letter | np.concatenate([[True], letter[:-1]])
    code, row, letter = np.where(letter, code, 0)[keep].astype(np.uint64), row[keep], letter[keep]
    inside = np.concatenate([[0], np.cumsum(~letter)])
    seed = mix(code + np.uint64(1))
    hashes, rows = [], []
    level = seed
    for n in range(2, max(SIZES) + 1):
        level = pair(level[:-1], seed[n - 1:]) if len(level) > 1 else level[:0]
        if n in SIZES and len(level):
            i = np.arange(len(level))
            whole = inside[i + n - 1] == inside[i + 1] if n > 2 else np.ones(len(level), bool)  # a mark may stand at an end alone
            whole &= (row[i] == row[i + n - 1]) & ((letter[i]) | (letter[i + n - 1]))
            hashes.append(level[whole])
            rows.append(row[i[whole]])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has
    return np.concatenate(hashes), np.concatenate(rows), has


@dataclass
class LanguageModel:
    languages: list[str]
    slots: np.ndarray  # a row for each 64 languages
    false_rates: np.ndarray

    def masks(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        """The set of languages, as bits, that contain each n-gram: for each 64 languages in turn."""
        places = [_place(grams, k, self.slots.shape[1]) for k in range(HASHES)]
        for word in self.slots:
            out = word[places[0]]
            for place in places[1:]:
                out &= word[place]
            yield out

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams, rows, has = gram_hashes(texts)
        n = np.bincount(rows, minlength=len(texts)).astype(float)
        points = np.empty((len(self.languages), len(texts)))
        for w, masks in enumerate(self.masks(grams)):
            for k, rate in enumerate(self.false_rates[64 * w:64 * w + 64]):
                counted = np.bincount(rows[(masks >> masks.dtype.type(k)) & masks.dtype.type(1) > 0], minlength=len(texts))
                points[64 * w + k] = np.maximum(0, counted - n * rate) / (1 - rate)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = points.argmax(axis=0)
        total = points.sum(axis=0)
        score = np.where(has, np.divide(points.max(axis=0), total, out=np.full(len(texts), 1 / len(self.languages)), where=total > 0), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, has, strict=True)], score


def _place(grams: np.ndarray, k: int, n: int) -> np.ndarray:
    return (mix(grams ^ np.uint64(0x1234567 * (k + 1))) & np.uint64(n - 1)).astype(np.int64)


def learn_languages(docs: DataFrame, per_language: int = 1500, grams: int = 20_000, least: int = 5, share: float = 0.25) -> LanguageModel:
    """Learns from docs(doc_id, text, lang).  An n-gram belongs to a language if it occurs there `least` times and at
    `share` of the rate of the language that has it most.  Languages in which fewer than FEW n-grams occur so often keep all of theirs."""
    stage = Stage(docs.sparkSession, "language")
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", "text", F.xxhash64("text").alias("key"))
    known = known.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", "key"), 11))
    # Far more than per_language of a language's rows lie below this, whatever its size.
    bound = (per_language + 8 * per_language ** 0.5 + 32) / F.count("*") * 2.0 ** 53
    below = stage.keep(known.groupBy(F.col("lang").alias("of")).agg(F.least(bound, F.lit(2.0 ** 53)).alias("bound")))
    near = known.join(below, F.col("lang") == F.col("of")).filter("hash <= bound").select("doc_id", "lang", "key", "hash").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id", "key"))
    ids = near.withColumn("r", rank).filter(F.col("r") <= per_language).select("doc_id", "lang", "key")
    # At most per_language rows a language, so it is broadcast.  Of repeated rows one is read.
    sample = known.join(F.broadcast(stage.keep(ids)), ["doc_id", "lang", "key"], "left_semi").select("doc_id", "lang", "key", "text").dropDuplicates(["doc_id", "lang", "key"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            langs = np.array(b.column("lang").to_pylist(), object)
            h, rows, _ = gram_hashes(b.column("text").to_pylist())
            for lang in sorted(set(langs)):
                keys, n = np.unique(h[(langs == lang)[rows]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stage.keep(counts)
    strong = counts.groupBy("lang").agg(F.count_if(F.col("n") >= least).alias("strong"))
    counts = counts.join(strong, "lang").filter((F.col("n") >= least) | (F.col("strong") < FEW))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    grams = min(grams, max(LEAST_GRAMS, ALL_GRAMS // max(1, below.count())))
    got = counts.withColumn("r", rank).filter(F.col("r") <= grams).select("lang", "gram", "n").toPandas()
    total = got.groupby("lang")["n"].sum()
    languages = sorted(total.index)
    bits = len(languages)
    dtype = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64
    # The rates of a language with next to no text say little, so they are damped: it can't take common n-grams from others.
    got["rate"] = got["n"] / (got["lang"].map(total) + DAMPED)
    got = got[got["rate"] >= share * got.groupby("gram")["rate"].transform("max")]
    # Each language is a filter of its own, so with room for 16 full ones any number has false rates under 1e-4.
    room = 8 * max(1, min(len(got), 16 * int(got["lang"].value_counts().max() if len(got) else 0)))
    slots = np.zeros((max(1, -(-bits // 64)), 1 << max(10, int(np.ceil(np.log2(room))))), dtype)
    for k, lang in enumerate(languages):
        keys = got.loc[got["lang"] == lang, "gram"].to_numpy().view(np.uint64)
        for h in range(HASHES):
            slots[k // 64][_place(keys, h, slots.shape[1])] |= dtype(1 << k % 64)
    rates = np.array([((slots[k // 64] >> dtype(k % 64)) & dtype(1)).mean() ** HASHES for k in range(bits)])
    return LanguageModel(languages, slots, rates)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text)."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text", 2_000_000):
            langs, score = model.judge(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = learn_languages(docs.filter(~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
