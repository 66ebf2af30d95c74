"""Exact dedup through counting quotient filters.

A fingerprint of 64 bits is cut into a block (its high bits, which deal the filters out), a quotient and a
remainder.  Each input partition builds its own filters, one for each block that it meets: a table of slots in which
the remainders of a quotient stand sorted in a run, as near to the quotient's own slot as there is room.  One bit
marks quotients that have a run, one the end of a run, one the slots that hold digits of a count: a fingerprint
that occurs c times takes one slot and as many more as c - 1 has digits in the remainder's base, so a text that a third of
all rows share takes a few slots in each partition's filter.  Filters of a block merge without loss, by walking their runs in order
of the remainders and adding counts, whatever their quotients' sizes.  Fingerprints with a count above one, and only
those, send their rows to verification, which groups by the bytes of the normalised text itself.

Null text counts as empty.  Every input row gives one output row, repeated rows too.  A null doc_id
stays only when all ids of its group are null.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import Stage, sieve, table

#: Fingerprints in a block of the merged filter, on average.
PER_BLOCK = 200_000
#: Share of slots that are in use.
LOAD = 0.75


def normalised(text: Column) -> Column:
    """Runs of white space as one space; single spaces are left alone, which is most of them."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _low(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


@dataclass
class QuotientFilter:
    """Counts of fingerprints of `bits` bits.  Quotients have q bits; slots may run past the last quotient's own."""

    bits: int
    q: int
    slots: np.ndarray  # remainders, and digits of counts
    runs: np.ndarray  # by slot: the quotient of this number has a run
    ends: np.ndarray  # by slot: last slot of a run
    digits: np.ndarray  # by slot: digit of the count of the remainder before, lowest first

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """The filter of sorted distinct fingerprints and their counts."""
        rest = np.asarray(counts, np.uint64) - np.uint64(1)
        # Counts' digits change with q and q with the slots that digits need, which are few: two rounds settle it.
        q = 1
        for _ in range(2):
            r = bits - q
            n_digits = np.zeros(len(keys), np.int64)
            left = rest
            while left.any():
                n_digits += left > 0
                left = left >> np.uint64(r)
            q = int(np.clip(np.ceil(np.log2(max(1, (len(keys) + n_digits.sum()) / LOAD))), 1, bits - 1))
        r = bits - q
        n_digits = np.zeros(len(keys), np.int64)
        levels = []
        left = rest
        while left.any():
            levels.append(left & _low(r))
            n_digits += left > 0
            left = left >> np.uint64(r)
        first = np.concatenate([[0], np.cumsum(1 + n_digits)])
        content = np.empty(first[-1], np.uint64)
        content[first[:-1]] = keys & _low(r)
        is_digit = np.ones(first[-1], bool)
        is_digit[first[:-1]] = False
        for k, digit in enumerate(levels):
            has = n_digits > k
            content[first[:-1][has] + 1 + k] = digit[has]
        home = np.repeat((keys >> np.uint64(r)).astype(np.int64), 1 + n_digits)
        # Each entry stands in its quotient's own slot or the first free one after it.
        place = np.arange(len(home)) + np.maximum.accumulate(home - np.arange(len(home))) if len(home) else home
        size = max(1 << q, int(place[-1]) + 1 if len(place) else 0)
        slots, runs, ends, digits = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
        slots[place], digits[place], runs[home] = content, is_digit, True
        ends[place[np.append(home[1:] != home[:-1], True)] if len(home) else place] = True
        return cls(bits, q, slots, runs, ends, digits)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts, read off the runs: the k-th quotient that is marked owns the k-th run."""
        r = self.bits - self.q
        quotient, end = np.flatnonzero(self.runs), np.flatnonzero(self.ends)
        start = np.maximum(quotient, np.concatenate([[0], end[:-1] + 1]) if len(end) else end)
        size = end - start + 1
        place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        fresh = np.flatnonzero(~self.digits[place])
        keys = (np.repeat(quotient, size)[fresh].astype(np.uint64) << np.uint64(r)) | self.slots[place[fresh]]
        counts = np.ones(len(keys), np.uint64)
        n_digits = np.diff(np.append(fresh, len(place))) - 1
        for k in range(int(n_digits.max()) if len(fresh) else 0):
            has = n_digits > k
            counts[has] += self.slots[place[fresh[has] + 1 + k]] << np.uint64(k * r)
        return keys, counts

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Both filters' fingerprints, counts added.  The sort is a merge: numpy's stable one takes the two sorted stretches as they are."""
        (a, n), (b, m) = self.entries(), other.entries()
        keys, counts = np.concatenate([a, b]), np.concatenate([n, m])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
        return QuotientFilter.of(keys[first], np.add.reduceat(counts, first) if len(first) else counts, self.bits)

    def dumps(self) -> bytes:
        """q and the number of slots, the slots in as many bytes as a remainder needs, and the three bits of each."""
        wide = -(-(self.bits - self.q) // 8)
        packed = self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
        return np.array([self.q, len(self.slots)], "<i8").tobytes() + packed + b"".join(np.packbits(x).tobytes() for x in (self.runs, self.ends, self.digits))

    @classmethod
    def loads(cls, data: bytes, bits: int) -> QuotientFilter:
        q, size = (int(x) for x in np.frombuffer(data, "<i8", 2))
        wide, at, step = -(-(bits - q) // 8), 16, -(-size // 8)
        slots = np.zeros((size, 8), np.uint8)
        slots[:, :wide] = np.frombuffer(data, np.uint8, size * wide, at).reshape(size, wide)
        at += size * wide
        marks = [np.unpackbits(np.frombuffer(data, np.uint8, step, at + k * step), count=size).astype(bool) for k in range(3)]
        return cls(bits, q, slots.reshape(-1).view("<u8").astype(np.uint64), *marks)


def _build(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The filters of this partition, one for each block.  They go out whenever a few million fingerprints are held."""
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            blocks = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            edges = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(keys))
            filters = [QuotientFilter.of(keys[a:z] & _low(64 - bits), counts[a:z], 64 - bits).dumps() for a, z in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(blocks[edges[:-1]], pa.int64()), pa.array(filters, pa.binary())], ["block", "filter"])

        for b in batches:
            held.append(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) > 4_000_000:
                yield out()
        if sum(map(len, held)):
            yield out()

    return build


def _merge(bits: int):
    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Merges a block's filters; yields fingerprints that were counted more than once."""
        block, tower = 0, []
        for part in parts:
            for b, data in zip(part["block"], part["filter"], strict=True):
                block, one = int(b), QuotientFilter.loads(data, 64 - bits)
                # Filters of about equal size are merged with each other, so that each fingerprint is walked a few times alone.
                while tower and len(tower[-1].slots) <= 2 * len(one.slots):
                    one = tower.pop().merge(one)
                tower.append(one)
        whole = tower.pop() if tower else QuotientFilter.of(np.empty(0, np.uint64), np.empty(0, np.uint64), 64 - bits)
        while tower:
            whole = tower.pop().merge(whole)
        keys, counts = whole.entries()
        many = counts > 1
        high = np.uint64(block << (64 - bits)) if bits else np.uint64(0)
        yield pd.DataFrame({"fp": (keys[many] | high).view(np.int64), "n": counts[many].astype(np.int64)})

    return merge


def repeated_fingerprints(fps: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once in fps(fp)."""
    bits = max(0, int(np.ceil(np.log2(max(1, rows / PER_BLOCK)))))
    filters = fps.select("fp").mapInArrow(_build(bits), "block long, filter binary")
    return filters.groupBy("block").applyInPandas(_merge(bits), "fp long, n long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and text_key (xxhash64 of the raw text) of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    stage = Stage(spark, "exact-dedup")
    norm = normalised(F.col("text")).alias("norm")
    base = stage.keep(docs.select("doc_id", F.xxhash64("text").alias("text_key"), norm)
                      .select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.xxhash64("norm").alias("fp"), "text_key",
                              F.monotonically_increasing_id().alias("row")))
    repeated = stage.keep(repeated_fingerprints(base, base.count()))
    suspects = base.join(repeated.select("fp"), "fp", "left_semi")
    # Raw texts are picked by their own hash, so that those alone are normalised again.  Where the join shuffles, few others come along.
    asked = stage.keep(suspects.select("text_key").distinct())
    wanted = sieve(asked.select(F.col("text_key").alias("h")))
    verified = stage.keep(docs.select("text", F.xxhash64("text").alias("text_key"), "doc_id").filter(wanted(F.col("text_key"))).join(asked, "text_key", "left_semi")
                          .groupBy(norm).agg(F.min("doc_id").alias("keep"), F.count("*").alias("size"))
                          .select(F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep", "size"))
    stage.drop(asked)
    # Where rows repeat an id and a text, the first of them stands for all.
    again = stage.keep(suspects.groupBy("text_sha256", "doc_id")
                       .agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
                       .select(F.col("text_sha256").alias("sha"), F.col("doc_id").alias("id"), "first"))
    stage.drop(repeated)
    return (base.join(verified, "text_sha256", "left")
            .join(again, (F.col("text_sha256") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
            .select("doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
                    F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep")) & F.coalesce(F.col("row") == F.col("first"), F.lit(True)))).alias("kept"),
                    "text_sha256", "text_key"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


OP2_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
