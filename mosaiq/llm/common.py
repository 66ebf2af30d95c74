"""Shared helpers: intermediate tables, hot keys, and vectorised word hashing for Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
#: Java regex of one word between white space, `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns.  Whatever else the table carries is pruned before any work."""
    return df.select(*[df[n] for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, with its scheme: spark.checkpoint.dir.

    Where that is unset, a session within one process (tests, a notebook) gets a folder of its own; a cluster has no
    folder that we could know of, so there it is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="mosaiq-"))
        where = context.getCheckpointDir()
    path = context._jvm.org.apache.hadoop.fs.Path(where.rstrip("/"))
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: Spark's own setting (4.1): shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """Intermediate tables of one run, written as Parquet in the shared folder.

    A written table cuts the lineage: if an executor is lost later, only what came after is redone.
    drop() deletes tables that no later step reads; close() deletes all, once the results that read them are written.
    With free, the shuffle files of a table go as soon as it is written: no later step reads them.
    """

    def __init__(self, spark: SparkSession, name: str, free: bool = False):
        self.spark, self.root, self.free = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", free
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.n = 0

    def keep(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        conf = self.spark.conf
        before = conf.get(FREE, None)
        if self.free:
            conf.set(FREE, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            if self.free:
                conf.unset(FREE) if before is None else conf.set(FREE, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            delete(self.spark, self.paths.pop(id(df))[1])

    def close(self) -> None:
        delete(self.spark, self.root)
        self.paths.clear()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def in_tree(parts: DataFrame, merge, width: int = 8, last=None, schema: str = "") -> list:
    """The rows that are left of parts when tasks have merged them, `width` partitions at a time: one, or none.  merge takes and gives Arrow batches.
    last, of that schema, makes what goes to the driver of it."""
    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // width)
        parts = parts.repartition(n).mapInArrow(merge, parts.schema)
    return (parts.mapInArrow(last, schema) if last else parts).collect()


SIEVE = 1 << 25


def sieve(hashes: DataFrame):
    """A test of hash columns that is true for every value of hashes(h: long) and for few others.

    A Bloom filter of fixed size (4 MB, two bits a value), built in tasks and broadcast: it goes before a join that shuffles whole
    texts of which few are wanted.  The join decides; with very many values the filter lets more and more through."""
    def places(h: np.ndarray) -> list[np.ndarray]:
        h = mix(h.view(np.uint64))
        return [(h & np.uint64(SIEVE - 1)).astype(np.int64), (h >> np.uint64(39)).astype(np.int64)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SIEVE, bool)
        for b in batches:
            for at in places(b.column("h").to_numpy(zero_copy_only=False)):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SIEVE // 8, np.uint8)
        for b in batches:
            for x in b.column("bits"):
                bits |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    rows = in_tree(hashes.select("h").mapInArrow(mark, "bits binary"), either)
    held = hashes.sparkSession.sparkContext.broadcast(bytes(rows[0].bits) if rows else bytes(SIEVE // 8))

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        bits = np.frombuffer(held.value, np.uint8)
        a, b = places(h.to_numpy(np.int64))
        return pd.Series((bits[a >> 3] >> (7 - (a & 7)) & bits[b >> 3] >> (7 - (b & 7)) & 1) > 0)

    return passes


# ---- Arrow batches ---------------------------------------------------------------------------

def give_back() -> None:
    """Hands memory that is free but held by Arrow's pool and the allocator back: workers outlive their tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def give_back_driver(spark: SparkSession) -> None:
    """The same for the driver: many small steps leave garbage in its heap, and tables of shuffles and broadcasts that only a collection lets go."""
    spark.sparkContext._jvm.java.lang.System.gc()
    give_back()


def small(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `limit` bytes of the column (one row at least), so that memory stays bounded; given back after the last one."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        edges = [0, *cuts.tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            if z > a:
                yield b.slice(a, z - a)
        del b
    give_back()


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ---- hashing -----------------------------------------------------------------------------------

_CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def _once(name: str, make) -> np.ndarray:
    if name not in _tables:
        _tables[name] = make()
    return _tables[name]


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base, np.uint64))])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def white_table() -> np.ndarray:
    return _once("white", lambda: np.isin(np.arange(256), list(WHITE.encode())))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[s:e] for spans in order of start, no longer than the gap between chunks allows."""
    table = _once("bytes", lambda: np.random.default_rng(1).integers(0, 2**64, 256, np.uint64))
    base = 0xD6E8FEB86659FD93
    n_max = _CHUNK + 1
    power = _once("power", lambda: _powers(base, n_max))
    back = _once("back", lambda: _powers(pow(base, -1, 2**64), n_max))
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            at = starts[i]
            j = int(np.searchsorted(ends, at + _CHUNK, "right")) if ends[-1] > at + _CHUNK else len(starts)
            if j <= i:  # one span longer than a chunk: fold its chunks
                h = np.uint64(0)
                for a in range(at, ends[i], _CHUNK):
                    part = table[data[a:min(a + _CHUNK, ends[i])]]
                    h = mix((h * _ODD + (part * power[:len(part)]).sum(dtype=np.uint64))[None])[0]
                out[i] = h
                i += 1
                continue
            part = table[data[at:ends[j - 1]]]
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power[:len(part)], out=run[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (run[e] - run[s]) * back[s] + (e - s).astype(np.uint64) * _ODD
            i = j
    return mix(out)


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, starts and ends of their words, and the first word of each text (and the end)."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)  # bytes.lower() folds A-Z alone
    gap = np.concatenate([[True], white_table()[data]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return data, starts, ends, np.searchsorted(starts, at)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive hashes, by doubling: a run of n is two shorter runs put together."""
    if n == 1:
        return h
    level, size, runs = h, 1, {1: h}
    while size * 2 <= n:
        level = pair(level[:-size] if size < len(level) else level[:0], level[size:])
        size *= 2
        runs[size] = level
    out, done = level, size
    while done < n:
        part = max(s for s in runs if s <= n - done)
        tail = runs[part][done:]
        m = min(len(out), len(tail))
        out, done = pair(out[:m], tail[:m]), done + part
    return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * _ODD + (b ^ np.uint64(0x5851F42D4C957F2D)))
