"""Names that a table does not have, row numbers that no single task has to give out, and tables that cut the lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task numbers, about; chunks at most; rows whose order values choose the chunks' bounds.
PER_CHUNK, CHUNKS, SAMPLE = 1_000_000, 256, 4096


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until df has no column of that name."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir, so that later steps and lost executors begin from there.

    Where that is unset, a session in one process (tests, a notebook) gets a folder of its own; on a cluster it is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="mosaiq-"))
    return df.checkpoint()


def numbered(df: DataFrame, keys: list[str], order: Column, name: str, chunks: int | None = None) -> DataFrame:
    """df with each row's number, from 1, among the rows of its keys in order of `order`, nulls first.

    Where df is large its rows are dealt into chunks of successive order values: tasks number a key's rows within a chunk and
    the counts of chunks before are added, so a key that most rows have is shared out.  The bounds of chunks are sampled; they decide no number."""
    value, chunk, own, before = fresh(df, "order_value", "chunk", "own", "before")
    rows = df.withColumn(value, order)
    n = rows.count() if chunks is None else 0
    chunks = min(CHUNKS, -(-n // PER_CHUNK)) if chunks is None else chunks
    if chunks <= 1:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(value)).cast("long")).drop(value)
    share = min(1.0, SAMPLE / n) if n else 1.0
    held = sorted(r[0] for r in rows.filter(F.pmod(F.xxhash64(value), F.lit(1 << 30)) < int(share * (1 << 30))).select(value).filter(F.col(value).isNotNull()).distinct().limit(4 * SAMPLE).collect())
    bounds = [held[k * len(held) // chunks] for k in range(1, chunks)] if held else []
    kind = rows.schema[value].dataType
    part = sum((F.when(F.col(value) >= F.lit(b).cast(kind), 1).otherwise(0) for b in bounds), F.lit(0))
    rows = rows.withColumn(chunk, part)
    counts = rows.groupBy(*keys, chunk).agg(F.count("*").alias(own))
    counts = counts.withColumn(before, F.sum(own).over(Window.partitionBy(*keys).orderBy(chunk)) - F.col(own)).drop(own)  # a row a chunk
    names = [*keys, chunk]
    other = counts.select(*[F.col(c).alias(f"{c}{before}") for c in names], before)
    same = [F.col(c).eqNullSafe(F.col(f"{c}{before}")) for c in names]
    numbered_ = rows.withColumn(own, F.row_number().over(Window.partitionBy(*names).orderBy(value)))
    return numbered_.join(other, same, "left").withColumn(name, F.col(own) + F.col(before)).select(*df.columns, name)
