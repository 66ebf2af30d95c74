"""Connected components of links, by alternating large and small stars.

Each round is an aggregation and a join; stars shrink a component's depth fast, so a few rounds do.
Links are never gathered.  Aggregates are written before they are joined back, so that Spark can split a node with
very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import Stage


def _large(e: DataFrame, stage: Stage) -> DataFrame:
    """Larger neighbours of each node get its smallest neighbour (or itself)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(e: DataFrame, stage: Stage) -> DataFrame:
    """Smaller neighbours of each node, and itself, get the smallest of them."""
    least = stage.keep(e.groupBy("u").agg(F.min("v").alias("m")))
    joined = e.join(least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node has one link at most to a smaller one, which itself has none."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR down = 1 AND up = 1").isEmpty()


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """node, label (the component's smallest node) of every node in links(a, b) but the smallest of each component."""
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    old = None
    while True:
        e = stage.keep(_small(stage.keep(_large(e, stage)), stage))
        if old is not None:
            stage.drop(old)
        if _stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        old = e
