"""Browsing: what may be shown, counts by vocabulary entry, labels, and whitelisted answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.text import prettify


def browsable(groups: DataFrame) -> DataFrame:
    """Own definition: not hidden."""
    return groups.filter(~F.coalesce("hidden", F.lit(False)))


def browsable_families(families: DataFrame) -> DataFrame:
    """Own definition: not for support groups only."""
    return families.filter(~F.coalesce("support_only", F.lit(False)))


def counts_by_entry(rows: DataFrame, entries: Column) -> DataFrame:
    """id, n: how often each entry stands in the arrays; an entry that a row lists twice counts twice."""
    return rows.select(F.explode(entries).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def counts_with_vocabulary(rows: DataFrame, entries: Column, vocabulary: DataFrame) -> DataFrame:
    """id, label, n: all of vocabulary(id, label), with 0 where nothing is listed, then unknown ids under prettified labels.

    sort_ord: the vocabulary's own order (its sort_ord column), unknown ids after it."""
    n = counts_by_entry(rows, entries)
    out = vocabulary.select("id", "label", "sort_ord").join(n, "id", "full_outer")
    return out.select("id", F.coalesce("label", prettify(F.col("id"))).alias("label"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sort_ord", F.lit(2**31 - 1)).alias("sort_ord"))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: the distinct keys that only one side has.  Empty for equal sets."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def uniqueness(rows: DataFrame, key: str) -> DataFrame:
    """One row: n, n_distinct, is_unique."""
    return rows.agg(F.count(key).alias("n"), F.countDistinct(key).alias("n_distinct")).withColumn("is_unique", F.col("n") == F.col("n_distinct"))


def dependency_violations(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The keys with more than one value, and how many."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n_values")).filter("n_values > 1")


def sanitised(answers: DataFrame, column: str, vocabulary: DataFrame, most: int = 100_000) -> DataFrame:
    """answers with only known ids left in the array column.  The vocabulary is a fixed list, checked to have `most` rows at most, and one row once gathered."""
    if vocabulary.limit(most + 1).count() > most:
        raise ValueError(f"a vocabulary of more than {most} entries")
    known = vocabulary.agg(F.collect_set("id").alias("_known"))
    return answers.join(F.broadcast(known)).withColumn(column, F.array_intersect(column, "_known")).drop("_known")


def fill_down(rows: DataFrame, partition: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with the last value that is not null so far: a heading carried down to the rows below it."""
    from pyspark.sql import Window

    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def cheat_sheet(families: DataFrame) -> DataFrame:
    """id, line: a family's tags on one line, in order, with a note where it is for support groups only.  families: id, support_only, tags."""
    note = F.when(F.coalesce("support_only", F.lit(False)), F.lit(" (support groups only)")).otherwise("")
    return families.select("id", F.concat(F.lit("- **"), "id", F.lit("**"), note, F.lit(": "), F.array_join("tags", ", ")).alias("line"))


def browse_config(groups: DataFrame, vocabulary: DataFrame, built: str) -> DataFrame:
    """One row for the browse page: its data version, the number of groups shown, labels of places (a map), and ids of families in order."""
    n = browsable(groups).agg(F.count("*").alias("n_groups"))
    labels = vocabulary.filter("vocabulary = 'neighborhoods' AND label IS NOT NULL").agg(F.map_from_entries(F.collect_set(F.struct("id", "label"))).alias("places"))
    families = browsable_families(vocabulary.filter("list = 'families'")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_ord", "id"))), lambda x: x["id"]).alias("families"))
    return n.join(F.broadcast(labels)).join(F.broadcast(families)).withColumn("version", F.lit(built))  # three single rows


def is_known(rows: DataFrame, column: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """rows with a flag: whether the column's value is an id of the vocabulary."""
    known = vocabulary.select(F.col("id").alias("_id")).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, F.col(column) == F.col("_id"), "left").withColumn(name, F.coalesce("_known", F.lit(False))).drop("_id", "_known")
