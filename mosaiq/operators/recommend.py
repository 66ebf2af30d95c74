"""Recommending: ranked picks, capped variety, relaxed constraints, cards that differ.

The rules of the picks are this library's own; weights, caps and counts are parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.columns import cut, fresh
from mosaiq.operators.similarity import LISTS, most_alike, similarity


def top_k(rows: DataFrame, score: Column, k: int, tie: str = "id") -> DataFrame:
    """The k best rows: each partition keeps k, then one task merges those."""
    return rows.orderBy(score.desc(), F.col(tie)).limit(k)


def top_k_per(rows: DataFrame, key: str, score: Column, k: int, tie: str = "id") -> DataFrame:
    """The k best rows of each key, with their rank.  Spark keeps k a key on each partition before it shuffles."""
    if "rank" in rows.columns:
        raise ValueError("rows already has a column rank")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(score.desc(), F.col(tie)))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def page(rows: DataFrame, score: Column, first: int, count: int, tie: str = "id") -> DataFrame:
    """Ranks first .. first + count - 1 of all rows: what comes after the results already shown."""
    top = top_k(rows, score, first + count - 1, tie)
    rank = F.row_number().over(Window.orderBy(score.desc(), F.col(tie)))  # over at most first + count - 1 rows
    return top.withColumn("rank", rank).filter(F.col("rank") >= first)


def replacement(rows: DataFrame, score: Column, shown: DataFrame, tie: str = "id") -> DataFrame:
    """The best row that is not shown yet."""
    return top_k(rows.join(shown.select(tie), tie, "left_anti"), score, 1, tie)


def capped(rows: DataFrame, key: str, score: Column, cap: int, k: int, tie: str = "id") -> DataFrame:
    """The k best rows with at most `cap` of a key."""
    nth, = fresh(rows, "nth")
    own = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(score.desc(), F.col(tie)))).filter(F.col(nth) <= cap)
    return top_k(own, score, k, tie).drop(nth)


def relaxed(rows: DataFrame, constraints: list[Column]) -> DataFrame:
    """rows that pass the strictest level that any row passes, with the level: 0 keeps all constraints, 1 drops the last, and so on."""
    n = len(constraints)
    ok = [reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in constraints[:n - i]), F.lit(True)) for i in range(n + 1)]
    if "level" in rows.columns:
        raise ValueError("rows already has a column level")
    level = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(ok)])
    levelled, (best,) = rows.withColumn("level", level), fresh(rows, "best")
    return levelled.join(F.broadcast(levelled.agg(F.min("level").alias(best))), F.col("level") == F.col(best)).drop(best)


def axes_of(axes: dict[str, Column]) -> Column:
    """The axes on which a pick stretches, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in axes.items()]))


def with_newcomers(score: Column, friendliness: Column, weight: float, best: int = 5) -> Column:
    """score and friendliness to newcomers (1 to `best`) as a weighted mean; where it is not known, score alone."""
    known = friendliness.between(1, best)
    return F.when(known, score * (1 - weight) + (friendliness - 1) / (best - 1) * weight).otherwise(score)


def only_axis(axes: dict[str, Column]) -> Column:
    """The one axis on which a pick stretches; null if there is none or several."""
    names = axes_of(axes)
    return F.when(F.size(names) == 1, F.get(names, 0))


def tier(score: Column, bounds: list[float]) -> Column:
    """0 for the best tier: the number of bounds above the score."""
    return sum((F.when(score < b, 1).otherwise(0) for b in bounds), F.lit(0))


#: Scores that are equal to so many digits are equal.
DIGITS = 9


def cards_that_differ(pool: DataFrame, k: int) -> list:
    """Ids of k cards, each the one least like those before it; the first is the first by id, as is the first of equals.

    The choice is sequential.  Each row keeps how alike it is to the chosen card that it is most alike, so a round compares the pool with the newest card
    alone; that table is written each round, and one id goes through the driver.  Rows without an id are not chosen; of rows that repeat one, any is."""
    features = [*LISTS, "kind", "size", "commitment"]
    cards = cut(pool.filter("id IS NOT NULL").select("id", F.struct(*features).alias("a")).dropDuplicates(["id"]).withColumn("most", F.lit(0.0)))
    chosen = [r[0] for r in cards.agg(F.min("id")).collect() if r[0] is not None]
    while chosen and len(chosen) < k:
        newest = F.broadcast(cards.filter(F.col("id") == chosen[-1]).select(F.col("id").alias("newest"), F.col("a").alias("b")))  # one row
        alike = F.round(similarity("a", "b"), DIGITS)
        cards = cut(cards.join(newest, F.col("id") != F.col("newest")).select("id", "a", F.greatest("most", alike).alias("most")))
        best = cards.agg(F.min_by("id", F.struct("most", "id")).alias("id")).first().id
        if best is None:
            break
        chosen.append(best)
    return chosen[:k]


def follow_ups(pool: DataFrame, liked: DataFrame, shown: DataFrame, k: int, cap: int = 2) -> DataFrame:
    """id, kind, score of k groups to ask about next: the most alike to any liked one, none shown or liked before, `cap` of a kind at most."""
    seen = shown.select("id").unionByName(liked.select("id"))
    rest = pool.join(seen, "id", "left_anti")
    scored = most_alike(rest, liked).join(rest.select("id", "kind"), "id").withColumn("score", F.round("score", DIGITS))
    return capped(scored, "kind", F.col("score"), cap, k).select("id", "kind", "score")
