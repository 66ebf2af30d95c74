"""How alike two groups are: a weighted mean over the features that both have."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.columns import cut

#: Weights of the features.
WEIGHTS = {"tags": 0.3, "families": 0.15, "roles": 0.1, "formats": 0.1, "motives": 0.1, "crowd": 0.05, "kind": 0.1, "size": 0.05, "commitment": 0.05}
LISTS = ("tags", "families", "roles", "formats", "motives", "crowd")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct entries; null (missing, not 0) if either list is null or empty."""
    missing = F.coalesce(F.size(a) <= 0, F.lit(True)) | F.coalesce(F.size(b) <= 0, F.lit(True))
    return F.when(~missing, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def equal_if_present(a: Column, b: Column) -> Column:
    """1 or 0; null if either side is null or empty text."""
    there = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(there, (a == b).cast("double"))


def weighted(features: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """The mean of the features that are not null, by weight; 0 if all are."""
    total = sum((F.when(v.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, v in features.items()), F.lit(0.0))
    score = sum((F.coalesce(v * weights[k], F.lit(0.0)) for k, v in features.items()), F.lit(0.0))
    return F.when(total > 0, score / total).otherwise(0.0)


def similarity(a: str, b: str, weights: Mapping[str, float] = WEIGHTS, alike: Callable[[Column, Column], Column] = jaccard) -> Column:
    """Of struct columns a and b: list features by Jaccard, kind by equality (two nulls are equal), size and commitment where both are there."""
    f = {k: alike(F.col(f"{a}.{k}"), F.col(f"{b}.{k}")) for k in LISTS}
    f["kind"] = F.col(f"{a}.kind").eqNullSafe(F.col(f"{b}.kind")).cast("double")
    f |= {k: equal_if_present(F.col(f"{a}.{k}"), F.col(f"{b}.{k}")) for k in ("size", "commitment")}
    return weighted(f, weights)


def most_alike(candidates: DataFrame, liked: DataFrame) -> DataFrame:
    """id, score: how alike each candidate is to the liked group that it is most alike."""
    return scores(candidates, liked).groupBy("id").agg(F.max("score").alias("score"))


def scores(candidates: DataFrame, liked: DataFrame, most_liked: int = 100, alike: Callable[[Column, Column], Column] = jaccard) -> DataFrame:
    """id, liked_id, score of every candidate with every liked group.

    The liked side is what one person picked; it is checked to be small and then broadcast, so the candidates stay where they are."""
    n = liked.limit(most_liked + 1).count()
    if n > most_liked:
        raise ValueError(f"more than {most_liked} liked groups")
    a = candidates.select("id", F.struct(*candidates.columns).alias("a"))
    b = liked.select(F.col("id").alias("liked_id"), F.struct(*liked.columns).alias("b"))
    return a.join(F.broadcast(b), F.col("id") != F.col("liked_id")).select("id", "liked_id", similarity("a", "b", alike=alike).alias("score"))


# ---- prepared groups: lists as bitmaps ----------------------------------------------------------------

#: Values of one list that a catalogue may have.
MOST_VALUES = 4096


def build_catalog(groups: DataFrame, lists: tuple[str, ...] = LISTS) -> DataFrame:
    """feature, value, pos: all values of the groups' lists, numbered within each list in order of the value.  At most MOST_VALUES a list, which is checked."""
    each = groups.select(F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("held")) for k in lists])).alias("f"))
    values = cut(each.select("f.feature", F.explode("f.held").alias("value")).filter("value IS NOT NULL").distinct())
    if many := [r.feature for r in values.groupBy("feature").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_VALUES).collect()]:
        raise ValueError(f"lists with more than {MOST_VALUES} values: {many}")
    return values.withColumn("pos", F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1)


def prepare(groups: DataFrame, catalog: DataFrame, lists: tuple[str, ...] = LISTS) -> DataFrame:
    """groups with each list as a struct of n (its distinct values) and bits (those of the catalogue, 64 to a number).  Ids must be unique and not null."""
    catalog = F.broadcast(catalog)  # at most MOST_VALUES rows a list
    words = {r.feature: r.pos // 64 + 1 for r in catalog.groupBy("feature").agg(F.max("pos").alias("pos")).collect()}
    each = groups.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.array_distinct(k).alias("held")) for k in lists])).alias("f")).select("id", "f.feature", F.explode("f.held").alias("value"))
    bit = F.expr("shiftleft(1L, pos % 64)")
    word = lambda k, w: F.coalesce(F.bit_or(F.when((F.col("feature") == k) & (F.floor(F.col("pos") / 64) == w), bit)), F.lit(0).cast("long"))
    bits = each.join(catalog, ["feature", "value"]).groupBy(F.col("id").alias("of")).agg(*[F.array(*[word(k, w) for w in range(words.get(k, 1))]).alias(f"bits_{k}") for k in lists])
    rest = [c for c in groups.columns if c not in lists]
    none = lambda k: F.array(*[F.lit(0).cast("long")] * words.get(k, 1))
    lists_ = [F.struct(F.coalesce(F.size(F.array_compact(F.array_distinct(k))), F.lit(0)).alias("n"), F.coalesce(f"bits_{k}", none(k)).alias("bits")).alias(k) for k in lists]
    return groups.join(bits, F.col("id") == F.col("of"), "left").select(*rest, *lists_)


def jaccard_of_bits(a: Column, b: Column) -> Column:
    """jaccard() of prepared lists; values that the catalogue lacks count as shared by none."""
    both = F.aggregate(F.zip_with(a["bits"], b["bits"], lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n)
    return F.when((a["n"] > 0) & (b["n"] > 0), both / (a["n"] + b["n"] - both))


def prepared_scores(candidates: DataFrame, liked: DataFrame, most_liked: int = 100) -> DataFrame:
    """scores() of prepared groups."""
    return scores(candidates, liked, most_liked, jaccard_of_bits)
