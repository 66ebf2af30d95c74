"""Merging leads into records: identity, unions of values, provenance, and ids for new records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.functions.text import id_slug
from mosaiq.operators.columns import cut, fresh, numbered


def consolidate(leads: DataFrame, key: str = "ein") -> DataFrame:
    """One row per identity: key, leads (sorted ids), locations (union as given, streets not rewritten), sources (provenance in order of source).

    Rows with a null key stay apart, a record each.  leads: key, lead_id, source, locations (array of struct), provenance (struct)."""
    who = F.coalesce(F.concat(F.lit("k:"), F.col(key)), F.concat(F.lit("l:"), F.col("lead_id")))
    one, = fresh(leads, "_who")
    return (leads.withColumn(one, who).groupBy(one).agg(
        F.first(key).alias(key), F.sort_array(F.collect_set("lead_id")).alias("leads"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source", "lead_id", "locations"))), lambda x: x["locations"]))).alias("locations"),
        F.transform(F.array_sort(F.collect_list(F.struct("source", "lead_id", "provenance"))), lambda x: x["provenance"]).alias("sources")).drop(one))


def consolidated_text(rows: DataFrame, key: str, value: Column, sep: str = ",") -> DataFrame:
    """key, values (the distinct ones, sorted and joined), n_rows."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(value)), sep).alias("values"), F.count("*").alias("n_rows"))


def provenance_counts(records: DataFrame) -> DataFrame:
    """field, n: how many provenance entries credit each field of a record."""
    return records.select(F.explode("sources").alias("s")).select(F.explode("s.fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def _nth_free(pending: DataFrame, taken: DataFrame) -> DataFrame:
    """pending(base, k) with `number`: the k-th number from 1 that taken(base, t) leaves free for the base.

    Taken numbers t_1 < t_2 < ... leave t_j - j free ones before t_j, so the answer is k and as many more as there are j with t_j - j < k.
    Successive numbers have the same t_j - j; a base has as many rows here as it has stretches of them."""
    t = numbered(taken.distinct(), ["base"], F.col("t"), "j").groupBy("base", (F.col("t") - F.col("j")).alias("free")).agg(F.max("j").alias("j"))
    t = t.withColumn("until", F.lead("free").over(Window.partitionBy("base").orderBy("free"))).withColumnRenamed("base", "of")
    meets = (F.col("base") == F.col("of")) & (F.col("k") > F.col("free")) & (F.col("until").isNull() | (F.col("k") <= F.col("until")))
    return pending.join(t, meets, "left").withColumn("number", F.col("k") + F.coalesce("j", F.lit(0))).drop("of", "free", "j", "until")


def _taken_numbers(ids: DataFrame, bases: DataFrame) -> DataFrame:
    """(base, t): the numbers that ids(id) take of the bases(base).  `x` takes the first number of x, `x-7` the seventh."""
    number = F.regexp_extract("id", "^(.+)-([1-9][0-9]{0,8})$", 2)
    later = ids.filter(number != "").select(F.regexp_extract("id", "^(.+)-([1-9][0-9]{0,8})$", 1).alias("base"), number.cast("long").alias("t")).filter("t > 1")
    return ids.select(F.col("id").alias("base"), F.lit(1).cast("long").alias("t")).unionByName(later).join(bases.distinct(), "base", "left_semi")


def new_ids(records: DataFrame, name: Column, zip_: Column, order: Column, known: DataFrame | None = None) -> DataFrame:
    """records without an id get one from their name: the slug; if that is taken, slug-ZIP, and then slug-ZIP-2 and so on, the first that is free.

    Existing ids never change, and none is given twice, neither one of records nor one of known(id), ids that are taken elsewhere.  In order of `order`, the
    first of a slug gets the slug if it is free, the others get the free numbers of their slug and ZIP.  Where different slugs and ZIPs spell the same id, the least in
    that order keeps it and the others choose again.  Rows of one name and ZIP are numbered in chunks (see columns.numbered), so a name that very many rows have is
    no single task.  A null ZIP is `x`, a null or empty name `group`."""
    given = F.coalesce(F.nullif(id_slug(name), F.lit("")), F.lit("group"))
    new = records.filter("id IS NULL").select(F.struct(*records.columns).alias("record"), given.alias("slug"), F.coalesce(zip_, F.lit("x")).alias("zip"), order.alias("row"))
    taken = records.filter("id IS NOT NULL").select("id")
    if known is not None:
        taken = taken.unionByName(known.select("id").filter("id IS NOT NULL"))
    new, taken = numbered(cut(new), ["slug"], F.col("row"), "rank"), cut(taken)
    free = new.filter("rank = 1").select(F.col("slug").alias("id")).join(taken, "id", "left_anti")
    new = cut(new.join(free, (F.col("slug") == F.col("id")) & (F.col("rank") == 1), "left"))
    done = [new.filter("id IS NOT NULL").select("record", "id")]
    taken = taken.unionByName(done[0].select("id"))
    pending = new.filter("id IS NULL").select("record", "row", F.concat_ws("-", "slug", "zip").alias("base"))
    while True:
        asked = _nth_free(numbered(pending, ["base"], F.col("row"), "k"), _taken_numbers(taken, pending.select("base")))
        asked = asked.withColumn("id", F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("number").cast("string"))))
        clash = asked.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("row", "base")).alias("first")).filter("n > 1").select(F.col("id").alias("clash"), "first")
        asked = cut(asked.join(clash, F.col("id") == F.col("clash"), "left"))
        keeps = F.col("clash").isNull() | (F.struct("row", "base") == F.col("first"))
        done.append(asked.filter(keeps).select("record", "id"))
        pending = asked.filter(~keeps).select("record", "row", "base")
        if pending.isEmpty():
            break
        taken = taken.unionByName(done[-1].select("id"))
    out = records.filter("id IS NOT NULL")
    for part in done:
        out = out.unionByName(part.select(*[F.col("id") if c == "id" else F.col("record")[c].alias(c) for c in records.columns]))
    return out


# ---- harvests ----------------------------------------------------------------------------------------

def content_hash(rows: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """A digest of all columns of a row but some; maps count whatever the order of their keys."""
    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.array_sort(F.map_entries(c)).alias(f.name) if isinstance(f.dataType, T.MapType) else c

    return F.sha2(F.to_json(F.struct(*[plain(f) for f in rows.schema if f.name not in but]), {"ignoreNullFields": "false"}), 256)


def merge_harvest(held: DataFrame, found: DataFrame, seen: str = "seen_at") -> DataFrame:
    """The leads after a harvest, with `change`: new, changed, same, gone (its source was harvested, the lead was not found) or kept (its source was not harvested).

    held and found have a lead's columns; a lead is told by lead_id, of rows that repeat one the least by content counts.  What was found replaces what was
    held, but sightings (`seen`) are gathered.  Lists of what is removed go on both sides first (suppress.remove_leads), so nothing that is removed comes back."""
    columns = held.columns

    def single(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.select(*columns).withColumn("content", content_hash(rows.select(*columns), (seen,)))
        first = rows.groupBy("lead_id").agg(F.min_by(F.struct(*columns), F.struct("content", content_hash(rows.select(seen)))).alias(side), F.min("content").alias(f"{side}_content"))
        return first.withColumnRenamed("lead_id", f"{side}_id")

    old, new = single(held, "old"), single(found, "new")
    harvested = found.select(F.col("source").alias("harvested")).distinct()
    both = old.join(new, F.col("old_id") == F.col("new_id"), "full_outer")
    both = both.join(harvested, F.col("old.source") == F.col("harvested"), "left")
    change = (F.when(F.col("old_content").isNull(), "new").when(F.col("new_content") == F.col("old_content"), "same").when(F.col("new_content").isNotNull(), "changed")
              .when(F.col("harvested").isNotNull(), "gone").otherwise("kept"))
    there = lambda side: F.coalesce(F.col(f"{side}.{seen}"), F.array().cast(held.schema[seen].dataType))
    fields = [F.array_distinct(F.concat(there("old"), there("new"))).alias(c) if c == seen else F.when(F.col("new_content").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns]
    return both.select(*fields, change.alias("change"))
