"""Removal and privacy: block lists, field suppression, projections that may leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.functions.urls import host
from mosaiq.operators.columns import fresh

#: Distinct field paths that rules may name.
MOST_FIELDS = 1000


def block(rows: DataFrame, blocked: DataFrame, column: Column, name: str) -> DataFrame:
    """rows whose value is not in blocked(name).  A null value is never blocked."""
    key, = fresh(rows, f"_{name}")
    return rows.withColumn(key, column).join(blocked.select(F.col(name).alias(key)), key, "left_anti").select(*rows.columns)


def block_hosts(rows: DataFrame, domains: DataFrame, website: Column) -> DataFrame:
    """rows whose website's host is not listed; hosts are compared in lower case and without www on both sides."""
    return block(rows, domains.select(F.coalesce(host(F.trim("domain")), F.lower(F.trim("domain"))).alias("domain")), host(website), "domain")


def remove_leads(leads: DataFrame, listed: DataFrame, eins: DataFrame, domains: DataFrame, ein: Column | None = None) -> DataFrame:
    """leads that no list names: by lead id, by EIN, by the host of their website.  This goes before leads are merged into groups, so that a group keeps its other leads."""
    out = block(leads, listed, F.col("lead_id"), "lead")
    out = block(out, eins, F.col("ein") if ein is None else ein, "ein")
    return block_hosts(out, domains, F.col("website"))


def remove_groups(groups: DataFrame, ids: DataFrame, eins: DataFrame, domains: DataFrame) -> DataFrame:
    """groups that no list names: by id, by EIN, by the host of their website."""
    out = block(groups, ids, F.col("id"), "id")
    return block_hosts(block(out, eins, F.col("ein"), "ein"), domains, F.col("contacts.website"))


def apply_blocklist(groups: DataFrame, ids: DataFrame, leads: DataFrame, eins: DataFrame, domains: DataFrame) -> DataFrame:
    """groups that no list names: by id, by any of their leads, by EIN, by the host of their website.

    For groups that come without their leads' rows.  Where leads are at hand, remove_leads before the merge keeps the rest of a group."""
    out = remove_groups(groups, ids, eins, domains)
    by_lead = out.select("id", F.explode("leads").alias("lead")).join(leads, "lead", "left_semi").select("id")
    return out.join(by_lead, "id", "left_anti").select(*groups.columns)


# ---- field suppression ----------------------------------------------------------------------------

def _child(kind: T.DataType, step: str, path: str) -> T.DataType:
    if isinstance(kind, T.StructType) and step in kind.names:
        return kind[step].dataType
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return kind.valueType
    raise ValueError(f"there is no field {path}")


def _values(x: Column, kind: T.DataType, steps: list[str], path: str) -> Column:
    """All values at a path, as an array of strings."""
    if isinstance(kind, T.ArrayType):
        inner = F.transform(x, lambda e: _values(e, kind.elementType, steps, path))
        return F.coalesce(F.flatten(F.filter(inner, lambda e: e.isNotNull())), F.array().cast("array<string>"))
    if not steps:
        if isinstance(kind, (T.StructType, T.MapType)):
            raise ValueError(f"{path} holds further fields; name one of them")
        return F.when(x.isNotNull(), F.array(x.cast("string"))).otherwise(F.array().cast("array<string>"))
    inside = _child(kind, steps[0], path)
    return _values(F.try_element_at(x, F.lit(steps[0])) if isinstance(kind, T.MapType) else x[steps[0]], inside, steps[1:], path)


def _without(x: Column, kind: T.DataType, steps: list[str], gone: Column) -> Column:
    """x with the values at the path that are in gone taken out: null in a field, no longer there in a list or map."""
    hit = lambda v: F.coalesce(F.array_contains(gone, v.cast("string")), F.lit(False))
    if isinstance(kind, T.ArrayType):
        plain = not steps and not isinstance(kind.elementType, T.ArrayType)
        return F.filter(x, lambda e: ~hit(e)) if plain else F.transform(x, lambda e: _without(e, kind.elementType, steps, gone))
    if not steps:
        return F.when(~hit(x), x)
    if isinstance(kind, T.MapType):
        if len(steps) == 1 and not isinstance(kind.valueType, T.ArrayType):
            return F.map_filter(x, lambda k, v: ~((k == steps[0]) & hit(v)))
        return F.transform_values(x, lambda k, v: F.when(k == steps[0], _without(v, kind.valueType, steps[1:], gone)).otherwise(v))
    return F.when(x.isNotNull(), x.withField(f"`{steps[0]}`", _without(x[steps[0]], kind[steps[0]].dataType, steps[1:], gone)))


def suppress_fields(rows: DataFrame, rules: DataFrame, id_: str, fields: list[str] | None = None) -> DataFrame:
    """rows without the values that rules(group, field, value) name; group `*` means every row.

    A field is a dotted path through structs, lists (all their entries) and maps (the step is a key): `contacts.phone`,
    `locations.address`, `extra.email`.  A suppressed value becomes null, in a list or map it is taken out.  A path that rows do not have, or
    that ends at a struct, is an error, so no rule is passed over in silence.  fields: the paths, where they are known; else they are read from the rules.  Values are
    compared as strings; rules without group, field or value do nothing.

    Values that stand at the paths meet the rules by two equi-joins, on (field, value) and on (field, value, id); what is hit is gathered by id and
    joined back, so rules may be as many as rows, and a row gets no more than it has values itself."""
    rules = rules.select(*[F.col(c).cast("string").alias(c) for c in ("group", "field", "value")]).filter("group IS NOT NULL AND field IS NOT NULL AND value IS NOT NULL").distinct()
    if fields is None:
        fields = sorted(r.field for r in rules.select("field").distinct().limit(MOST_FIELDS + 1).collect())
        if len(fields) > MOST_FIELDS:
            raise ValueError(f"rules name more than {MOST_FIELDS} fields")
    if not fields:
        return rows
    paths = {f: ([f], []) if f in rows.columns else (f.split(".")[:1], f.split(".")[1:]) for f in fields}
    for f, (top, _) in paths.items():
        if top[0] not in rows.columns:
            raise ValueError(f"there is no field {f}")
    column = lambda name: F.col(f"`{name}`")
    named = lambda values, f: F.transform(values, lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))
    found = [named(_values(column(top[0]), rows.schema[top[0]].dataType, steps, f), f) for f, (top, steps) in paths.items()]
    held = rows.select(column(id_).cast("string").alias("of"), F.explode(F.array_distinct(F.concat(*found))).alias("held")).select("of", "held.*").distinct()
    everywhere = held.join(rules.filter("group = '*'").drop("group"), ["field", "value"], "left_semi")
    own = held.join(rules.filter("group <> '*'").withColumnRenamed("group", "of"), ["of", "field", "value"], "left_semi")
    hits_name, of = fresh(rows, "hits", "of")
    hits = everywhere.unionByName(own).groupBy("of").agg(F.collect_set(F.struct("field", "value")).alias(hits_name)).withColumnRenamed("of", of)
    out = rows.join(hits, column(id_).cast("string").eqNullSafe(F.col(of)), "left")
    of_field = lambda f: F.transform(F.filter(hits_name, lambda h: h["field"] == f), lambda h: h["value"])
    for f, (top, steps) in paths.items():
        gone = of_field(f)
        x = column(top[0])
        out = out.withColumn(top[0], F.when(F.col(hits_name).isNull(), x).otherwise(_without(x, rows.schema[top[0]].dataType, steps, gone)))
    return out.select(*[column(c) for c in rows.columns])


def shareable(rows: DataFrame) -> DataFrame:
    """What a shared link may be made of: the id alone."""
    return rows.select("id")


def hide(groups: DataFrame, reasons: DataFrame) -> DataFrame:
    """groups with hidden and hidden_reason set where reasons(id, reason) has them; what was hidden before stays so."""
    why, = fresh(groups, "_why")
    reasons = reasons.groupBy("id").agg(F.min("reason").alias(why))
    out = groups.join(reasons, "id", "left").withColumn("hidden_reason", F.coalesce("hidden_reason", why)).withColumn("hidden", F.coalesce(F.col("hidden") | F.col(why).isNotNull(), F.col(why).isNotNull()))
    return out.select(*groups.columns)
