"""The shape of a lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.schema import LEAD


def as_leads(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """rows as leads of a source; columns that are not given are null or empty, city is not guessed."""
    def value(name: str) -> Column:
        kind = LEAD[name].dataType
        if name == "source":
            return F.lit(source)
        if name == "lead_id":
            return F.concat(F.lit(f"{source}:"), columns["native_id"].cast("string"))
        if name in columns:
            return columns[name].cast(kind)
        empty = {"aka": F.array(), "tags_hint": F.array(), "seen_at": F.array(), "extra": F.create_map()}.get(name, F.lit(None))
        return empty.cast(kind)

    return rows.select(*[value(f.name).alias(f.name) for f in LEAD.fields])


def with_note(extra: Column, note: Column) -> Column:
    """extra with a note, if there is one."""
    extra = F.coalesce(extra, F.create_map().cast("map<string, string>"))
    added = F.map_concat(F.map_filter(extra, lambda k, _: k != "note"), F.create_map(F.lit("note"), note))
    return F.when(F.coalesce(note, F.lit("")) != "", added).otherwise(extra)


#: Entries of `extra` that are true or false.
FLAGS = ("philadelphia_area",)


def typed_extra(extra: Column, flags: tuple[str, ...] = FLAGS) -> Column:
    """extra as a VARIANT object: the flags are booleans, everything else stays text."""
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[|\]$", "")
    pairs = F.transform(F.map_entries(extra), lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.when(e["key"].isin(*flags) & e["value"].isin("true", "false"), e["value"]).otherwise(F.coalesce(quoted(e["value"]), F.lit("null")))))
    return F.parse_json(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
