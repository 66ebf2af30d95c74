"""The registry of sources and the harvesters that read them.

A harvester is a function of (spark, path) that returns leads.  Listings are small files that a person keeps or a
crawler fetched: they are parsed by Spark expressions, so any number of them is read in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.schema import LEAD, SOURCE
from mosaiq.sources import listings, tables

Harvester = Callable[[SparkSession, str], DataFrame]

#: Sources that feed dimensions, not leads.
REFERENCE = {"planning_districts"}

HARVESTERS: dict[str, Harvester] = {
    **{name: tables.geo_features(name) for name in ("city_rco", "city_rco_points", "city_friends", "city_nac", "city_gardens", "city_libraries", "city_rec", "city_senior")},
    "irs_bmf": tables.organisations("irs_bmf", tables.BMF, header=True, aka=("SORT_NAME",)),
    "irs_990n": tables.organisations("irs_990n", tables.POSTCARD, header=False, sep="|", aka=("DBA_1", "DBA_2", "DBA_3")),
    "penn_clubs": tables.campus_clubs,
    "engage_drexel": tables.json_rows("engage_drexel"),
    "engage_ccp": tables.json_rows("engage_ccp"),
    "cultural_fund": listings.grantee_cards,
    "mummers": listings.parade_lineup,
    "nss_grottos": listings.club_cards,
    "manual_seeds": tables.seeds,
    "city_volunteer_portal": tables.json_rows("city_volunteer_portal"),
    "city_volunteer_pages": tables.json_rows("city_volunteer_pages"),
    "city_programs": tables.programs,
}


def sources(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Registry rows in the registry's columns: missing ones are null, others are left out."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in SOURCE.fields) for r in rows], SOURCE)


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """The registry file (YAML); no file, or an empty one, gives no rows."""
    return sources(spark, tables.read_yaml_list(spark, path, missing_ok=True))


def source(registry: DataFrame, id_: str) -> DataFrame:
    """The first row with the id, or none."""
    return registry.filter(F.col("id") == id_).limit(1)


def registry_gaps(registry: DataFrame, spark: SparkSession) -> DataFrame:
    """id, side: ids that only the registry (left) or only the harvesters and reference sources (right) have."""
    from mosaiq.operators.browse import key_differences

    known = spark.createDataFrame([(k,) for k in sorted(HARVESTERS.keys() | REFERENCE)], "id string")
    return key_differences(registry.select("id"), known, "id")


def harvest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The leads of all sources in paths (id to path); reference sources give none."""
    frames = [HARVESTERS[k](spark, p) for k, p in sorted(paths.items()) if k not in REFERENCE]
    return reduce(lambda a, b: a.unionByName(b), frames, spark.createDataFrame([], LEAD))
