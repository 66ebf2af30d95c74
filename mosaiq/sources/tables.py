"""Sources that come as tables or documents: CSV, JSON, GeoJSON, YAML, and the record corpus."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators.geo import as_point, as_polygons
from mosaiq.schema import GROUP, LEAD
from mosaiq.sources.leads import as_leads, with_note

CITY = "Philadelphia"
CLUBS_SITE = "https://pennclubs.com"

try:
    import yaml
except ImportError:  # YAML is an optional format
    yaml = None


def _yaml() -> Any:
    if yaml is None:
        raise RuntimeError("reading YAML needs the yaml package")

    class Texts(yaml.SafeLoader):
        """All scalars but null, true and false as text: EINs, ZIPs and dates must not become numbers, and `no` is a word."""

    Texts.yaml_implicit_resolvers = {}
    Texts.add_implicit_resolver("tag:yaml.org,2002:null", re.compile(r"^(?:~|null|)$"), ["~", "n", ""])
    Texts.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|false)$"), ["t", "f"])
    return lambda text: yaml.load(text, Loader=Texts)


def read_yaml_list(spark: SparkSession, path: str, missing_ok: bool = False) -> list[dict]:
    """The entries of one YAML list file, which is kept by hand and small.  Null is no entries; anything but a list is an error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        if missing_ok:
            return []
        raise FileNotFoundError(path)
    rows = spark.read.text(path, wholetext=True).collect()
    data = (_yaml()(rows[0].value) if rows else None) or []
    if not isinstance(data, list):
        raise ValueError(f"{path} must hold a YAML list of entries")
    return data


def parse_seeds(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Leads of hand-kept seeds.  id, name and source_url must be there; a default stands for a missing key, not for a null."""
    rows = []
    for e in entries:
        extra = {k: v if isinstance(v, str) else json.dumps(v) for k, v in (e.get("extra") or {}).items()}
        rows.append((e["id"], e["name"], e["source_url"], e.get("kind_hint", "other"), e.get("website"), e.get("city", CITY), e.get("aka", []), e.get("tags", []), e.get("note"), extra))
    df = spark.createDataFrame(rows, "id string, name string, source_url string, kind string, website string, city string, aka array<string>, tags array<string>, note string, extra map<string, string>")
    return as_leads(df, "manual_seeds", native_id=F.col("id"), name=F.col("name"), source_url=F.col("source_url"), kind_hint=F.col("kind"), website=F.col("website"),
                    city=F.col("city"), aka=F.col("aka"), tags_hint=F.col("tags"), extra=with_note(F.col("extra"), F.col("note")))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    return parse_seeds(spark, read_yaml_list(spark, path))


def campus_clubs(spark: SparkSession, path: str) -> DataFrame:
    """Leads of a campus directory: a JSON list of {code, name, subtitle, email, tags}.  A club without a code is left out."""
    schema = "code string, name string, subtitle string, email string, tags array<struct<id: long, name: string>>"
    clubs = spark.read.schema(schema).json(path, multiLine=True)
    return parse_clubs(clubs)


def parse_clubs(clubs: DataFrame) -> DataFrame:
    url = F.concat(F.lit(f"{CLUBS_SITE}/club/"), "code")
    return as_leads(clubs.filter("code IS NOT NULL"), "penn_clubs", native_id=F.col("code"), name=F.col("name"), source_url=url, kind_hint=F.lit("student_org"), city=F.lit(CITY),
                    tags_hint=F.coalesce(F.transform("tags", lambda t: t["name"]), F.array().cast("array<string>")), description=F.col("subtitle"), school=F.lit("penn"),
                    extra=F.map_filter(F.create_map(F.lit("directory_url"), url, F.lit("email"), F.col("email")), lambda _, v: v.isNotNull()))


def programs(spark: SparkSession, path: str) -> DataFrame:
    """Leads of the programs of a YAML file; its discontinued ones are not harvested."""
    rows = spark.read.text(path, wholetext=True).collect()  # one file, kept by hand
    entries = ((_yaml()(rows[0].value) if rows else None) or {}).get("programs") or []
    keys = ("name", "department", "url", "signup_url", "what", "who_can_join", "commitment", "training", "clearances", "season", "evidence_date", "notes")
    df = spark.createDataFrame([tuple(e.get(k) for k in keys) for e in entries], ", ".join(f"{k} string" for k in keys))
    from mosaiq.functions.text import slug

    extra = F.map_filter(F.create_map(*[x for k in keys[1:] if k not in ("url", "what") for x in (F.lit(k), F.col(k))]), lambda _, v: v.isNotNull())
    return as_leads(df, "city_programs", native_id=slug(F.col("name")), name=F.col("name"), source_url=F.col("url"), kind_hint=F.lit("program"), website=F.col("url"), city=F.lit(CITY),
                    description=F.col("what"), extra=extra)


def _text_map(columns: list[str]) -> Column:
    pairs = [x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string, string>")


def _first(columns: list[str], names: tuple[str, ...]) -> Column:
    by = {c.lower(): c for c in columns}
    found = [F.nullif(F.trim(F.col(f"`{by[n]}`").cast("string")), F.lit("")) for n in names if n in by]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


_IDS, _NAMES, _CITIES = ("ein", "objectid", "id", "code", "key"), ("name", "organization_name", "org_name", "title"), ("city",)


def _general(df: DataFrame, source: str) -> DataFrame:
    """Leads of a table whose layout only its header tells: id, name and city by their usual columns, all columns in extra."""
    c = df.columns
    return as_leads(df, source, native_id=_first(c, _IDS), name=_first(c, _NAMES), city=_first(c, _CITIES), website=_first(c, ("website", "url")), extra=_text_map(c))


def csv_rows(source: str) -> Callable[[SparkSession, str], DataFrame]:
    """A CSV with a header; all columns are texts, so that leading zeros of EINs and ZIPs stay."""
    return lambda spark, path: _general(spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"'), source)


#: Fixed: columns of the tax office's public extract of exempt organisations, which has a header, and of its file of small organisations, which has none.
BMF = ("EIN NAME ICO STREET CITY STATE ZIP GROUP SUBSECTION AFFILIATION CLASSIFICATION RULING DEDUCTIBILITY FOUNDATION ACTIVITY ORGANIZATION STATUS TAX_PERIOD "
       "ASSET_CD INCOME_CD FILING_REQ_CD PF_FILING_REQ_CD ACCT_PD ASSET_AMT INCOME_AMT REVENUE_AMT NTEE_CD SORT_NAME").split()
POSTCARD = ("EIN TAX_YEAR NAME GROSS_RECEIPTS_UNDER TERMINATED PERIOD_BEGIN PERIOD_END WEBSITE OFFICER OFFICER_STREET OFFICER_STREET_2 OFFICER_CITY OFFICER_PROVINCE OFFICER_STATE OFFICER_ZIP OFFICER_COUNTRY "
            "STREET STREET_2 CITY PROVINCE STATE ZIP COUNTRY DBA_1 DBA_2 DBA_3").split()


def organisations(source: str, columns: list[str], header: bool, sep: str = ",", aka: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    """Leads of a file of organisations with the given columns, all of them texts; the id is the EIN with its leading zeros.

    With a header, columns may stand in any order and be missing, but for EIN and NAME, which are an error; without one they stand in the given order.
    Rows without an EIN are left out.  What a row has is kept in extra, but for the names of its officers and their addresses."""
    def read(spark: SparkSession, path: str) -> DataFrame:
        schema = None if header else ", ".join(f"{c} string" for c in columns)
        df = spark.read.csv(path, schema=schema, header=header, inferSchema=False, sep=sep, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        held = {c.strip().upper(): c for c in df.columns}
        if missing := {"EIN", "NAME"} - held.keys():
            raise ValueError(f"{source}: no column {sorted(missing)}")
        value = lambda c: F.nullif(F.trim(F.col(f"`{held[c]}`")), F.lit("")) if c in held else F.lit(None).cast("string")
        ein = F.lpad(F.regexp_replace(value("EIN"), "[^0-9]", ""), 9, "0")
        kept = [c for c in columns if c in held and not c.startswith("OFFICER")]
        extra = F.map_filter(F.create_map(*[x for c in kept for x in (F.lit(c), ein if c == "EIN" else value(c))]), lambda _, v: v.isNotNull())
        return as_leads(df.filter(value("EIN").rlike("[0-9]")), source, native_id=ein, name=value("NAME"), city=value("CITY"), website=value("WEBSITE"), aka=F.array_compact(F.array(*[value(c) for c in aka])), extra=extra)

    return read


def json_rows(source: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: _general(spark.read.json(path, multiLine=True, primitivesAsString=True), source)


def geo_layer(spark: SparkSession, path: str) -> DataFrame:
    """The features of a GeoJSON layer: properties (a map of texts), lat and lng (of a point, else the mean of an outline's corners) and polygons (of areas)."""
    feature = "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    features = spark.read.schema(f"features array<{feature}>").json(path, multiLine=True).select(F.explode("features").alias("f"))
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    at = as_point(kind, coordinates)
    return features.select(F.col("f.properties").alias("properties"), at["lat"].alias("lat"), at["lng"].alias("lng"), as_polygons(kind, coordinates).alias("polygons"))


def geo_features(source: str) -> Callable[[SparkSession, str], DataFrame]:
    """Leads of a GeoJSON layer: id, name and city by the usual names of properties; all properties, and the place, in extra."""
    def read(spark: SparkSession, path: str) -> DataFrame:
        def first(names: tuple[str, ...]) -> Column:
            held = F.map_filter("properties", lambda k, v: F.lower(k).isin(*names) & (F.trim(v) != ""))
            by = F.transform_keys(held, lambda k, _: F.lower(k))
            return F.coalesce(*[F.trim(F.try_element_at(by, F.lit(n))) for n in names])

        place = F.map_filter(F.create_map(F.lit("lat"), F.col("lat").cast("string"), F.lit("lng"), F.col("lng").cast("string")), lambda _, v: v.isNotNull())
        own = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string, string>")), lambda k, v: v.isNotNull() & ~k.isin("lat", "lng"))
        extra = F.map_concat(own, place)
        return as_leads(geo_layer(spark, path), source, native_id=first(_IDS), name=first(_NAMES), city=first(_CITIES), website=first(("website", "url")), extra=extra)

    return read


def records(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """The corpus of group records: one YAML file each, in folders by first letter, parsed where they are read.

    Folders are of very uneven size; Spark packs files into partitions by bytes, not by folder."""
    names = [f.name for f in GROUP.fields]
    load = _yaml()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            docs = [load(t) or {} for t in b["value"]]
            yield pd.DataFrame({"json": [json.dumps({k: d.get(k) for k in names}) for d in docs]})

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yaml").text(path, wholetext=True)
    files = files.repartition(parts) if parts else files
    return files.mapInPandas(parse, "json string").select(F.from_json("json", GROUP).alias("g")).select("g.*")


def groups_json(spark: SparkSession, path: str) -> DataFrame:
    """Groups of a published groups file {built, groups: [...]}, conformed: null lists become empty."""
    from pyspark.sql import types as T

    df = spark.read.schema(T.StructType([T.StructField("built", T.StringType()), T.StructField("groups", T.ArrayType(GROUP))])).json(path, multiLine=True)
    return conform(df.select(F.explode("groups").alias("g")).select("g.*"))


def conform(groups: DataFrame) -> DataFrame:
    """Null lists as empty ones, a missing hidden flag as false, district ids in kebab case."""
    out = []
    for f in GROUP.fields:
        c = F.col(f.name)
        if f.name == "locations":
            c = F.transform(c, lambda x: x.withField("planning_district", F.translate(x["planning_district"], "_", "-")))
        if f.dataType.typeName() == "array":
            c = F.coalesce(c, F.array().cast(f.dataType))
        out.append((F.coalesce(c, F.lit(False)) if f.name == "hidden" else c).alias(f.name))
    return groups.select(*out)


def write_site_data(groups: DataFrame, vocabulary: DataFrame, path: str, built: str) -> None:
    """The published data: groups as Parquet and as JSON lines, the vocabulary, and a manifest with count and stamp."""
    groups.write.mode("overwrite").parquet(f"{path}/groups.parquet")
    groups.write.mode("overwrite").json(f"{path}/groups")
    vocabulary.write.mode("overwrite").json(f"{path}/vocab")
    groups.agg(F.count("*").alias("groups"), F.lit(built).alias("built")).write.mode("overwrite").json(f"{path}/manifest")


def load_or_sample(spark: SparkSession, real: str, sample: str, schema=LEAD) -> DataFrame:
    """The real output if it is there, else the sample; neither is an error."""
    jvm = spark.sparkContext._jvm
    for path in (real, sample):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.read.schema(schema).json(path)
    raise FileNotFoundError(f"neither {real} nor {sample}")


VOCABULARY = "vocabulary string, list string, id string, label string, support_only boolean, tags array<string>, district string, sort_ord int"


def vocabularies(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of the vocabulary files (YAML) of a folder: vocabulary is the file's name, list the list's name within it.

    Entries are told by id or code; families keep their tags' ids, neighborhoods their district, ZIP maps give an entry per ZIP."""
    load = _yaml()

    def entries(name: str, items: list, listed: str) -> Iterator[tuple]:
        for k, e in enumerate(items):
            if isinstance(e, dict) and (e.get("id") or e.get("code")):
                tags = [t["id"] if isinstance(t, dict) else t for t in e.get("tags") or []]
                yield name, listed, e.get("id") or e.get("code"), e.get("label"), bool(e.get("support_only")), tags, e.get("district"), k

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for text, file in zip(b["value"], b["file"], strict=True):
                name, doc = file.rsplit("/", 1)[-1].removesuffix(".yaml"), load(text) or {}
                for listed, items in (doc.items() if isinstance(doc, dict) else [(name, doc)]):
                    if isinstance(items, list):
                        rows += entries(name, items, listed)
                    elif isinstance(items, dict):
                        rows += [(name, listed, z, None, False, [], v.get("district") if isinstance(v, dict) else v, k) for k, (z, v) in enumerate(items.items())]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in VOCABULARY.split(", ")])

    files = spark.read.option("pathGlobFilter", "*.yaml").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return files.mapInPandas(parse, VOCABULARY)


def write_quiz_config(vocabulary: DataFrame, path: str, built: str) -> None:
    """One JSON line: the stamp and each vocabulary's entries in order.  Vocabularies are small and fixed lists."""
    entry = F.struct("sort_ord", "id", "label", "tags")
    lists = vocabulary.groupBy(F.concat_ws(".", "vocabulary", "list").alias("name")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    lists.agg(F.lit(built).alias("built"), F.map_from_entries(F.collect_list(F.struct("name", "entries"))).alias("vocabularies")).coalesce(1).write.mode("overwrite").json(path)


def quiz_config(spark: SparkSession, path: str) -> DataFrame:
    """name, sort_ord, id, label, tags: the entries of a written quiz config, one row each."""
    entries = "array<struct<sort_ord: int, id: string, label: string, tags: array<string>>>"
    df = spark.read.schema(f"built string, vocabularies map<string, {entries}>").json(path)
    return df.select(F.explode("vocabularies").alias("name", "entries")).select("name", F.inline("entries"))
