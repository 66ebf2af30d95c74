"""Queries of removal, of ids for new records and of harvests."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.operators import merge, suppress
from mosaiq.plans.base import query, table


@query("""WITH o AS (SELECT o_custkey, string_agg(CASE WHEN o_orderpriority = '1-URGENT' OR (o_custkey % 7 = 0 AND o_orderpriority = '2-HIGH') THEN '-' ELSE o_orderpriority END, ',' ORDER BY o_orderkey) AS addresses FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN c_nationkey = 3 OR (c_custkey % 7 = 0 AND c_nationkey % 2 = 0) THEN NULL ELSE '555-' || c_nationkey END AS phone, lower(c_mktsegment) || '.org' AS website,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'tag' ELSE lower(c_mktsegment) || ',tag' END AS social, addresses, CASE WHEN c_nationkey = 5 THEN 0 ELSE 1 END AS n_extra
FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def suppress_nested_fields(spark, sf_dir):
    """Rules on fields of structs, on fields of lists of structs, on entries of lists and on keys of maps; for all rows and for one."""
    c = table(spark, sf_dir, "customer")
    places = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("address")))).alias("locations"))
    phone, tag = F.concat(F.lit("555-"), F.col("c_nationkey").cast("string")), F.lower("c_mktsegment")
    contacts = F.struct(phone.alias("phone"), F.concat(tag, F.lit(".org")).alias("website"), F.array(tag, F.lit("tag")).alias("social"))
    groups = c.join(places, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", contacts.alias("contacts"), "locations", F.create_map(F.lit("email"), phone).alias("extra"))
    everywhere = spark.createDataFrame([("*", "contacts.phone", "555-3"), ("*", "locations.address", "1-URGENT"), ("*", "contacts.social", "building"), ("*", "extra.email", "555-5")], "group string, field string, value string")
    sevens = c.filter("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("group"), "c_nationkey")
    own = sevens.select("group", F.lit("locations.address"), F.lit("2-HIGH")).unionByName(sevens.filter("c_nationkey % 2 = 0").select("group", F.lit("contacts.phone").alias("locations.address"), F.concat(F.lit("555-"), F.col("c_nationkey").cast("string")).alias("2-HIGH")))
    out = suppress.suppress_fields(groups, everywhere.union(own), "c_custkey")
    addresses = F.array_join(F.transform("locations", lambda x: x["address"]), ",", "-")
    return out.select("c_custkey", "contacts.phone", "contacts.website", F.array_join("contacts.social", ",").alias("social"), addresses.alias("addresses"), F.size("extra").alias("n_extra"))


_NAMES = "CASE WHEN c_custkey % 2 = 0 THEN 'Łódź & ' ELSE 'Ðà ﬁne ' END || c_mktsegment"


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'odz-and-' ELSE 'a-fine-' END || lower(c_mktsegment) AS slug, '191' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS zip FROM customer),
old AS (SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN slug WHEN c_custkey % 20 = 5 THEN slug || '-' || zip ELSE slug || '-' || zip || '-' || (2 + c_custkey // 20 % 5) END AS id FROM c WHERE c_custkey % 5 = 0),
taken AS (SELECT DISTINCT id FROM old),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY c_custkey) AS r FROM c WHERE c_custkey % 5 <> 0),
plain AS (SELECT c_custkey, slug AS id FROM n WHERE r = 1 AND slug NOT IN (SELECT id FROM taken)),
p AS (SELECT *, slug || '-' || zip AS base, row_number() OVER (PARTITION BY slug, zip ORDER BY c_custkey) AS k FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM plain)),
free AS (SELECT base, id, row_number() OVER (PARTITION BY base ORDER BY i) AS k FROM (
  SELECT base, i, CASE WHEN i = 1 THEN base ELSE base || '-' || i END AS id FROM (SELECT base, unnest(range(1, count(*) + 8)) AS i FROM p GROUP BY base)) WHERE id NOT IN (SELECT id FROM taken))
SELECT c_custkey, id FROM old UNION ALL SELECT c_custkey, id FROM plain UNION ALL SELECT c_custkey, free.id FROM p JOIN free USING (base, k)""")
def ids_beside_taken_ones(spark, sf_dir):
    """Ids for new records where slugs, slugs with ZIP and numbers of them are taken already; names with marks, ligatures and letters without a plain form."""
    c = table(spark, sf_dir, "customer")
    name = F.expr(_NAMES)
    zip_ = F.concat(F.lit("191"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    slug = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("odz-and-")).otherwise("a-fine-"), F.lower("c_mktsegment"))
    number = (2 + F.floor(F.col("c_custkey") / 20) % 5).cast("string")
    old = (F.when(F.col("c_custkey") % 20 == 0, slug).when(F.col("c_custkey") % 20 == 5, F.concat_ws("-", slug, zip_)).when(F.col("c_custkey") % 5 == 0, F.concat_ws("-", slug, zip_, number)))
    records = c.select(old.alias("id"), "c_custkey", name.alias("name"), zip_.alias("zip"))
    return merge.new_ids(records, F.col("name"), F.col("zip"), F.col("c_custkey")).select("c_custkey", "id")


_LISTS = "c_custkey % 11 <> 0 AND c_nationkey <> 7 AND c_mktsegment <> 'FURNITURE'"


@query(f"""WITH held AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0 AND {_LISTS}), found AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 AND {_LISTS})
SELECT 's' || coalesce(h.c_custkey, f.c_custkey) % 4 || ':' || coalesce(h.c_custkey, f.c_custkey) AS lead_id,
CASE WHEN h.c_custkey IS NULL THEN 'new' WHEN f.c_custkey IS NULL AND h.c_custkey % 4 = 0 THEN 'kept' WHEN f.c_custkey IS NULL THEN 'gone' WHEN f.c_nationkey = 2 THEN 'changed' ELSE 'same' END AS change,
CASE WHEN f.c_nationkey = 2 THEN f.c_name || ' Inc' ELSE coalesce(f.c_name, h.c_name) END AS name, CASE WHEN h.c_custkey IS NULL OR f.c_custkey IS NULL THEN 1 ELSE 2 END AS sightings
FROM held h FULL JOIN found f ON h.c_custkey = f.c_custkey""")
def harvest_after_removals(spark, sf_dir):
    """Two snapshots of leads merged, with leads, EINs and hosts on the lists removed from both."""
    c = table(spark, sf_dir, "customer")
    source = F.concat(F.lit("s"), (F.col("c_custkey") % 4).cast("string"))

    def leads(rows, date, name):
        return rows.select(F.concat_ws(":", source, F.col("c_custkey").cast("string")).alias("lead_id"), source.alias("source"), name.alias("name"), F.col("c_nationkey").cast("string").alias("ein"),
                           F.concat(F.lit("https://www."), "c_mktsegment", F.lit(".org/x")).alias("website"), F.array(F.struct(F.lit(date).alias("date"), F.lit("list").alias("note"))).alias("seen_at"))

    held = leads(c.filter("c_custkey % 3 <> 0"), "2026-09", F.col("c_name"))
    found = leads(c.filter("c_custkey % 5 <> 0 AND c_custkey % 4 <> 0"), "2026-10", F.when(F.col("c_nationkey") == 2, F.concat("c_name", F.lit(" Inc"))).otherwise(F.col("c_name")))
    listed = c.filter("c_custkey % 11 = 0").select(F.concat_ws(":", source, F.col("c_custkey").cast("string")).alias("lead"))
    eins, domains = spark.createDataFrame([("7",)], "ein string"), spark.createDataFrame([("WWW.Furniture.org",)], "domain string")
    held, found = (suppress.remove_leads(x, listed, eins, domains) for x in (held, found))
    return merge.merge_harvest(held, found).select("lead_id", "change", "name", F.size("seen_at").alias("sightings"))


@query("""SELECT ein, string_agg(lead_id, ',' ORDER BY lead_id) AS leads FROM (SELECT CAST(o_custkey AS VARCHAR) AS ein, 'o:' || o_orderkey AS lead_id FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 13 <> 0) GROUP BY ein""")
def groups_without_removed_leads(spark, sf_dir):
    """Removed leads go before the merge, and their groups keep the others."""
    o = table(spark, sf_dir, "orders")
    id_ = F.concat(F.lit("o:"), F.col("o_orderkey").cast("string"))
    leads = o.select(F.col("o_custkey").cast("string").alias("ein"), id_.alias("lead_id"), F.lit("o").alias("source"), F.lit(None).cast("string").alias("website"),
                     F.array(F.struct(F.col("o_orderpriority").alias("label"))).alias("locations"), F.struct(id_.alias("url"), F.array(F.lit("name")).alias("fields")).alias("provenance"))
    listed = o.filter("o_orderstatus = 'P'").select(id_.alias("lead"))
    eins = o.filter("o_custkey % 13 = 0").select(F.col("o_custkey").cast("string").alias("ein"))
    out = merge.consolidate(suppress.remove_leads(leads, listed, eins, spark.createDataFrame([], "domain string")))
    return out.select("ein", F.array_join("leads", ",").alias("leads"))
