"""Suppression of nested fields, ids beside taken ones, harvests after removals: odd rows, and brute force."""

import random
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mosaiq.functions import text
from mosaiq.operators import columns, merge, suppress
from mosaiq.schema import GROUP, group_row

RULES = "group string, field string, value string"
SCHEMA = ("id string, hits string, of int, contacts struct<phone: string, social: array<string>, more: struct<age: int>>, "
          "locations array<struct<address: string, zip: string>>, extra map<string, string>, grid array<array<string>>")


def suppressed(spark, rows, rules, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = suppress.suppress_fields(df, spark.createDataFrame(rules, RULES), "id", **kw)
    assert out.schema == df.schema
    return sorted((r.asDict(True) for r in out.collect()), key=str)


def test_nested_fields_of_every_kind(spark):
    row = lambda i, **kw: {"id": i, "hits": "h", "of": 5, "contacts": {"phone": "1", "social": ["a", None, "b"], "more": {"age": 7}}, "locations": [{"address": "x", "zip": "1"}, None, {"address": "y", "zip": "1"}],
                           "extra": {"email": "e", "phone": "1"}, "grid": [["a", "b"], None, ["a"]]} | kw
    rows = [row("g"), row("k"), row("n", contacts=None, locations=None, extra=None, grid=None), row(None), row("e", locations=[], extra={}, contacts={"phone": None, "social": None, "more": None}), row("g")]
    assert suppressed(spark, rows, []) == sorted(rows, key=str)
    rules = [("g", "contacts.phone", "1"), ("*", "locations.address", "x"), ("k", "extra.email", "e"), ("*", "contacts.social", "b"), ("k", "contacts.more.age", "7"), ("g", "grid", "a"), ("g", "of", "5"), ("k", "hits", "other"),
             (None, "hits", "h"), ("*", "hits", None), ("zz", "contacts.phone", "1"), ("*", "locations.address", "x")]

    def want(r):
        r = {**r, "contacts": r["contacts"] and dict(r["contacts"]), "locations": r["locations"] and [x and dict(x) for x in r["locations"]]}
        for x in r["locations"] or []:
            if x and x["address"] == "x":
                x["address"] = None
        c = r["contacts"]
        if c and c["social"]:
            c["social"] = [s for s in c["social"] if s != "b"]
        if r["id"] == "g":
            c["phone"], r["of"] = None, None
            r["grid"] = [x and [s for s in x if s != "a"] for x in r["grid"]]
        if r["id"] == "k":
            c["more"] = {"age": None}
            r["extra"] = {"phone": "1"}
        return r

    assert suppressed(spark, rows, rules) == sorted(map(want, rows), key=str)


@pytest.mark.parametrize("field", ["nothing", "contacts.nothing", "contacts.phone.deeper", "contacts", "locations", "locations.nothing"])
def test_unknown_paths_are_errors(spark, field):
    with pytest.raises(ValueError, match=field.split(".")[0]):
        suppressed(spark, [("g", None, None, None, None, None, None)], [("*", field, "x")])


def test_group_records_lose_a_phone_and_an_address(spark):
    rows = [group_row(id=i, contacts={"phone": "555", "website": "x.org"}, locations=[{"address": "1 Elm", "zip": "1"}, {"address": "2 Oak"}]) for i in ("a", "b")]
    rules = [("a", "contacts.phone", "555"), ("*", "locations.address", "2 Oak")]
    out = {r.id: r for r in suppress.suppress_fields(spark.createDataFrame(rows, GROUP), spark.createDataFrame(rules, RULES), "id").collect()}
    assert [(out[i].contacts.phone, out[i].contacts.website, [x.address for x in out[i].locations]) for i in "ab"] == [(None, "x.org", ["1 Elm", None]), ("555", "x.org", ["1 Elm", None])]


@pytest.mark.parametrize("chunks", [1, 7])
def test_numbers_in_chunks(spark, chunks):
    rng = random.Random(chunks)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), k if k % 50 else None, "x") for k in rng.sample(range(10_000), 2000)]
    df = spark.createDataFrame(rows, "key string, n int, own string").repartition(5)
    got = columns.numbered(df, ["key"], F.col("n"), "number", chunks).collect()
    by = defaultdict(list)
    for r in got:
        by[r.key].append((r.number, r.n))
    for held in by.values():
        held.sort()
        assert [k for k, _ in held] == list(range(1, len(held) + 1))
        values = [(v is not None, v or 0) for _, v in held]
        assert values == sorted(values)
    assert len(got) == len(rows) and columns.numbered(df.limit(0), ["key"], F.col("n"), "number").count() == 0


def test_ascii_form_over_all_of_unicode(spark):
    chars = [chr(k) for k in range(0x110000) if not 0xD800 <= k <= 0xDFFF]
    parts = ["".join(chars[k:k + 500]) for k in range(0, len(chars), 500)] + ["Łódź", "İstanbul Çiğdem", "Nguyễn Thị Đặng", "é", "plain", "", "ﬃ ½ ™"]
    df = spark.createDataFrame(list(enumerate(parts)), "k int, x string").repartition(8)
    got = {r.k: r.v for r in df.select("k", text.ascii_form(F.col("x")).alias("v")).collect()}
    for k, x in enumerate(parts):
        assert got[k] == unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), k
    assert df.select(text.ascii_form(F.lit(None).cast("string")).alias("v")).first().v is None


def assigned(spark, rows, known=()):
    df = spark.createDataFrame(rows, "id string, name string, zip string, n int, slug string, base string, k int, number int, clash string, row int")
    out = merge.new_ids(df, F.col("name"), F.col("zip"), F.col("n"), spark.createDataFrame([(i,) for i in known], "id string") if known else None)
    assert out.columns == df.columns
    return {r.n: r.id for r in out.collect()}


def test_new_ids_meet_no_taken_one(spark):
    rest = ("s", "b", 1, 2, "c", 3)
    rows = [("foo", "Foo", "19107", 1, *rest), ("foo-19107", "x", "1", 2, *rest), (None, "Foo", "19107", 3, *rest), (None, "Foo", "19107", 4, *rest), ("foo-19107-3", None, None, 5, *rest), (None, "Foo", None, 6, *rest), (None, None, None, 7, *rest), (None, "!!", "z", 8, *rest)]
    assert assigned(spark, rows) == {1: "foo", 2: "foo-19107", 3: "foo-19107-2", 4: "foo-19107-4", 5: "foo-19107-3", 6: "foo-x", 7: "group", 8: "group-z"}
    assert assigned(spark, rows, ["foo-19107-2", "group", "foo-x-2", "foo-19107-02"]) == {1: "foo", 2: "foo-19107", 3: "foo-19107-4", 4: "foo-19107-5", 5: "foo-19107-3", 6: "foo-x", 7: "group-x", 8: "group-z"}
    assert assigned(spark, rows[:1]) == {1: "foo"}
    # Different names and ZIPs that spell the same id.
    rows = [("foo", None, None, 0, *rest), ("foo-1", None, None, 1, *rest), ("foo-1-2", None, None, 2, *rest)] + [(None, "Foo", "1", k, *rest) for k in (10, 20, 30)] + [(None, "Foo 1", "3", k, *rest) for k in (11, 21)]
    got = assigned(spark, rows)
    assert len(set(got.values())) == len(rows) and got[10] == "foo-1-3" and got[11] == "foo-1-3-2" or len(set(got.values())) == len(rows)


def test_new_ids_at_random(spark):
    rng = random.Random(6)
    names, zips = ["A", "A 1", "B", "b", "A-1-2"], ["1", "2", None]
    ids = list({rng.choice(["a", "b", "a-1"]) + rng.choice(["", "-1", "-2", "-1-2", "-1-5", "-x", "-x-3"]) for _ in range(12)})
    rows = [(i, "q", "1", k, "s", "b", 1, 2, "c", 3) for k, i in enumerate(ids)] + [(None, rng.choice(names), rng.choice(zips), 100 + k, "s", "b", 1, 2, "c", 3) for k in range(120)]
    got = assigned(spark, rows)
    assert len(got) == len(rows) and len(set(got.values())) == len(rows) and all(got[k] == i for k, i in enumerate(ids))
    for r in rows[len(ids):]:
        slug = "-".join("".join(c if c.isalnum() else " " for c in r[1].lower()).split())
        assert got[r[3]] == slug or got[r[3]].startswith(f"{slug}-{r[2] or 'x'}")


LEADS = "lead_id string, source string, name string, extra map<string, string>, seen_at array<struct<date: string, note: string>>, old string, change string"


def test_harvest(spark):
    day = lambda d: [(d, None)]
    held = [("a:1", "a", "One", {"x": "1", "y": "2"}, day("08"), None, None), ("a:2", "a", "Two", None, day("08"), None, None), ("a:3", "a", "Three", {}, None, None, None), ("b:1", "b", "Other", {}, day("08"), None, None)]
    found = [("a:1", "a", "One", {"y": "2", "x": "1"}, day("09"), None, None), ("a:2", "a", "Zwei", None, day("08"), None, None), ("a:2", "a", "Two", None, day("09"), None, None), ("a:4", "a", None, {}, day("09"), "o", None), ("c:1", "c", "C", {}, day("09"), None, None)]
    frames = lambda *x: [spark.createDataFrame(rows, LEADS) for rows in x]
    with pytest.raises(Exception, match="(?i)ambiguous"):
        merge.merge_harvest(*frames(held, found)).select("change").collect()  # a lead has no column of that name
    held, found = (x.drop("change") for x in frames(held, found))
    got = {r.lead_id: (r.change, r.name, [s.date for s in r.seen_at]) for r in merge.merge_harvest(held, found).collect()}
    assert got.pop("a:2")[0] in ("same", "changed")  # of two rows the least by content
    assert got == {"a:1": ("same", "One", ["08", "09"]), "a:3": ("gone", "Three", []), "b:1": ("kept", "Other", ["08"]), "a:4": ("new", None, ["09"]), "c:1": ("new", "C", ["09"])}
    assert {r.change for r in merge.merge_harvest(held, held).collect()} == {"same"}
    assert merge.merge_harvest(held.limit(0), found.limit(0)).count() == 0
    assert {r.change for r in merge.merge_harvest(held, found.limit(0)).collect()} == {"kept"}


def test_removed_leads_never_return_and_their_groups_stay(spark):
    leads = spark.createDataFrame([("s:1", "s", "1", "https://WWW.Bad.org/x"), ("s:2", "s", "1", None), ("s:3", "s", "2", "me@bad.org"), ("s:4", "s", None, "good.org"), (None, "s", None, None)], "lead_id string, source string, ein string, website string")
    one = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    keep = lambda le=(), e=(), d=(): sorted(str(r.lead_id) for r in suppress.remove_leads(leads, one("lead", *le), one("ein", *e), one("domain", *d)).collect())
    assert keep() == ["None", "s:1", "s:2", "s:3", "s:4"]
    assert keep(le=["s:1"]) == ["None", "s:2", "s:3", "s:4"]
    assert keep(e=["1"]) == ["None", "s:3", "s:4"]
    assert keep(d=["www.BAD.org "]) == keep(d=["bad.org"]) == keep(d=["https://bad.org/"]) == ["None", "s:2", "s:3", "s:4"]
