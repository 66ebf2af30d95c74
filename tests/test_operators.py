"""Operators on small rows: nulls, empties, ties and unknown entries."""

from pyspark.sql import functions as F

from mosaiq.operators import browse, merge, places, recommend, similarity, suppress


def test_jaccard_and_similarity(spark):
    rows = spark.createDataFrame([(1, ["a", "a", "b"], ["b", "c"]), (2, [], ["b"]), (3, None, ["b"]), (4, ["a"], ["a"])], "id int, a array<string>, b array<string>")
    got = {r.id: r.v for r in rows.select("id", similarity.jaccard(F.col("a"), F.col("b")).alias("v")).collect()}
    assert got == {1: 1 / 3, 2: None, 3: None, 4: 1.0}
    group = "id int, tags array<string>, families array<string>, roles array<string>, formats array<string>, motives array<string>, crowd array<string>, kind string, size string, commitment string"
    none = [[] for _ in range(6)]
    pool = spark.createDataFrame([(1, *none, None, None, None), (2, *none, None, "", None), (3, ["a", "b"], *none[1:], "club", "s", "x"), (4, ["a"], *none[1:], "club", "s", None)], group)
    got = {(r.id, r.liked_id): r.score for r in similarity.scores(pool, pool).collect()}
    assert got[1, 2] == 1.0  # two null kinds are equal
    assert got[1, 3] == 0.0
    assert abs(got[3, 4] - (0.3 * 0.5 + 0.1 + 0.05) / 0.45) < 1e-12
    score = lambda i, j: got[i, j]
    chosen = [1]
    while len(chosen) < 3:
        chosen.append(min({1, 2, 3, 4} - set(chosen), key=lambda i: (max(score(i, c) for c in chosen), i)))
    assert recommend.cards_that_differ(pool, 3) == chosen
    assert recommend.cards_that_differ(pool.limit(0), 3) == []
    assert sorted(recommend.cards_that_differ(pool, 9)) == [1, 2, 3, 4]


def test_prepared_groups_score_alike(spark):
    import random

    rng = random.Random(5)
    tags = [f"t{k}" for k in range(150)]  # three numbers of bits
    some = lambda: rng.choice([None, [], [rng.choice(tags) for _ in range(rng.randint(1, 40))] + [None, "t1", "t1"]])
    rows = [(k, *[some() for _ in range(6)], rng.choice(["club", None]), rng.choice(["s", "", None]), None) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, tags array<string>, families array<string>, roles array<string>, formats array<string>, motives array<string>, crowd array<string>, kind string, size string, commitment string")
    clean = df.select(*[F.array_compact(c).alias(c) if c in similarity.LISTS else c for c in df.columns])
    ready = similarity.prepare(df, similarity.build_catalog(df))
    want = {(r.id, r.liked_id): r.score for r in similarity.scores(clean, clean.filter("id < 10")).collect()}
    got = {(r.id, r.liked_id): r.score for r in similarity.prepared_scores(ready, ready.filter("id < 10")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert similarity.prepare(df.limit(0), similarity.build_catalog(df.limit(0))).count() == 0


def test_counts_keep_vocabulary_and_unknown(spark):
    rows = spark.createDataFrame([(["a", "a", "zz_top"], False), ([], None), (["b"], True)], "categories array<string>, hidden boolean")
    vocabulary = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "id string, label string, sort_ord int")
    got = [tuple(r) for r in browse.counts_with_vocabulary(browse.browsable(rows), F.col("categories"), vocabulary).orderBy("sort_ord", "id").select("id", "label", "n").collect()]
    assert got == [("a", "A", 2), ("b", "B", 0), ("zz_top", "Zz top", 1)]


def test_sanitised_and_families(spark):
    vocabulary = spark.createDataFrame([("a", None), ("b", True)], "id string, support_only boolean")
    answers = spark.createDataFrame([(["a", "q"],), (None,)], "picks array<string>")
    assert [r.picks for r in browse.sanitised(answers, "picks", vocabulary).collect()] == [["a"], None]
    assert [r.id for r in browse.browsable_families(vocabulary).collect()] == ["a"]
    lines = browse.cheat_sheet(spark.createDataFrame([("f", True, ["x", "y"])], "id string, support_only boolean, tags array<string>"))
    assert lines.first().line == "- **f** (support groups only): x, y"


LOC = "struct<label: string, address: string, neighborhood: string, planning_district: string, zip: string, lat: double, lng: double, in_city: boolean>"


def test_places(spark):
    mail, meet = places.MAILING[0], "Meets"
    rows = [
        (1, [(mail, "a", None, None, "1", 1.0, 1.0, True), (meet, "", None, "river_wards", None, None, None, True)], None),
        (2, [(mail, "a", "north-side", None, "1", 1.0, 1.0, True)], None),
        (3, [(None, None, None, None, "1", None, None, True)], True),
        (4, [(None, None, None, None, "1", None, None, False)], True),
        (5, [], True), (6, [], None), (7, None, None)]
    df = spark.createDataFrame(rows, f"id int, l array<{LOC}>, online boolean")
    labels = F.create_map(F.lit("river_wards"), F.lit("The River Wards"))
    got = {r.id: (r.line, r.meets) for r in df.select("id", places.place_line(F.col("l"), F.col("online"), labels).alias("line"), places.has_meeting_place(F.col("l")).alias("meets")).collect()}
    assert got == {1: ("The River Wards", False), 2: ("North Side", False), 3: ("Online", False), 4: (None, False), 5: ("Online", False), 6: (None, False), 7: (None, False)}
    safe = df.filter("id = 1").select(places.publish_zip_only(F.col("l")).alias("l")).first().l
    assert (safe[0].address, safe[0].lat, safe[0].zip) == (None, None, "1")


def test_geo(spark):
    df = spark.createDataFrame([("river_wards",), ("central",), ("nowhere",), (None,)], "d string")
    got = [r.v for r in df.select(places.region_label(places.region_of(F.col("d"))).alias("v")).collect()]
    assert got == ["North", "Center City", "Other", "Other"]
    km = df.limit(1).select(places.distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("v")).first().v
    assert abs(km - 111.195) < 0.01
    zips = spark.createDataFrame([("19100", "west")], "zip string, district string")
    hoods = spark.createDataFrame([("h", "south")], "id string, district string")
    rows = spark.createDataFrame([(1, "h", "19100"), (2, None, "19100"), (3, None, None)], "id int, neighborhood string, zip string")
    assert {r.id: r.planning_district for r in places.districts_by_zip(rows, zips, hoods).collect()} == {1: "south", 2: "west", 3: None}


def test_consolidate(spark):
    leads = spark.createDataFrame(
        [("1", "b:1", "b", [("x", "1")], ("u2", ["n"])), ("1", "a:1", "a", [("x", "1"), ("y", "2")], ("u1", ["n", "m"])), (None, "c:1", "c", [], ("u3", [])), (None, "c:2", "c", None, ("u4", []))],
        "ein string, lead_id string, source string, locations array<struct<address: string, zip: string>>, provenance struct<url: string, fields: array<string>>")
    got = sorted(((r.ein or "", r.leads, [x.address for x in r.locations or []], [s.url for s in r.sources]) for r in merge.consolidate(leads).collect()), key=str)
    assert got == sorted([("1", ["a:1", "b:1"], ["x", "y"], ["u1", "u2"]), ("", ["c:1"], [], ["u3"]), ("", ["c:2"], [], ["u4"])], key=str)


def test_new_ids_keep_old_ones(spark):
    rows = spark.createDataFrame([("kept", "Club", "1", 1), (None, "Club", "19100", 2), (None, "Kept", "19100", 3), (None, "Club", "19100", 4), (None, "Club", "19100", 5)], "id string, name string, zip string, n int")
    got = {r.n: r.id for r in merge.new_ids(rows, F.col("name"), F.col("zip"), F.col("n")).collect()}
    assert got == {1: "kept", 2: "club", 3: "kept-19100", 4: "club-19100", 5: "club-19100-2"}


def test_blocklist(spark):
    groups = spark.createDataFrame([("a", ["l1"], "1", ("WWW.X.org",)), ("b", ["l2"], None, ("me@x.org",)), ("c", [], "3", (None,)), ("d", None, None, None)],
                                   "id string, leads array<string>, ein string, contacts struct<website: string>")
    one = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    keep = lambda i=(), le=(), e=(), d=(): sorted(r.id for r in suppress.apply_blocklist(groups, one("id", *i), one("lead", *le), one("ein", *e), one("domain", *d)).collect())
    assert keep() == ["a", "b", "c", "d"]
    assert keep(i=["c"]) == ["a", "b", "d"]
    assert keep(le=["l2"]) == ["a", "c", "d"]
    assert keep(e=["1"]) == ["b", "c", "d"]
    assert keep(d=["x.org"]) == ["b", "c", "d"]


def test_relaxed_tier_axis_replacement(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("c", None)], "id string, n int")
    got = recommend.relaxed(df, [F.col("n") > 0, F.col("n") > 9]).collect()
    assert sorted((r.id, r.level) for r in got) == [("a", 1), ("b", 1)]
    assert recommend.replacement(df, F.col("n"), spark.createDataFrame([("b",)], "id string")).first().id == "a"
    assert [r.t for r in df.orderBy("id").limit(2).select(recommend.tier(F.col("n"), [2, 7]).alias("t")).collect()] == [2, 1]
    axes = {"x": F.col("n") > 0, "y": F.col("n") > 3}
    assert [r.v for r in df.orderBy("id").select(recommend.only_axis(axes).alias("v")).collect()] == ["x", None, None]
