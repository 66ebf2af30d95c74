"""Sources: defaults, missing keys, empty inputs, and texts that must stay texts."""

import json

import pytest
from pyspark.sql import functions as F

from mosaiq.schema import SOURCE
from mosaiq.sources import listings, registry, tables
from mosaiq.sources.leads import typed_extra


def test_registry(spark, tmp_path):
    assert registry.load_sources(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "empty.yaml").write_text("")
    assert registry.load_sources(spark, str(tmp_path / "empty.yaml")).count() == 0
    ids = sorted(registry.HARVESTERS.keys() | registry.REFERENCE)
    rows = [{"id": k, "name": k, "lead_only": True, "other": 1} for k in ids]
    df = registry.sources(spark, rows)
    assert df.schema == SOURCE and df.first().notes is None
    assert registry.registry_gaps(df, spark).count() == 0
    assert {tuple(r) for r in registry.registry_gaps(df.filter("id <> 'irs_bmf'").unionByName(registry.sources(spark, [{"id": "new"}])), spark).collect()} == {("irs_bmf", "right"), ("new", "left")}
    assert registry.source(df, "irs_bmf").count() == 1 and registry.source(df, "nope").count() == 0


def test_seeds(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("""
- id: lantern-walkers
  name: Lantern Walkers
  kind_hint: walk
  source_url: https://lanterns.example/about
  note: Seen on a poster.
  tags: [walking, night]
- id: row-of-oars
  name: Row of Oars
  source_url: https://oars.example/
  website: https://rowofoars.example
  city: null
  aka: ['yes', 1999]
  extra: {boats: four}
""")
    one, two = tables.seeds(spark, str(tmp_path / "s.yaml")).collect()
    assert (one.lead_id, one.kind_hint, one.extra, one.tags_hint, one.city, one.aka) == ("manual_seeds:lantern-walkers", "walk", {"note": "Seen on a poster."}, ["walking", "night"], "Philadelphia", [])
    assert (two.website, two.extra, two.kind_hint, two.city, two.aka) == ("https://rowofoars.example", {"boats": "four"}, "other", None, ["yes", "1999"])
    (tmp_path / "bad.yaml").write_text("a: 1")
    with pytest.raises(ValueError):
        tables.seeds(spark, str(tmp_path / "bad.yaml"))
    with pytest.raises(KeyError):
        tables.parse_seeds(spark, [{"id": "x"}])
    assert tables.parse_seeds(spark, []).count() == 0


def test_clubs(spark, tmp_path):
    clubs = [{"code": "kites", "name": "Kite Makers", "subtitle": "Paper, sticks and wind", "email": "kites@campus.example", "tags": [{"id": 40, "name": "Crafts"}, {"id": 8, "name": "Outdoors"}]}, {"name": "Nameless code"}]
    (tmp_path / "clubs.json").write_text(json.dumps(clubs))
    (lead,) = tables.campus_clubs(spark, str(tmp_path / "clubs.json")).collect()
    assert (lead.tags_hint, lead.description, lead.school, lead.kind_hint, lead.open_to_public_hint, lead.lead_id) == (["Crafts", "Outdoors"], "Paper, sticks and wind", "penn", "student_org", None, "penn_clubs:kites")
    assert lead.extra["directory_url"] == "https://pennclubs.com/club/kites"


def test_programs(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("programs:\n  - {name: Test Buddies, url: https://e.org, evidence_date: '2026-09', notes: null}\ndiscontinued:\n  - {name: Dead}\n")
    (lead,) = tables.programs(spark, str(tmp_path / "p.yaml")).collect()
    assert (lead.native_id, lead.extra) == ("test-buddies", {"evidence_date": "2026-09"})


def test_tables_keep_leading_zeros(spark, tmp_path):
    (tmp_path / "b.csv").write_text('EIN,NAME,CITY,ZIP\n012345678,"A ""B"" Club",Town,00123\n')
    (lead,) = registry.harvest(spark, {"irs_bmf": str(tmp_path / "b.csv"), "planning_districts": "nowhere"}).collect()
    assert (lead.native_id, lead.name, lead.city, lead.extra["ZIP"]) == ("012345678", 'A "B" Club', "Town", "00123")
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"OBJECTID": 7, "org_name": "X"}, "geometry": None}]}))
    (lead,) = tables.geo_features("city_rco")(spark, str(tmp_path / "g.json")).collect()
    assert (lead.lead_id, lead.name) == ("city_rco:7", "X")
    assert registry.harvest(spark, {}).count() == 0


#: Fixed: the layout's class names and link.
CARD = """<h3 class="fl-post-title">{}</h2><span class="grotto-address">{}</span><div class="fl-post-more-link arrow-link"><a href='https://caves.org/grotto/{}/'>More</a></div>"""


def test_club_cards(spark):
    html = CARD.format("Deep Lamp Society", "7 Slate Row\nSomewhere, PA 19103", "deep-lamp-society") + CARD.format("Far Ridge Cavers", "Box 12\nElsewhere, PA 15001-0002", "far-ridge-cavers")
    df = spark.createDataFrame([(html, "u"), ("<p>no cards</p>", "v"), (None, "w")], "html string, url string")
    got = {r.name: (r.extra["philadelphia_area"], r.native_id, r.kind_hint) for r in listings.parse_club_cards(df).collect()}
    assert got == {"Deep Lamp Society": ("true", "deep-lamp-society", "club"), "Far Ridge Cavers": ("false", "far-ridge-cavers", "club")}
    typed = {r.name: r.area for r in listings.parse_club_cards(df).select("name", F.variant_get(typed_extra(F.col("extra")), "$.philadelphia_area", "boolean").alias("area")).collect()}
    assert typed == {"Deep Lamp Society": True, "Far Ridge Cavers": False}
    nested = CARD.format("Deep <i>Lamp</i> Society", "<div>7 <b>Slate</b> Row<br>Somewhere</div><p>PA 19103</p>", "x")
    (lead,) = listings.parse_club_cards(spark.createDataFrame([(nested, "u")], "html string, url string")).collect()
    assert (lead.name, lead.extra["address"]) == ("Deep Lamp Society", "7 Slate Row Somewhere PA 19103")


def test_extras_keep_their_types(spark):
    rows = spark.createDataFrame([(1, {"philadelphia_area": "true", "note": 'a "quoted"\n é', "n": "true"}), (2, {}), (3, None), (4, {"philadelphia_area": "maybe"})], "id int, extra map<string, string>")
    got = {r.id: r.j and json.loads(r.j) for r in rows.select("id", F.to_json(typed_extra(F.col("extra"))).alias("j")).collect()}
    assert got == {1: {"philadelphia_area": True, "note": 'a "quoted"\n é', "n": "true"}, 2: {}, 3: None, 4: {"philadelphia_area": "maybe"}}


def test_organisations(spark, tmp_path):
    (tmp_path / "b.csv").write_text('NAME,EIN,CITY,ZIP,SORT_NAME,UNKNOWN\n"TIN, CUP & CO",12345678,TOWN,00123,,x\nNO NUMBER,,TOWN,1,,\n')
    (lead,) = registry.HARVESTERS["irs_bmf"](spark, str(tmp_path / "b.csv")).collect()
    assert (lead.lead_id, lead.name, lead.city, lead.aka, lead.extra) == ("irs_bmf:012345678", "TIN, CUP & CO", "TOWN", [], {"EIN": "012345678", "NAME": "TIN, CUP & CO", "CITY": "TOWN", "ZIP": "00123"})
    (tmp_path / "bad.csv").write_text("NAME,CITY\na,b\n")
    with pytest.raises(ValueError, match="EIN"):
        registry.HARVESTERS["irs_bmf"](spark, str(tmp_path / "bad.csv"))
    row = dict.fromkeys(tables.POSTCARD, "") | {"EIN": "009876543", "NAME": "Tin Cups", "CITY": "Hill", "WEBSITE": "tincups.example", "OFFICER": "A Person", "DBA_2": "Cup Club", "TERMINATED": "F"}
    (tmp_path / "n.txt").write_text("|".join(row.values()) + "\n" + "009876544|2020|Short Row\n")
    one, two = registry.HARVESTERS["irs_990n"](spark, str(tmp_path / "n.txt")).orderBy("lead_id").collect()
    assert (one.lead_id, one.name, one.city, one.website, one.aka) == ("irs_990n:009876543", "Tin Cups", "Hill", "tincups.example", ["Cup Club"]) and one.extra["TERMINATED"] == "F" and "OFFICER" not in one.extra
    assert (two.lead_id, two.name, two.city) == ("irs_990n:009876544", "Short Row", None)


def test_readers_of_files(spark, tmp_path):
    """Each reader from a file of its own, as its harvester is given one."""
    from mosaiq.operators import suppress

    texts = {"cards.html": CARD.format("Low Arch", "9 Quay, PA 19104", "low-arch"), "grantees.html": '<div class="grantee"><h3>Tin Theatre</h3></div>', "parade.html": "<h2>Brass</h2><ul><li>Loud Lot: Gold</li></ul>",
             "rows.json": json.dumps([{"id": 7, "title": "Ferry Friends", "open": True}, {"id": 8, "title": None}]), "groups.json": json.dumps({"built": "now", "groups": [{"id": "g", "name": "G", "aka": None, "locations": [{"planning_district": "lower_south"}]}]})}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    one = lambda df: [(r.lead_id, r.name) for r in df.orderBy("lead_id").collect()]
    at = lambda name: str(tmp_path / name)
    assert one(listings.club_cards(spark, at("cards.html"))) == [("nss_grottos:low-arch", "Low Arch")]
    assert one(listings.grantee_cards(spark, at("grantees.html"))) == [("cultural_fund:tin-theatre", "Tin Theatre")]
    assert one(listings.parade_lineup(spark, at("parade.html"))) == [("mummers:loud-lot", "Loud Lot")]
    assert one(tables.json_rows("campus_labs")(spark, at("rows.json"))) == [("campus_labs:7", "Ferry Friends"), ("campus_labs:8", None)]
    assert tables.json_rows("campus_labs")(spark, at("rows.json")).orderBy("lead_id").first().extra["open"] == "true"
    groups = tables.groups_json(spark, at("groups.json"))
    assert [(r.id, r.aka, r.hidden, r.locations[0].planning_district) for r in groups.collect()] == [("g", [], False, "lower-south")]
    assert suppress.shareable(groups).columns == ["id"]


def test_grantee_cards(spark):
    html = """<div class="card grantee"><h3><a href="/grantees/a-b-2/">A &amp; B, Inc.</a></h3><dl><dt>Program</dt><dd>Art &amp; Culture</dd><dt>Council District</dt><dd>District 8</dd><dt>Discipline</dt><dd>Music</dd></dl><a class="website" href="http://www.ab.org/">site</a></div>
    <div class="card grantee"><h3>C Productions</h3></div>"""
    got = listings.parse_grantee_cards(spark.createDataFrame([(html, "u"), ("<html></html>", "v")], "html string, url string")).orderBy("name").collect()
    assert [(r.name, r.website, r.tags_hint, r.extra, r.native_id) for r in got] == [
        ("A & B, Inc.", "http://www.ab.org/", ["Music"], {"grant_program": "Art & Culture", "council_district": "District 8"}, "a-b-2"), ("C Productions", None, [], {}, "c-productions")]


def test_lineup(spark):
    html = "<h2>Fancy Division</h2><ul><li>Sunrise</li></ul><h2>Comic Division</h2><h3>Big Comics</h3><ul><li>Pranking Club: Clowns</li><li>Sunrise</li></ul><h2>Bands</h2><ul><li>Some Band: Music</li></ul>"
    got = {r.native_id: r for r in listings.parse_lineup(spark.createDataFrame([(html, "u")], "html string, url string"), "2026-01-01").collect()}
    assert set(got) == {"sunrise", "sunrise-2", "pranking-club", "some-band"}
    assert got["sunrise"].tags_hint == ["Fancy Division"] and "Fancy Division" in got["sunrise"].seen_at[0].note and got["sunrise"].seen_at[0].date == "2026-01-01"
    assert got["pranking-club"].extra == {"mother_club": "Big Comics", "2026_theme": "Clowns"} and "Mother Club: Big Comics" in got["pranking-club"].tags_hint
    assert got["some-band"].extra == {"2026_theme": "Music"}


def test_record_corpus(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "a-club.yaml").write_text("id: a-club\naka: ['no', no]\nein: '012345678'\nlast_sign_of_life: 2026-10\nlocations:\n- {zip: 01234, lat: 1.5, in_city: true, planning_district: river_wards}\nhidden: null\naudience: {min_age: 16}\n")
    (tmp_path / "a" / "notes.txt").write_text("not a record")
    g = tables.records(spark, str(tmp_path)).first()
    assert (g.id, g.aka, g.ein, g.last_sign_of_life, g.locations[0].zip, g.locations[0].in_city, g.leads) == ("a-club", ["no", "no"], "012345678", "2026-10", "01234", True, None)
    c = tables.conform(tables.records(spark, str(tmp_path))).first()
    assert (c.leads, c.hidden, c.locations[0].planning_district) == ([], False, "river-wards")


def test_site_data(spark, tmp_path):
    groups = spark.createDataFrame([("a",)], "id string")
    tables.write_site_data(groups, groups, str(tmp_path / "out"), "now")
    assert spark.read.json(str(tmp_path / "out/manifest")).first().asDict() == {"built": "now", "groups": 1}
    assert tables.load_or_sample(spark, str(tmp_path / "none"), str(tmp_path / "out/groups"), "id string").first().id == "a"
    with pytest.raises(FileNotFoundError):
        tables.load_or_sample(spark, str(tmp_path / "none"), str(tmp_path / "neither"))


def test_streams(spark, sf, tmp_path):
    from mosaiq.streaming import events

    table = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):
        table.orderBy("ts").filter(F.pmod("event_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"))
    q = events.windowed_counts(stream, "1 hour", late="3650 days").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in events.windowed_counts(table, "1 hour").select("event_type", "start", "n").collect()}
    assert {tuple(r) for r in spark.table("hours").select("event_type", "start", "n").collect()} == want
    out = events.write_counts(events.windowed_counts(events.read_events(spark, str(tmp_path / "in")), "1 hour"), str(tmp_path / "out"), str(tmp_path / "mark"))
    out.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() <= len(want)
    assert events.first_seen(table, ["user_id"], "1 hour").count() == table.select("user_id").distinct().count()


def test_vocabularies(spark, tmp_path):
    from mosaiq.operators import browse, suppress
    from mosaiq.schema import GROUP, group_row

    (tmp_path / "kinds.yaml").write_text("kinds:\n- {id: club, label: Club}\n- {id: 'no', label: None here}\n")
    (tmp_path / "interests.yaml").write_text("families:\n- {id: outdoors, label: Outdoors, tags: [{id: hiking}, {id: camping}]}\n- {id: grief, label: Grief, support_only: true, tags: []}\n")
    (tmp_path / "neighborhoods.yaml").write_text("neighborhoods:\n- {id: old-town, label: Old Town, district: south}\nzip_districts: {01234: {district: south}}\n")
    (tmp_path / "empty.yaml").write_text("")
    v = tables.vocabularies(spark, str(tmp_path))
    got = {(r.vocabulary, r.list, r.id): (r.label, r.tags, r.district) for r in v.collect()}
    assert got["kinds", "kinds", "no"] == ("None here", [], None) and got["neighborhoods", "zip_districts", "01234"] == (None, [], "south") and got["interests", "families", "outdoors"][1] == ["hiking", "camping"]
    tables.write_quiz_config(v, str(tmp_path / "quiz"), "now")
    assert [e["id"] for e in json.loads(spark.read.text(str(tmp_path / "quiz")).first().value)["vocabularies"]["kinds.kinds"]] == ["club", "no"]
    read = tables.quiz_config(spark, str(tmp_path / "quiz")).filter("name = 'kinds.kinds'").orderBy("sort_ord")
    assert [r.id for r in read.collect()] == ["club", "no"]
    groups = spark.createDataFrame([group_row(), group_row(id="b", audience={"min_age": 16}), group_row(id="c", hidden=None)], GROUP)
    assert [(r.audience.open_to, r.audience.min_age) for r in groups.orderBy("id").collect()] == [("public", 16), ("public", None), ("public", None)]
    hidden = suppress.hide(groups, spark.createDataFrame([("c", "private"), ("c", "defunct")], "id string, reason string"))
    assert {r.id: (r.hidden, r.hidden_reason) for r in hidden.collect()} == {"some-group": (False, None), "b": (False, None), "c": (True, "defunct")}
    config = browse.browse_config(hidden, v, "now").first()
    assert (config.n_groups, config.places, config.families, config.version) == (2, {"old-town": "Old Town"}, ["outdoors"], "now")
    zips = spark.createDataFrame([("01234",), ("9",), (None,)], "zip string")
    assert {r.zip: r.ok for r in browse.is_known(zips, "zip", v.filter("list = 'zip_districts'"), "ok").collect()} == {"01234": True, "9": False, None: False}
