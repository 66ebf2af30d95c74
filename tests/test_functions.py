"""Functions against the values that they must give."""

import datetime
import html.parser
import random

import pytest
from pyspark.sql import functions as F

from mosaiq.functions import dates, text, urls


def value(spark, column, **given):
    schema = ", ".join(f"{k} string" for k in given) or "x string"
    return spark.createDataFrame([tuple(given.values()) or (None,)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize("x, want", [("Rook & Raven's Loft?", "rook-raven-s-loft"), ("  ", ""), ("A--b", "a-b"), (None, None)])
def test_slug(spark, x, want):
    assert value(spark, text.slug(F.col("x")), x=x) == want


@pytest.mark.parametrize("x, want", [("Beth's & Café", "beths-and-cafe"), ("word " * 20, "-".join(["word"] * 13)[:64]), ("a" * 70, "a" * 64), ("x" * 64 + " y", "x" * 64)])
def test_id_slug(spark, x, want):
    assert value(spark, text.id_slug(F.col("x")), x=x) == want


@pytest.mark.parametrize("x, want", [("<p>Hello &amp;   <b>World</b></p>", "Hello & World"), (None, None), ("   ", None), ("<br>", None), ("a&nbsp; b", "a b"), ("&amp;lt;", "&lt;")])
def test_strip_tags(spark, x, want):
    assert value(spark, text.strip_tags(F.col("x")), x=x) == want


def test_strip_tags_full(spark):
    df = spark.createDataFrame([("<b>caf&eacute; &#x2019;</b>",)], "x string")
    assert df.select(text.collapse(text.unescape_all(F.regexp_replace("x", "<[^>]*>", " "))).alias("v")).first().v == "café ’"


def test_section_text(spark):
    html = '<h1>River choir</h1><h2>History</h2><div>Founded by <i>four</i> neighbours.</div><h2 id="r">Rehearsals</h2><div>Tuesdays at noon.</div>'
    assert value(spark, text.section_text(F.col("x"), "History")["text"], x=html) == "Founded by four neighbours."
    got = value(spark, text.section_text(F.col("x"), "Rehearsals"), x=html)
    assert got["text"] == "Tuesdays at noon." and html[got["pos"]:] == "<div>Tuesdays at noon.</div>"
    assert tuple(value(spark, text.section_text(F.col("x"), "Concerts"), x="<h2>History</h2>")) == (None, 0)


def test_info_rows(spark):
    row = '<tr class="{}"><td class="icon"></td><td class="text">{}</td></tr>'
    html = row.format("website", "choir.example") + row.format("founded", "1987") + row.format("fax", "none")
    assert value(spark, text.info_rows(F.col("x"), ["founded", "website", "patron"]), x=html) == {"website": "choir.example", "founded": "1987"}


def test_row_texts(spark):
    row = '<tr class="{}"><td class="text">{}</td></tr>'
    html = row.format("voice", "alto") + row.format("fee", "none") + row.format("voice", "low &amp; bass")
    assert value(spark, text.row_texts(F.col("x"), "voice"), x=html) == ["alto", "low & bass"]
    assert value(spark, text.row_texts(F.col("x"), "voice"), x="<table></table>") == []


def test_fill(spark):
    got = value(spark, text.fill("Hi {name}, {other} {n}{name", {"name": F.col("x"), "n": F.lit(3)}), x="{n}")
    assert got == "Hi {n}, {other} 3{name"


@pytest.mark.parametrize("x, want", [
    ("**b** & [in](/a/b) [out](https://e.org/?a=1&b=2) [no](http://e.org)",
     '<strong>b</strong> &amp; <a href="/base/a/b">in</a> <a href="https://e.org/?a=1&amp;b=2" rel="noopener noreferrer">out</a> no'),
    (None, None)])
def test_inline(spark, x, want):
    assert value(spark, text.inline("/base")(F.col("x")), x=x) == want


@pytest.mark.parametrize("n, want", [("0", "No groups yet"), ("1", "1 group"), ("7", "7 groups"), (None, None)])
def test_count_text(spark, n, want):
    assert value(spark, text.count_text(F.col("x").cast("int")), x=n) == want


@pytest.mark.parametrize("x, base, name", [("es-MX", "es", "Es MX"), ("ES", "es", "Spanish"), ("asl", "asl", "American Sign Language")])
def test_language(spark, x, base, name):
    assert value(spark, text.language_base(F.col("x")), x=x) == base
    if "-" not in x:
        assert value(spark, text.language_name(F.col("x")), x=x) == name


@pytest.mark.parametrize("x, month, day", [
    ("2019-05", "May 2019", "May 2019"), ("2020-02-29", "February 2020", "February 29, 2020"), ("1999-07-01T00:00:00Z", "July 1999", "July 1, 1999"),
    ("2031-11-30T23:59:59Z", "November 2031", "November 30, 2031"), ("2024-08-09", "August 2024", "August 9, 2024"), ("", None, None), (None, None, None), ("around Easter", None, None),
    ("2019-00", None, None), ("2019-04-99", None, None), ("1987", None, None)])
def test_dates(spark, x, month, day):
    assert value(spark, dates.month_year(F.col("x")), x=x) == month
    assert value(spark, dates.full_date(F.col("x")), x=x) == day
    assert value(spark, dates.last_seen(F.col("x")), x=x) == (month and f"Last seen active: {month}")


def test_months(spark):
    now = F.lit(datetime.date(2021, 3, 14))
    assert value(spark, dates.months_since(F.col("x"), now), x="2019-01") == 26
    assert value(spark, dates.months_since(F.col("x"), now), x="soon") is None
    assert value(spark, dates.month_key(F.col("x")), x="2021-01") > value(spark, dates.month_key(F.col("x")), x="2020-11")
    assert value(spark, dates.month_key(F.col("x")), x=None) == 0
    assert value(spark, dates.due(F.col("x"), now), x="2021-03-13") is True
    assert value(spark, dates.due(F.col("x"), now), x="2021-03-14") is False


def test_site_urls(spark):
    base = urls.base_path(F.col("x"))
    assert [value(spark, base, x=x) for x in ("a", "/a/", "/", "")] == ["/a/", "/a/", "/", "/"]
    assert value(spark, urls.with_base(F.lit("//browse/"), base), x="a") == "/a/browse/"
    assert value(spark, urls.data_url(F.lit("groups.json"), F.lit("/a/"), F.col("x")), x="1 2") == "/a/data/groups.json?v=1%202"
    assert value(spark, urls.data_url(F.lit("groups.json"), F.lit("/a/"), F.col("x")), x=None) == "/a/data/groups.json"
    assert value(spark, urls.same_page(F.col("x"), F.lit("/b")), x="/b/") is True


def test_share_links(spark):
    url = value(spark, urls.share_url(F.col("x"), F.lit("/base/"), "https://example.org"), x="some-group")
    assert url == "https://example.org/base/g/some-group/" and "?" not in url and "#" not in url
    assert value(spark, urls.sms_href(F.col("x")), x="Join us (5 pm), it's *free* & ~near!") == "sms:?&body=Join%20us%20(5%20pm)%2C%20it's%20*free*%20%26%20~near!"
    form = value(spark, urls.form_url("https://example.org", "suggest-group.yml", {"group": F.col("x")}, F.col("x")), x="A b")
    assert form == "https://example.org/issues/new?template=suggest-group.yml&title=Suggest%3A+A+b&group=A+b"
    assert value(spark, urls.group_form_links(F.col("x"), F.lit("p"), "h")["remove"], x="A") == "h/issues/new?template=remove-details.yml&title=Removal%3A+A&group=A+%28p%29"


@pytest.mark.parametrize("x, want", [("WWW.Example.ORG", "example.org"), ("https://www.a.b.org/x?y", "a.b.org"), ("me@example.org", None), ("Some club", None), ("example.org", "example.org"), (None, None)])
def test_host(spark, x, want):
    assert value(spark, urls.host(F.col("x")), x=x) == want


def test_sitemap(spark):
    assert [value(spark, urls.in_sitemap(F.col("x")), x=x) for x in ("/a/", "/my-list/", "/404/")] == [True, False, False]


@pytest.mark.parametrize("x, want", [("https://example.org/g/404/", True), ("https://example.org/g/1404/", True), ("/i/a404", True), ("https://example.org/base/404.html", False), ("https://example.org/404/", False), ("/404.html", False)])
def test_ids_that_end_in_404_are_pages(spark, x, want):
    assert value(spark, urls.in_sitemap(F.col("x")), x=x) is want


class First(html.parser.HTMLParser):
    """Text of the first element of a class, by a parser."""

    def __init__(self, css):
        super().__init__()
        self.css, self.depth, self.done, self.text = css, 0, False, []

    def handle_starttag(self, tag, attrs):
        if self.done or tag in text.VOID:
            return
        if self.depth:
            self.depth += 1
        elif self.css in (dict(attrs).get("class") or "").split():
            self.depth = 1

    def handle_endtag(self, tag):
        if self.depth and not self.done and tag not in text.VOID:
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data):
        if self.depth and not self.done:
            self.text.append(data)


def some_html(rng, depth=0):
    out = []
    for _ in range(rng.randint(0, 4)):
        kind = rng.random()
        if kind < 0.3:
            out.append(rng.choice(["word ", "&amp; more ", "1 < 2 ", "x", "\n"]))
        elif kind < 0.45:
            out.append(rng.choice(["<br>", "<img src='a'>", "<!-- <div class=\"hit\"> -->", "<hr/>"]))
        elif depth < 4:
            tag, css = rng.choice(["div", "p", "b", "span"]), rng.choice(["", ' class="other"', ' class="a hit b"', " class='hit'", ' class="hits"', ' id="x" class="hit"', ' data="hit"'])
            out.append(f"<{tag}{css}>{some_html(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_class_text_equals_a_parser(spark):
    rng = random.Random(3)
    pages = [some_html(rng) for _ in range(400)] + ["", None, "<div class='hit'>open", "<p class=\"hit\"></p><p class=\"hit\">second</p>", "no tags"]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, x string")
    got = {r.k: r.v for r in df.select("k", text.class_text(F.col("x"), "hit").alias("v")).collect()}
    hits = 0
    for k, x in enumerate(pages):
        p = First("hit")
        p.feed(x or "")
        p.close()
        want = "".join("".join(p.text).split())
        assert "".join((got[k] or "").split()) == want, x
        hits += bool(want)
    assert hits > 50
