"""Text and HTML functions as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Mapping
from functools import cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NBSP = " "


def slug(x: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one hyphen; none at the ends.  `Rook & Raven's Loft?` gives `rook-raven-s-loft`."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")


@cache
def _plain() -> tuple[str, str, str, list[str]]:
    """NFKD over all of Unicode, cut down to ASCII: letters that become one ASCII character, those characters, letters that become
    several (the longest first), and for each place the characters of those that reach it."""
    one, several = {}, {}
    for c in map(chr, range(128, 0x110000)):
        if not 0xD800 <= ord(c) <= 0xDFFF:
            plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
            if plain:
                (one if len(plain) == 1 else several)[c] = plain
    many = sorted(several, key=lambda c: (-len(several[c]), c))
    return "".join(one), "".join(one.values()), "".join(many), ["".join(several[c][k] for c in many if len(several[c]) > k) for k in range(len(several[many[0]]))]


def ascii_form(x: Column) -> Column:
    """x in Unicode's compatibility decomposition, without what is not ASCII: marks go, and letters that have no plain form."""
    one, plain, many, places = _plain()
    letters = F.transform(F.regexp_extract_all(x, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.when(F.instr(F.lit(many), c) > 0, F.concat(*[F.translate(c, many, p) for p in places])).otherwise(c))
    spread = F.when(x.rlike(f"[{many}]"), F.array_join(letters, "")).otherwise(x)
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(spread, one, plain), r"[^\x00-\x7F]", "")).otherwise(x)


def id_slug(x: Column, most: int = 64) -> Column:
    """The slug of a record's id: ASCII form, & as and, apostrophes dropped, cut at a word's end within `most` characters."""
    s = F.lower(ascii_form(F.regexp_replace(x, "['’`]", "")))
    s = slug(F.replace(s, F.lit("&"), F.lit(" and ")))
    cut = F.regexp_replace(F.substring(s, 1, most), "-[^-]*$", "")
    return F.when(F.length(s) <= most, s).when(F.substring(s, most + 1, 1) == "-", F.substring(s, 1, most)).otherwise(cut)


#: HTML entities that listings use; the ampersand comes last, so that nothing is unescaped twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&apos;": "'", "&nbsp;": NBSP, "&amp;": "&"}


def unescape(x: Column) -> Column:
    for a, b in ENTITIES.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


@F.pandas_udf(T.StringType())
def unescape_all(x: pd.Series) -> pd.Series:
    """Every HTML entity, named or numbered."""
    return x.map(html.unescape, na_action="ignore")


def collapse(x: Column) -> Column:
    """White space, non-breaking spaces too, as one space, none at the ends; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(x, rf"[\s{NBSP}]+", " ")), F.lit(""))


#: Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def class_text(x: Column, css: str) -> Column:
    """Text of the first element whose class list has a class, that of the elements within it included; null if there is none.

    Tags and texts are taken one after the other, with the depth below the element that was found: it ends where its own end tag stands,
    not at the first one.  An element that is never closed goes on to the end."""
    parts = F.regexp_extract_all(x, F.lit(r"(?s)<!--.*?-->|</?[a-zA-Z][^>]*>|[^<]+|<"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("text"))

    def step(s: Column, part: Column) -> Column:
        tag = part.rlike("^</?[a-zA-Z]")
        closes, name = part.startswith("</"), F.lower(F.regexp_extract(part, "^</?([a-zA-Z][^\\s/>]*)", 1))
        empty = name.isin(*VOID) | part.endswith("/>")
        found = tag & ~closes & ~empty & part.rlike(rf"""(?s)\sclass\s*=\s*(["'])([^"']*\s)?{css}(\s[^"']*)?\1""")
        depth = F.when(s["done"], s["depth"]).when(s["depth"] == 0, F.when(found, 1).otherwise(0)).when(tag & ~empty, F.when(closes, s["depth"] - 1).otherwise(s["depth"] + 1)).otherwise(s["depth"])
        taken = F.when(~s["done"] & (s["depth"] > 0), F.when(tag | part.startswith("<!--"), F.lit(" ")).otherwise(part)).otherwise(F.lit(""))
        return F.struct(depth.alias("depth"), (s["done"] | ((s["depth"] > 0) & (depth == 0))).alias("done"), F.concat(s["text"], taken).alias("text"))

    return collapse(unescape(F.aggregate(parts, start, step)["text"]))


def strip_tags(x: Column, full: bool = False) -> Column:
    """Text of an HTML fragment: tags dropped, entities unescaped (with full, all of them), white space collapsed; null or blank is null."""
    text = F.regexp_replace(x, "<[^>]*>", " ")
    return collapse(unescape_all(text) if full else unescape(text))


def _literal(text: str) -> str:
    return re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", text)


def section_text(x: Column, header: str, level: int = 2) -> Column:
    """(text, pos): the text below a heading up to the next one of the level, and where it begins; (null, 0) without the heading."""
    head = rf"<h{level}[^>]*>\s*{_literal(header)}\s*</h{level}>"
    body = F.regexp_extract(x, rf"(?s){head}(.*?)(?=<h{level}[\s>]|$)", 1)
    found = x.rlike(head)
    at = F.regexp_instr(x, F.lit(head)) + F.length(F.regexp_substr(x, F.lit(head))) - 1
    return F.struct(F.when(found, strip_tags(body)).alias("text"), F.when(found, at).otherwise(0).alias("pos"))


def info_rows(x: Column, keys: list[str]) -> Column:
    """Map of the table rows of class key that are there to the text of their cell of class `text`."""
    pairs = [p for k in keys for p in (F.lit(k), strip_tags(F.regexp_extract(x, rf'(?s)<tr[^>]*class="{_literal(k)}"[^>]*>.*?<td[^>]*class="text"[^>]*>(.*?)</td>', 1)))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def row_texts(x: Column, key: str) -> Column:
    """The cells of class `text` of all table rows of class key, in order."""
    cells = F.regexp_extract_all(x, F.lit(rf'(?s)<tr[^>]*class="{_literal(key)}"[^>]*>.*?<td[^>]*class="text"[^>]*>(.*?)</td>'), F.lit(1))
    return F.filter(F.transform(cells, lambda c: strip_tags(c)), lambda t: t.isNotNull())


def elements(x: Column, tag: str) -> Column:
    """The texts of all elements of a tag, in order."""
    return F.transform(F.regexp_extract_all(x, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), lambda c: strip_tags(c))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def fill(template: Column | str, values: Mapping[str, Column]) -> Column:
    """{name} placeholders replaced; those without a value stay.  Null values count as empty text.

    The template is cut at its placeholders first, so a value that looks like a placeholder is left alone."""
    template = F.lit(template) if isinstance(template, str) else template
    pieces = F.regexp_extract_all(template, F.lit(r"(?s)\{\w+\}|\{|[^{]+"), F.lit(0))

    def one(piece: Column) -> Column:
        out = piece
        for name, value in values.items():
            out = F.when(piece == "{" + name + "}", F.coalesce(value.cast("string"), F.lit(""))).otherwise(out)
        return out

    return F.array_join(F.transform(pieces, one), "")


def inline(base: str = "/"):
    """A function of text with **bold** and [label](url) that gives safe HTML: site paths get the base, https links stay, others keep their label."""
    root = base.rstrip("/") + "/"

    def link(m: re.Match) -> str:
        url = m[2].replace("&amp;", "&")
        if url.startswith("/"):
            return f'<a href="{html.escape(root + url.lstrip("/"))}">{m[1]}</a>'
        return f'<a href="{html.escape(url)}" rel="noopener noreferrer">{m[1]}</a>' if url.startswith("https://") else m[1]

    def render(text: str) -> str:
        bold = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", html.escape(text))
        return re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", link, bold)

    @F.pandas_udf(T.StringType())
    def udf(x: pd.Series) -> pd.Series:
        return x.map(render, na_action="ignore")

    return udf


def title_case(x: Column) -> Column:
    return F.initcap(F.translate(x, "-_", "  "))


def prettify(x: Column) -> Column:
    """An id as a label: separators as spaces, the first letter large."""
    words = F.translate(x, "-_", "  ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20))


def count_text(n: Column, none: str = "No groups yet", one: str = "1 group", many: str = "{n} groups") -> Column:
    """Wording of a count; null stays null."""
    return F.when(n == 0, F.lit(none)).when(n == 1, F.lit(one)).when(n.isNotNull(), fill(many, {"n": n}))


#: Languages by code, as shown.
LANGUAGES = {
    "en": "English", "es": "Spanish", "zh": "Chinese", "vi": "Vietnamese", "ar": "Arabic", "fr": "French",
    "ru": "Russian", "pt": "Portuguese", "ko": "Korean", "ht": "Haitian Creole", "km": "Khmer", "asl": "American Sign Language",
}


def language_base(code: Column) -> Column:
    return F.element_at(F.split(F.lower(code), "[-_]"), 1)


def platform_languages(spark: SparkSession) -> dict[str, str]:
    """English names of the two-letter codes, as the Java platform has them."""
    locale = spark.sparkContext._jvm.java.util.Locale
    return {code: locale.forLanguageTag(code).getDisplayLanguage(locale.ENGLISH) for code in locale.getISOLanguages()}


def language_name(code: Column, more: Mapping[str, str] | None = None) -> Column:
    """A language as shown: by its code, else by its base's name in more (such as platform_languages), else the code prettified."""
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    known = F.try_element_at(table(LANGUAGES), F.lower(code))
    return F.coalesce(known, *([F.try_element_at(table(more), language_base(code))] if more else []), prettify(code))
