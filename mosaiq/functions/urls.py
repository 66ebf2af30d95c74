"""Addresses: site paths, form links, shared links and hosts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.functions.text import fill


def base_path(raw: Column) -> Column:
    """One slash at each end."""
    return F.concat(F.regexp_replace(F.regexp_replace(raw, "^(?!/)", "/"), "/*$", ""), F.lit("/"))


def with_base(path: Column, base: Column) -> Column:
    return F.concat(base, F.regexp_replace(path, "^/+", ""))


def absolute(path: Column, base: Column, origin: str) -> Column:
    return F.concat(F.lit(origin), with_base(path, base))


def group_path(id_: Column) -> Column:
    return F.concat(F.lit("g/"), id_, F.lit("/"))


def interest_path(id_: Column) -> Column:
    return F.concat(F.lit("i/"), id_, F.lit("/"))


def same_page(a: Column, b: Column) -> Column:
    """Equal paths but for a slash at the end."""
    return F.regexp_replace(a, "/+$", "") == F.regexp_replace(b, "/+$", "")


def form_encode(x: Column) -> Column:
    """As in a form: a space is +."""
    return F.url_encode(x)


def component_encode(x: Column) -> Column:
    """As encodeURIComponent: a space is %20, and ! ' ( ) ~ stay."""
    x = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        x = F.replace(x, F.lit(code), F.lit(char))
    return x


def data_url(file: Column, base: Column, version: Column) -> Column:
    """A data file's address; a version breaks caches."""
    url = with_base(F.concat(F.lit("data/"), file), base)
    return F.when(F.nullif(version, F.lit("")).isNotNull(), F.concat(url, F.lit("?v="), component_encode(version))).otherwise(url)


#: Title beginnings of the forms.
TITLES = {"correct-listing.yml": "Correction: ", "i-run-this-group.yml": "Organizer: ", "remove-details.yml": "Removal: ", "suggest-group.yml": "Suggest: ", "bulletin-board.yml": "Bulletin board: "}


def form_url(host: str, template: str, fields: Mapping[str, Column] | None = None, subject: Column | None = None) -> Column:
    """A link to a form: template, then title if there is a subject, then the fields."""
    out = [F.concat(F.lit("template="), form_encode(F.lit(template)))]
    if subject is not None:
        title = F.concat(F.lit("title="), form_encode(F.concat(F.lit(TITLES[template]), subject)))
        out.append(F.when(F.nullif(subject, F.lit("")).isNotNull(), title))
    out += [F.concat(form_encode(F.lit(k)), F.lit("="), form_encode(v)) for k, v in (fields or {}).items()]
    return F.concat(F.lit(f"{host}/issues/new?"), F.concat_ws("&", *out))


def group_form_links(name: Column, page: Column, host: str) -> Column:
    fields = {"group": F.concat(name, F.lit(" ("), page, F.lit(")"))}
    links = {"correct": "correct-listing.yml", "i_run": "i-run-this-group.yml", "remove": "remove-details.yml"}
    return F.struct(*[form_url(host, t, fields, name).alias(k) for k, t in links.items()])


def share_url(id_: Column, base: Column, origin: str) -> Column:
    """A shared link holds the id and nothing else."""
    return absolute(group_path(id_), base, origin)


def share_message(template: str, name: Column, id_: Column, base: Column, origin: str) -> Column:
    return fill(template, {"name": name, "url": share_url(id_, base, origin)})


def sms_href(message: Column) -> Column:
    return F.concat(F.lit("sms:?&body="), component_encode(message))


def host(raw: Column) -> Column:
    """The host of a website as it was typed: no www, lower case; null for mail addresses and other text."""
    x = F.trim(F.lower(raw))
    x = F.regexp_extract(x, r"^(?:https?://)?(?:www\.)?([a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})(?::\d+)?(?:[/?#].*)?$", 1)
    return F.nullif(x, F.lit(""))


def in_sitemap(page: Column) -> Column:
    """My list is private and the 404 page, /404.html or the site's own /404/, is no page; ids that end in 404 are."""
    return ~page.contains("/my-list/") & ~page.endswith("/404.html") & ~page.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)?/?404/?\z")
