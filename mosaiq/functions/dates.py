"""Partial dates: texts like 2026-09 or 2026-10-04, read by their characters and never moved by a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def parts(x: Column) -> Column:
    """(year, month, day); day is null for a month, all is null for a bare year, an impossible date or other text."""
    year, month, day = (F.try_to_number(F.regexp_extract(x, r"^(\d{4})-(\d{2})(?:-(\d{2}))?(?:T.*)?$", k), F.lit("9999" if k == 1 else "99")).cast("int") for k in (1, 2, 3))
    has_day = F.regexp_extract(x, r"^\d{4}-\d{2}-(\d{2})(?:T.*)?$", 1) != ""
    text = F.when(has_day, F.substring(x, 1, 10)).otherwise(F.concat(F.substring(x, 1, 7), F.lit("-01")))
    # to_date alone reads no impossible day or month.
    good = x.rlike(r"^\d{4}-\d{2}(-\d{2})?(T.*)?$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()
    return F.when(good, F.struct(year.alias("year"), month.alias("month"), F.when(has_day, day).alias("day")))


def _month_name(p: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), p["month"])


def month_year(x: Column) -> Column:
    p = parts(x)
    return F.concat(_month_name(p), F.lit(" "), p["year"].cast("string"))


def full_date(x: Column) -> Column:
    """October 4, 2026; without a day, October 2026."""
    p = parts(x)
    return F.coalesce(F.concat(_month_name(p), F.lit(" "), p["day"].cast("string"), F.lit(", "), p["year"].cast("string")), month_year(x))


def last_seen(x: Column) -> Column:
    return F.concat(F.lit("Last seen active: "), month_year(x))


def months_since(x: Column, now: Column) -> Column:
    """Calendar months from x to the date now."""
    p = parts(x)
    return (F.year(now) - p["year"]) * 12 + (F.month(now) - p["month"])


def month_key(x: Column) -> Column:
    """A number that sorts like the month; 0 for none."""
    p = parts(x)
    return F.coalesce(p["year"] * 12 + p["month"], F.lit(0))


def due(day: Column, today: Column) -> Column:
    """Plans whose day has passed."""
    return F.coalesce(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date") < today, F.lit(False))
