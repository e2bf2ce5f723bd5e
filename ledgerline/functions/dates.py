"""Date column helpers: tolerant parsing, keys, buckets and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# ISO-style dates as the reference's engine casts them: year, month, day
# separated consistently by '-', '/' or ' ', optionally followed by a time of
# day; anything else never reaches the cast (Spark would read '2024' as a date).
_ISO = r"^(\d{1,4})([-/ ])(\d{1,2})\2(\d{1,2})(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_mixed_date(c: Column | str) -> Column:
    """ISO ``yyyy-m-d`` (also '/' or ' ' separated, time part ignored) or US
    ``m/d/yyyy`` text -> DATE; anything else, or an impossible date, NULL."""
    t = F.regexp_replace(_col(c), r"^\s+|\s+$", "")
    iso_text = F.concat_ws(
        "-",
        F.lpad(F.regexp_extract(t, _ISO, 1), 4, "0"),
        F.regexp_extract(t, _ISO, 3),
        F.regexp_extract(t, _ISO, 4),
    )
    iso = F.when(t.rlike(_ISO), iso_text.try_cast("date"))
    us = F.try_to_date(t, "M/d/yyyy")
    return F.coalesce(iso, us)


def date_key(d: Column | str) -> Column:
    """Integer ``yyyymmdd`` key."""
    d = _col(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def bucket(interval: str, d: Column | str) -> Column:
    """Start of the day/week/month/quarter/year containing ``d`` (weeks start Monday)."""
    if interval not in ("day", "week", "month", "quarter", "year"):
        raise ValueError(f"unknown interval {interval!r}")
    d = _col(d)
    if interval == "day":
        return d.cast("date")
    return F.date_trunc(interval, d).cast("date")


def shift_months(d: Column | str, months: int) -> Column:
    """First day of the month ``months`` calendar months after ``d``'s month."""
    return F.add_months(F.trunc(_col(d), "month"), months)


def calendar_attributes(d: Column | str) -> dict[str, Column]:
    """The 13 calendar attributes of one date, ISO year/week paired."""
    d = _col(d)
    dow = F.extract(F.lit("DAYOFWEEK_ISO"), d).cast("int")
    return {
        "date_key": date_key(d),
        "calendar_date": d,
        "year": F.year(d),
        "quarter": F.quarter(d),
        "month": F.month(d),
        "month_name": F.date_format(d, "MMMM"),
        "month_start": F.trunc(d, "month"),
        "week_start": F.date_trunc("week", d).cast("date"),
        "iso_year": F.extract(F.lit("YEAROFWEEK"), d).cast("int"),
        "iso_week": F.weekofyear(d),
        "weekday_number": dow,
        "weekday_name": F.date_format(d, "EEEE"),
        "is_weekend": dow.isin(6, 7),
    }
