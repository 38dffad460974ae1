"""Calendar buckets and month arithmetic.

Columns are TIMESTAMP_NTZ or DATE. Buckets are taken in UTC unless ``tz`` names another zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD_TYPES = ("week", "month", "term")


def local_day(ts: Column, tz: str | None = None) -> Column:
    """DATE of a UTC wall-clock timestamp, seen from zone ``tz``."""
    if tz is not None:
        ts = F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)
    return F.to_date(ts)


def week_bounds(day: Column) -> tuple[Column, Column]:
    """Monday and Sunday of the week."""
    start = F.trunc(day, "week")
    return start, F.date_add(start, 6)


def month_bounds(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "month"), F.last_day(day)


def term_bounds(day: Column, strict: bool = False) -> tuple[Column, Column]:
    """School term: Sep-Dec, Jan-Mar, else Apr-Jun.

    July and August fall to the Apr-Jun term although its bounds end before them; ``strict`` gives
    them no term at all (NULL).
    """
    year, month = F.year(day), F.month(day)
    start_month = F.when(month >= 9, 9).when(month <= 3, 1)
    last_month = F.when(month >= 9, 12).when(month <= 3, 3)
    if strict:
        start_month, last_month = start_month.when(month <= 6, 4), last_month.when(month <= 6, 6)
    else:
        start_month, last_month = start_month.otherwise(4), last_month.otherwise(6)
    return (
        F.make_date(year, start_month, F.lit(1)),
        F.last_day(F.make_date(year, last_month, F.lit(1))),
    )


def period_bounds(day: Column, period_type: str, strict_terms: bool = False) -> tuple[Column, Column]:
    if period_type == "week":
        return week_bounds(day)
    if period_type == "month":
        return month_bounds(day)
    if period_type == "term":
        return term_bounds(day, strict_terms)
    raise ValueError(f"unknown period type {period_type!r}; expected one of {PERIOD_TYPES}")


def period_range(as_of: dt.datetime, period_type: str) -> tuple[dt.date, dt.date]:
    """First and last day of the period around ``as_of``, as literals a scan filter can use."""
    day = as_of.date()
    if period_type == "week":
        start = day - dt.timedelta(days=day.weekday())
        return start, start + dt.timedelta(days=6)
    if period_type == "month":
        first, last = (day.year, day.month), (day.year, day.month)
    elif period_type == "term":
        low, high = (9, 12) if day.month >= 9 else (1, 3) if day.month <= 3 else (4, 6)
        first, last = (day.year, low), (day.year, high)
    else:
        raise ValueError(f"unknown period type {period_type!r}; expected one of {PERIOD_TYPES}")
    after = dt.date(last[0] + last[1] // 12, last[1] % 12 + 1, 1)
    return dt.date(*first, 1), after - dt.timedelta(days=1)


def within_days(ts: Column, first: dt.date, last: dt.date) -> Column:
    """Half-open range test on the raw timestamp, so that Parquet can skip row groups."""
    return (ts >= ntz(first)) & (ts < ntz(last + dt.timedelta(days=1)))


def ntz(value: dt.datetime | dt.date) -> Column:
    """TIMESTAMP_NTZ literal."""
    return F.lit(str(value)).cast("timestamp_ntz")


def as_instant(wall_clock: Column) -> Column:
    """TIMESTAMP whose UTC reading is the given TIMESTAMP_NTZ, whatever the session's zone (watermarks need one)."""
    return F.from_utc_timestamp(wall_clock.cast("timestamp"), F.current_timezone())


def as_wall_clock(instant: Column) -> Column:
    """The way back: the UTC reading of a TIMESTAMP as TIMESTAMP_NTZ."""
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


def month_shift(ts: Column, months: int) -> Column:
    """Add calendar months, carrying a day past the month's end into the next one (31 Jan + 1 = 2 Mar)."""
    day = F.to_date(ts)
    shifted = F.date_add(F.add_months(F.trunc(day, "month"), months), F.dayofmonth(day) - 1)
    return shifted.cast("timestamp_ntz") + (ts - day.cast("timestamp_ntz"))


def month_shift_day(day: Column, months: int) -> Column:
    """``month_shift`` for DATE columns."""
    return F.date_add(F.add_months(F.trunc(day, "month"), months), F.dayofmonth(day) - 1)


def months_before(as_of: dt.datetime, months: int) -> dt.datetime:
    """``month_shift`` backwards on a driver-side literal."""
    index = as_of.year * 12 + as_of.month - 1 - months
    first = as_of.replace(year=index // 12, month=index % 12 + 1, day=1)
    return first + dt.timedelta(days=as_of.day - 1)


def month_index(ts: Column) -> Column:
    """Months since year 0; differences ignore the day of month."""
    return F.year(ts) * 12 + F.month(ts)
