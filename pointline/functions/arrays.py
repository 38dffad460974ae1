"""Bounded arrays and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_last(items: Column, n: int) -> Column:
    """The last ``n`` items of an array, in order."""
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def days_in_a_row(days: Column, n: int) -> Column:
    """True where the last ``n`` days of an ascending array follow each other without a gap."""
    first = F.element_at(keep_last(days, n), 1)
    return F.coalesce((F.size(days) >= n) & (F.datediff(F.element_at(days, -1), first) == n - 1), F.lit(False))


def to_json_days(days: Column) -> Column:
    return F.to_json(days)


def from_json_days(text: Column) -> Column:
    return F.from_json(text, "array<date>")
