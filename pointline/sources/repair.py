"""A stored ledger and its roll-ups kept right while entries come late, are corrected or withdrawn.

Sums and counts are linear in the entries, so a change adds what its new version brings to each (player, period) and takes away what the stored
one brought. Only the days that hold either version are read of the ledger, and only the periods that change of the roll-ups; all else stays
untouched. Both tables change in one step, and the same changes applied again change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import rollups
from .store import Store
from .upkeep import upsert_latest

KEYS = ("player_id", "period_type", "period_start", "period_end")
MEASURES = ("sport_points", "academic_points", "total_points", "actions_count")


def create(held: Store, ledger: DataFrame, period_types: Sequence[str] = cal.PERIOD_TYPES) -> None:
    """The tables ``ledger``, stored by day, and ``period_stats``, stored by the start of the period."""
    held.create("ledger", ledger.withColumn("day", F.to_date("ts")), "day", ["day", "id"])
    held.create("period_stats", rollups.period_stats(held.read("ledger"), period_types), "period_start", KEYS[:3])


def difference(new: DataFrame, old: DataFrame, period_types: Sequence[str] = cal.PERIOD_TYPES) -> DataFrame:
    """What the roll-ups gain if the entries ``new`` take the place of ``old``; periods that gain nothing are left out."""
    less = rollups.period_stats(old, period_types).withColumns({m: -F.col(m) for m in MEASURES})
    both = rollups.period_stats(new, period_types).unionByName(less)
    return both.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]).where(" OR ".join(f"{m} <> 0" for m in MEASURES))


def apply_changes(held: Store, changes: DataFrame, period_types: Sequence[str] = cal.PERIOD_TYPES) -> dict[str, list[str]]:
    """Takes up entries with the ledger's columns and, where wanted, ``was_day`` (the day under which an earlier version is stored, if it
    is another one) and ``gone`` (true: the entry is withdrawn). Returns the partitions that were written anew.

    An entry that is stored under its day or under ``was_day`` is replaced, any other is added. Of several changes of an id the greatest
    row counts; changes without id or time are passed over. A withdrawn entry that is not stored changes nothing.
    """
    base, tables = held.snapshot()
    columns = held.read("ledger").columns
    optional = {"was_day": F.lit(None).cast("date"), "gone": F.lit(False)}
    full = changes.where("id IS NOT NULL AND ts IS NOT NULL").withColumns(
        {"day": F.to_date("ts"), **{name: value for name, value in optional.items() if name not in changes.columns}})
    full = full.select(*columns, "was_day", F.coalesce("gone", F.lit(False)).alias("gone"))
    wanted = upsert_latest(full.limit(0), full, ["id"]).persist()
    days = held.parts(wanted.select(F.explode(F.array("day", "was_day")).alias("day")).where("day IS NOT NULL"), tables["ledger"])
    stored, ids = held.read("ledger", days), wanted.select("id")
    new = wanted.where("NOT gone").select(*columns)
    gained = difference(new, stored.join(ids, "id", "left_semi"), period_types).persist()
    starts = held.parts(gained, tables["period_stats"])
    after, seen = dict(tables), {}
    if days:
        rows = stored.join(ids, "id", "left_anti").unionByName(new)
        after["ledger"], seen["ledger"] = held.replaced("ledger", tables["ledger"], days, rows), days
    if starts:
        sums = held.read("period_stats", starts).unionByName(gained).groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        after["period_stats"] = held.replaced("period_stats", tables["period_stats"], starts, sums.where("actions_count > 0"))
        seen["period_stats"] = starts
    if seen:
        held.commit(base, after)
    for frame in (wanted, gained):
        frame.unpersist()
    return seen
