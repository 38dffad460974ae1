"""Progress of players over days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_total
from .rollups import until


def daily_progress(ledger: DataFrame, **chunking) -> DataFrame:
    """Per player and day: points, highest and closing total, entries, positive and negative points."""
    return running_total(ledger, **chunking).groupBy("player_id", F.to_date("ts").alias("day")).agg(
        F.sum("points").alias("daily_points"), F.max("total").alias("max_total"),
        F.max_by("total", "id").alias("close_total"), F.count(F.lit(1)).alias("actions_count"),
        F.sum(F.greatest("points", F.lit(0))).alias("positive_points"),
        F.sum(F.least("points", F.lit(0))).alias("negative_points"))


def recent_days(ledger: DataFrame, as_of: dt.datetime, days: int | None, **chunking) -> DataFrame:
    """``daily_progress`` of the last ``days`` days with ``initial`` and ``cumulative`` totals.

    Only entries of the window are put in order; all earlier ones go into one sum per player. ``days=None`` takes the whole
    ledger, with an initial total of 0.
    """
    ledger = until(ledger, as_of)
    by_day = Window.partitionBy("player_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    if days is None:
        daily = daily_progress(ledger, **chunking).withColumn("initial", F.lit(0).cast("bigint"))
    else:
        if not 0 <= days <= 365:
            raise ValueError("days must lie in 0..365")
        start = F.lit(as_of.date() - dt.timedelta(days=days)).cast("timestamp_ntz")
        before = ledger.where(F.col("ts") < start).groupBy("player_id").agg(F.sum("points").alias("initial"))
        daily = daily_progress(ledger.where(F.col("ts") >= start), **chunking).join(before, "player_id", "left")
        daily = daily.withColumn("initial", F.coalesce("initial", F.lit(0)))
        daily = daily.withColumns({c: F.col(c) + F.col("initial") for c in ("max_total", "close_total")})
    return daily.withColumn("cumulative", F.col("initial") + F.sum("daily_points").over(by_day))


def progress_curve(ledger: DataFrame, as_of: dt.datetime, days: int | None = 30, **chunking) -> DataFrame:
    """One row per player and calendar day; idle days carry the score.

    Players without entries in the window have no curve. Each active day is stretched over the idle days after it (the first
    one also over those before), so filling the gaps takes no join.
    """
    recent = recent_days(ledger, as_of, days, **chunking)
    active = {"daily_points": F.col("daily_points"), "max_total": F.col("max_total"),
              "cumulative": F.col("cumulative"), "actions_count": F.col("actions_count"),
              "positive_points": F.col("positive_points"), "negative_points": F.col("negative_points")}
    if days is None:
        return recent.select("player_id", "day", *active)
    first, last = F.lit(as_of.date() - dt.timedelta(days=days)), F.lit(as_of.date())
    order = Window.partitionBy("player_id").orderBy("day")
    begin = F.when(F.lag("day").over(order).isNull(), first).otherwise(F.col("day"))
    end = F.coalesce(F.date_sub(F.lead("day").over(order), 1), last)
    filled = recent.withColumns({"_begin": begin, "_end": end}).withColumn(
        "_day", F.explode(F.sequence("_begin", "_end")))
    here = F.col("_day") == F.col("day")
    carried = F.when(F.col("_day") < F.col("day"), F.col("initial")).otherwise(F.col("cumulative"))
    idle = {"max_total": carried, "cumulative": carried}
    return filled.select("player_id", F.col("_day").alias("day"), *[
        F.when(here, value).otherwise(idle.get(name, F.lit(0))).alias(name) for name, value in active.items()])


def progress_summary(ledger: DataFrame, as_of: dt.datetime, days: int | None = 30, **chunking) -> DataFrame:
    """Points gained, entries and active days in the window, per player with entries."""
    return recent_days(ledger, as_of, days, **chunking).groupBy("player_id").agg(
        F.max("initial").alias("initial"), F.sum("daily_points").alias("total_points"),
        F.sum("actions_count").alias("total_actions"), F.count(F.lit(1)).alias("active_days"))
