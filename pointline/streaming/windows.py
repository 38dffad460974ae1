"""Hourly, weekly and monthly team points on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal

LATENESS = "1 day"


def week_points(entries: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Positive points per player and Monday-based week: in append mode once the week is over by the watermark, in update
    mode so far. Players meet their teams only after that (``per_team``), so no row-level join stands in the stream.

    Epoch day 0 was a Thursday, so windows of seven days start on Mondays when shifted by four.
    """
    gains = entries.where(F.col("points") > 0).withWatermark("ts", lateness)
    return gains.groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("w"), "player_id").agg(
        F.sum("points").alias("points")).select("player_id", cal.as_wall_clock(F.col("w.start")).alias("week_start"), "points")


def hour_points(entries: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Signed points per player and hour: in append mode once the hour is over by the watermark, in update mode so far."""
    hour = cal.as_wall_clock(F.col("w.start"))
    return entries.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("w"), "player_id").agg(
        F.sum("points").alias("points")).select("player_id", hour.alias("hour"), F.to_date(hour).alias("day"), "points")


def month_points(entries: DataFrame) -> DataFrame:
    """Positive points per player and month so far, for update mode; the state has a row per player and month."""
    month = F.date_format(cal.as_wall_clock(F.col("ts")), "yyyy-MM")
    return entries.where(F.col("points") > 0).groupBy("player_id", month.alias("month")).agg(F.sum("points").alias("points"))


def per_team(points: DataFrame, players: DataFrame, bucket: str) -> DataFrame:
    """Sums of the teams' players, from what a stream has emitted."""
    return points.join(players.select("player_id", "team"), "player_id").groupBy("team", bucket).agg(
        F.sum("points").alias("points"))
