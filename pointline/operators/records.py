"""Milestones, record progression, leaders of a period."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..session import shared_folder
from ..sources.sinks import reload_table
from .ordered import CHUNK_BITS, running_record, staircase, top_per_group

MILESTONES = (50, 100, 150, 200, 250)  # fixed values
MVP_METRICS = {"academic": "academic_points", "sport": "sport_points", "progression": "total_points"}


def first_to_milestone(totals: DataFrame, milestones: Sequence[int] = MILESTONES) -> DataFrame:
    """The first entry in the ledger to lift a total to each milestone; from running totals or their steps alone.

    An entry yields the milestones it crosses, mostly none; the minimum per milestone combines before the shuffle.
    """
    if min(milestones) <= 0:
        raise ValueError("players start at 0, so milestones are positive")
    steps = F.array(*[F.lit(m).cast("bigint") for m in milestones])
    crossed = F.filter(steps, lambda m: (F.col("prev_total") < m) & (F.col("total") >= m))
    entry = F.struct("player_id", F.col("total").alias("score"), F.col("ts").alias("date_achieved"))
    return totals.withColumn("milestone", F.explode(crossed)).groupBy("milestone").agg(
        F.min_by(entry, F.col("id")).alias("e")).select("milestone", "e.*")


def stored_steps(ledger: DataFrame, **chunking) -> DataFrame:
    """``ordered.staircase`` written once, as records and milestones read it several times."""
    return reload_table(staircase(ledger, **chunking), shared_folder(ledger.sparkSession, "steps"))


def record_progression(totals: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Every entry that set a new highest total, in the whole ledger; the last one is current."""
    return running_record(totals, bits).select(
        "id", "player_id", F.col("total").alias("score"), F.col("ts").alias("date_achieved"), "is_current")


def hall_of_fame(ledger: DataFrame, players: DataFrame, milestones: Sequence[int] = MILESTONES, **chunking) -> DataFrame:
    """Milestones and records in one table, with the player's team. The ledger is read once and its running total computed once."""
    totals = stored_steps(ledger, **chunking)
    firsts = first_to_milestone(totals, milestones).select(
        F.concat(F.lit("first_"), F.col("milestone").cast("string")).alias("record_type"),
        "player_id", "score", "date_achieved", F.lit(True).alias("is_current"))
    highs = record_progression(totals).select(
        F.lit("highest_score").alias("record_type"), "player_id", "score", "date_achieved", "is_current")
    return firsts.unionByName(highs).join(players.select("player_id", "team"), "player_id", "left").select(
        "record_type", "player_id", "team", "score", "date_achieved", "is_current")


def current_records(records: DataFrame) -> DataFrame:
    return records.where("is_current").orderBy(F.desc("score"), "record_type")


def latest_records(records: DataFrame, n: int = 50) -> DataFrame:
    return records.orderBy(F.desc("date_achieved"), "record_type", "player_id", F.desc("score")).limit(n)


def absolute_record(scores: DataFrame) -> DataFrame:
    return top_players(scores, 1)


def top_players(scores: DataFrame, n: int) -> DataFrame:
    """Best scores overall: each task keeps ``n`` rows, then they are merged."""
    return scores.orderBy(F.desc("score"), "player_id").limit(n)


def period_leaders(stats: DataFrame, players: DataFrame, scores: DataFrame, k: int = 1,
                   metrics: Sequence[str] = tuple(MVP_METRICS)) -> DataFrame:
    """The best ``k`` players of every period and metric with more than 0 points, and their overall score."""
    long = stats.select(*[c for c in stats.columns if c != "team"]).join(
        players.select("player_id", "team"), "player_id"
    ).select(
        "player_id", "team", "period_type", "period_start", "period_end",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("mvp_type"), F.col(MVP_METRICS[m]).alias("points_earned")) for m in metrics
        ])).alias("m")).select("*", "m.*").drop("m").where(F.col("points_earned") > 0)
    best = top_per_group(long, ["period_type", "period_start", "mvp_type"], [F.desc("points_earned"), F.col("player_id")], k)
    return best.join(scores, "player_id").select(
        "period_type", "period_start", "period_end", "mvp_type", "position", "player_id", "team", "points_earned",
        F.col("score").alias("total_score"))


def closed_periods(leaders: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Leaders of periods that ended before ``as_of``."""
    return leaders.where(F.col("period_end") < F.lit(as_of.date()))


def leader_history(leaders: DataFrame, period: str = "all", mvp_type: str = "all", limit: int = 20) -> DataFrame:
    """Latest closed periods first, optionally of one period type and metric."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must lie in 1..1000")
    if period != "all" and period not in cal.PERIOD_TYPES:
        raise ValueError(f"unknown period type {period!r}")
    wanted = F.lit(True)
    for column, value in (("period_type", period), ("mvp_type", mvp_type)):
        if value != "all":
            wanted = wanted & (F.col(column) == value)
    return leaders.where(wanted).orderBy(F.desc("period_end"), "period_type", "mvp_type", "position").limit(limit)
