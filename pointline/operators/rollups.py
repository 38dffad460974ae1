"""Scores, period roll-ups and team totals.

Everything is summed per player and day (or per player) first. That aggregate combines before its shuffle, shrinks the
ledger, and keeps joins to the players free of hot keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text


def row_count():
    return F.count(F.lit(1))


def until(ledger: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Entries up to and including ``as_of``; the test reaches the scan."""
    return ledger.where(F.col("ts") <= cal.ntz(as_of))


def actions_only(ledger: DataFrame) -> DataFrame:
    """Without the rows the engine added, which roll-ups and player state leave out."""
    return ledger.where(F.col("kind") == "action") if "kind" in ledger.columns else ledger


def points_in(category: str, positive: bool = False):
    points = F.greatest("points", F.lit(0)) if positive else F.col("points")
    return F.sum(F.when(F.col("category") == category, points).otherwise(0))


def player_days(ledger: DataFrame) -> DataFrame:
    """One row per player and day with entries: the base of everything that needs no single entries.

    ``points`` and ``positive_entries`` include system rows, the other columns do not.
    """
    action = F.col("kind") == "action" if "kind" in ledger.columns else F.lit(True)
    gain = F.col("points") > 0
    return ledger.groupBy("player_id", F.to_date("ts").alias("day")).agg(
        F.sum("points").alias("points"), F.count_if(gain).alias("positive_entries"),
        F.count_if(action & gain).alias("positive_actions"),
        F.sum(F.when(action & gain, F.col("points")).otherwise(0)).alias("positive_points"),
        F.min(F.when(action & gain, F.col("ts"))).alias("first_positive_ts"))


def player_scores(ledger: DataFrame) -> DataFrame:
    """Sum of points per player, of a ledger or of ``player_days``."""
    return ledger.groupBy("player_id").agg(F.sum("points").alias("score"))


def scoreboard(players: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every player with the score from the ledger, 0 without entries."""
    return players.join(player_scores(ledger), "player_id", "left").withColumn(
        "score", F.coalesce("score", F.lit(0)))


def period_stats(ledger: DataFrame, period_types: Sequence[str] = cal.PERIOD_TYPES, tz: str | None = None,
                 strict_terms: bool = False) -> DataFrame:
    """Signed points per player and period, in total and per category, and the number of entries.

    With a ``team`` column in the ledger, the team at the first entry of the period is kept.
    """
    with_team = "team" in ledger.columns
    team_day = [F.min_by("team", "id").alias("_team"), F.min("id").alias("_id")] if with_team else []
    team_period = [F.min_by("_team", "_id").alias("team")] if with_team else []
    daily = actions_only(ledger).groupBy("player_id", cal.local_day(F.col("ts"), tz).alias("day")).agg(
        points_in("sport").alias("sport"), points_in("academic").alias("academic"), F.sum("points").alias("total"),
        row_count().alias("n"), *team_day)
    bounds = {t: cal.period_bounds(F.col("day"), t, strict_terms) for t in period_types}
    periods = F.array(*[
        F.struct(F.lit(t).alias("period_type"), start.alias("period_start"), end.alias("period_end"))
        for t, (start, end) in bounds.items()])
    return daily.withColumn("p", F.explode(periods)).where(F.col("p.period_start").isNotNull()).groupBy(
        "player_id", "p.period_type", "p.period_start", "p.period_end"
    ).agg(
        F.sum("sport").alias("sport_points"), F.sum("academic").alias("academic_points"),
        F.sum("total").alias("total_points"), F.sum("n").alias("actions_count"), *team_period)


def reclassify(ledger: DataFrame, rules: text.CategoryRules) -> DataFrame:
    """Entries of unknown or missing category classified anew."""
    unknown = F.col("category").isNull() | (F.col("category") == "unknown")
    return ledger.withColumn(
        "category", F.when(unknown, text.classify(F.col("action"), rules)).otherwise(F.col("category")))


def period_type_summary(stats: DataFrame) -> DataFrame:
    return stats.groupBy("period_type").agg(
        row_count().alias("rows"), F.sum("total_points").alias("total_points"),
        F.max("period_start").alias("latest_start"))


def team_ranking(scores: DataFrame) -> DataFrame:
    """Teams by the sum of their members' scores."""
    return scores.groupBy("team").agg(F.sum("score").alias("total")).orderBy(F.desc("total"), "team")


def team_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("team").agg(
        F.sum("score").alias("total_score"), row_count().alias("n_players"), F.avg("score").alias("avg_score"),
        F.max("score").alias("best_score"), F.min("score").alias("worst_score"))


def group_stats(scores: DataFrame) -> DataFrame:
    """One row over all given players."""
    return scores.agg(
        row_count().alias("total_players"), F.sum("score").alias("total_points"),
        F.round(F.avg("score"), 6).alias("avg_points"), F.max("score").alias("max_points"),
        F.min("score").alias("min_points"))


def team_totals(scores: DataFrame, direct: DataFrame) -> DataFrame:
    """Members' scores plus team-direct points, per team of the dimension."""
    members = scores.groupBy("team").agg(F.sum("score").alias("players_total"))
    own = direct.groupBy("team").agg(F.sum("points").alias("_direct"))
    points = F.coalesce("_direct", F.lit(0))
    return members.join(own, "team", "left").select(
        "team", "players_total", points.alias("team_points"), (F.col("players_total") + points).alias("total"))


def team_direct_totals(direct: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Signed team-direct points: all, this week, this month."""
    recent = until(direct, as_of)
    sums = {"total_points": F.sum("points")}
    for name in ("week", "month"):
        first, last = cal.period_range(as_of, name)
        sums[f"{name}_points"] = F.sum(F.when(cal.within_days(F.col("ts"), first, last), F.col("points")).otherwise(0))
    return recent.groupBy("team").agg(*[e.alias(n) for n, e in sums.items()], row_count().alias("entries"))


def team_day_points(days: DataFrame, players: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """Points a team gains per day: members' positive points (from ``player_days``) plus signed team-direct points."""
    gained = days.where(F.col("positive_points") > 0).join(players.select("player_id", "team"), "player_id").select(
        "team", "day", F.col("positive_points").alias("points"))
    if direct is not None:
        gained = gained.unionByName(direct.select("team", F.to_date("ts").alias("day"), "points"))
    return gained.groupBy("team", "day").agg(F.sum("points").alias("points"))


def team_period_points(days: DataFrame, players: DataFrame, direct: DataFrame | None = None,
                       period_types: Sequence[str] = ("week", "month")) -> DataFrame:
    """``team_day_points`` per calendar week and month; a new period starts from nothing."""
    return by_period(team_day_points(days, players, direct), period_types).groupBy(
        "team", "period_type", "period_start").agg(F.sum("points").alias("points"))


def by_period(daily: DataFrame, period_types: Sequence[str]) -> DataFrame:
    """Repeats each daily row for every period type, with ``period_start``."""
    periods = F.array(*[
        F.struct(F.lit(t).alias("period_type"), cal.period_bounds(F.col("day"), t)[0].alias("period_start"))
        for t in period_types])
    return daily.withColumn("_p", F.explode(periods)).select("*", "_p.period_type", "_p.period_start").drop("_p")


def player_period_actions(days: DataFrame) -> DataFrame:
    """Positive actions per player, week and month."""
    active = days.where(F.col("positive_actions") > 0)
    return by_period(active, ("week", "month")).groupBy("player_id", "period_type", "period_start").agg(
        F.sum("positive_actions").alias("positive_actions"))


def active_players_per_day(days: DataFrame, players: DataFrame) -> DataFrame:
    """How many members of a team have a positive entry on a day."""
    active = days.where(F.col("positive_entries") > 0).select("player_id", "day")
    return active.join(players.select("player_id", "team"), "player_id").groupBy("team", "day").agg(
        row_count().alias("active"))
