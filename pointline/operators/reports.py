"""Reports and export sheets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text
from .rollups import actions_only, points_in, row_count


def _period_rows(ledger: DataFrame, as_of: dt.datetime, period_type: str) -> DataFrame:
    """Entries of the period around ``as_of``; the range is a literal, so the scan skips the rest."""
    return ledger.where(cal.within_days(F.col("ts"), *cal.period_range(as_of, period_type)))


def _with_shares(totals: DataFrame) -> DataFrame:
    whole = F.col("total_sport") + F.col("total_academic")
    return totals.withColumns({
        "sport_percentage": text.share_pct(F.col("total_sport"), whole),
        "academic_percentage": text.share_pct(F.col("total_academic"), whole)})


def team_breakdown(ledger: DataFrame, players: DataFrame, as_of: dt.datetime, period_type: str = "week") -> DataFrame:
    """Signed points of the period per team and category, and the shares; teams with entries only."""
    per_player = _period_rows(actions_only(ledger), as_of, period_type).groupBy("player_id").agg(
        points_in("sport").alias("sport"), points_in("academic").alias("academic"), F.sum("points").alias("total"))
    return _with_shares(per_player.join(players.select("player_id", "team"), "player_id").groupBy("team").agg(
        F.sum("sport").alias("total_sport"), F.sum("academic").alias("total_academic"),
        F.sum("total").alias("total_points"), row_count().alias("active_players")))


def breakdown_from_ledger(ledger: DataFrame, players: DataFrame, as_of: dt.datetime,
                          period_type: str = "week") -> DataFrame:
    """The same from positive points only, for all teams and all entries."""
    per_player = _period_rows(ledger, as_of, period_type).groupBy("player_id").agg(
        points_in("sport", True).alias("sport"), points_in("academic", True).alias("academic"),
        F.sum(F.greatest("points", F.lit(0))).alias("total"))

    def total(column: str):
        return F.coalesce(F.sum(column), F.lit(0))

    return _with_shares(players.select("player_id", "team").join(per_player, "player_id", "left").groupBy("team").agg(
        total("sport").alias("total_sport"), total("academic").alias("total_academic"),
        total("total").alias("total_points"), F.count("total").alias("active_players")))


def most_balanced(breakdown: DataFrame) -> DataFrame:
    """The team nearest to half and half; ties go to more points, then to the name."""
    distance = F.abs(50 - F.col("sport_percentage"))
    return breakdown.where((F.col("total_points") > 0) & (distance < 100)).orderBy(
        distance, F.desc("total_points"), "team").limit(1)


def most_active(breakdown: DataFrame) -> DataFrame:
    """The team with the most active players; of equals the last one by points."""
    return breakdown.orderBy(F.desc("active_players"), "total_points", F.desc("team")).limit(1)


def breakdown_totals(breakdown: DataFrame) -> DataFrame:
    """Teams and, under ``ALL``, their grand total."""
    return breakdown.rollup("team").agg(
        F.sum("total_sport").alias("total_sport"), F.sum("total_academic").alias("total_academic"),
        F.sum("total_points").alias("total_points"), F.sum("active_players").alias("active_players"),
        F.grouping("team").alias("_g"),
    ).withColumn("team", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("team"))).drop("_g")


def player_sheet(scores: DataFrame, month_stats: DataFrame, state: DataFrame, badges: DataFrame) -> DataFrame:
    """Export rows per player: score, this month's points per category, streaks, badges."""
    counts = badges.groupBy("player_id").agg(row_count().alias("badge_count"))
    zero = F.lit(0)
    return (
        scores.join(month_stats.select("player_id", "sport_points", "academic_points"), "player_id", "left")
        .join(state.select("player_id", "current_streak", "max_streak"), "player_id", "left")
        .join(counts, "player_id", "left")
        .select("name", "team", "score", *[
            F.coalesce(c, zero).alias(c)
            for c in ("sport_points", "academic_points", "current_streak", "max_streak", "badge_count")])
        .orderBy("team", F.desc("score"), "name"))


def team_sheet(summary: DataFrame) -> DataFrame:
    return summary.select(
        "team", "total_score", "n_players", text.one_decimal(F.col("avg_score")).alias("avg_score"), "best_score",
        "worst_score").orderBy(F.desc("total_score"), "team")


def team_badge_sheet(team_badges: DataFrame) -> DataFrame:
    return team_badges.groupBy("team").agg(row_count().alias("n_badges"), F.sum("points").alias("badge_points"))


def badges_with_team(badges: DataFrame, players: DataFrame) -> DataFrame:
    return badges.join(players.select("player_id", "team"), "player_id")


def badge_feed(badges: DataFrame, team_badges: DataFrame, players: DataFrame) -> DataFrame:
    """Player and team badges in one list, newest first."""
    shown = ["team", "badge_id", "badge_name", "points", "rarity", "date_earned"]
    mine = badges_with_team(badges, players).select(F.lit("player").alias("scope"), "player_id", *shown)
    ours = team_badges.select(F.lit("team").alias("scope"), F.lit(None).cast("bigint").alias("player_id"), *shown)
    return mine.unionByName(ours).orderBy(F.desc("date_earned"), "scope", "player_id", "badge_id")


def badge_leaders(badges: DataFrame, players: DataFrame, n: int = 10) -> DataFrame:
    per_player = badges.groupBy("player_id").agg(row_count().alias("badge_count"), F.sum("points").alias("bonus_points"))
    return per_player.join(players.select("player_id", "team"), "player_id").orderBy(
        F.desc("badge_count"), F.desc("bonus_points"), "player_id").limit(n)


def players_with_badges(players: DataFrame, badges: DataFrame) -> DataFrame:
    """Players with their badges as an array; a player has one per rule at most."""
    held = badges.groupBy("player_id").agg(
        F.sort_array(F.collect_list(F.struct("badge_id", "badge_name", "rarity"))).alias("badges"))
    return players.join(held, "player_id", "left").withColumn(
        "badges", F.coalesce("badges", F.expr("CAST(array() AS array<struct<badge_id:string,badge_name:string,rarity:string>>)")))


def badge_count_per_player(players: DataFrame, badges: DataFrame) -> DataFrame:
    counts = badges.groupBy("player_id").agg(row_count().alias("badge_count"))
    return players.select("player_id").join(counts, "player_id", "left").select(
        "player_id", F.coalesce("badge_count", F.lit(0)).alias("badge_count"))


def reserve_pool(scores: DataFrame, badges: DataFrame, streaks: DataFrame, pool: str) -> DataFrame:
    """Players of one team with badge count and streaks; badges are counted before the join, so nothing fans out."""
    counts = badges.groupBy("player_id").agg(F.count_distinct("badge_id").alias("badge_count"))
    zero = F.lit(0)
    return scores.where(F.col("team") == pool).join(counts, "player_id", "left").join(streaks, "player_id", "left").select(
        "player_id", "name", "score", F.coalesce("badge_count", zero).alias("badge_count"),
        F.coalesce("current_streak", zero).alias("current_streak"), F.coalesce("max_streak", zero).alias("max_streak"),
    ).orderBy(F.desc("score"), "name")


def rule_holders(spark_rules: DataFrame, badges: DataFrame) -> DataFrame:
    """The rule list with the number of players holding each badge."""
    held = badges.groupBy("badge_id").agg(row_count().alias("holders"))
    return spark_rules.join(held, "badge_id", "left").withColumn("holders", F.coalesce("holders", F.lit(0)))
