"""What is known of each player: streaks, minima, counters, last entries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..functions import calendar as cal
from .ordered import running_state, running_total, top_per_group
from .rollups import actions_only, player_days


def entry_state(ledger: DataFrame, **chunking) -> DataFrame:
    """Score, streaks and lowest score of every player in one pass; see ``streaks`` and ``lowest_score``."""
    return running_state(ledger, **chunking).groupBy("player_id").agg(
        F.max_by("total", "id").alias("score"), F.max_by("streak", "id").alias("current_streak"),
        F.max("streak").alias("max_streak"), F.min("lowest").alias("lowest_score"))


def streaks(ledger: DataFrame, **chunking) -> DataFrame:
    """Current and longest run of positive entries; an entry of zero or less ends a run."""
    return entry_state(ledger, **chunking).select("player_id", "current_streak", "max_streak")


def lowest_score(ledger: DataFrame, **chunking) -> DataFrame:
    """Least running total, at most 0."""
    return entry_state(ledger, **chunking).select("player_id", "lowest_score")


def keyword_counters(ledger: DataFrame, praise: Sequence[str] = (text.PRAISE_KEYWORD,),
                     hard: Sequence[str] = (text.HARD_WORK_KEYWORD,), case_sensitive: bool = True) -> DataFrame:
    """How often each player was praised and worked hard, and on which days the latter happened.

    The days are a sorted array with one item per calendar day; the single times are in ``keyword_times``.
    """
    is_praise = text.contains_any(F.col("action"), praise, case_sensitive)
    is_hard = text.contains_any(F.col("action"), hard, case_sensitive)
    daily = actions_only(ledger).groupBy("player_id", F.to_date("ts").alias("day")).agg(
        F.count_if(is_praise).alias("p"), F.count_if(is_hard).alias("h"))
    return daily.groupBy("player_id").agg(
        F.sum("p").alias("praise_count"), F.sum("h").alias("hard_count"),
        F.sort_array(F.collect_list(F.when(F.col("h") > 0, F.col("day")))).alias("hard_days"))


def keyword_times(ledger: DataFrame, keywords: Sequence[str], case_sensitive: bool = True) -> DataFrame:
    """The times of keyword entries, one row each rather than one list per player."""
    hit = text.contains_any(F.col("action"), keywords, case_sensitive)
    return actions_only(ledger).where(hit).select("player_id", "id", "ts")


def active_days(days: DataFrame) -> DataFrame:
    """Days with a positive action per player (from ``player_days``), and when the first of the day came."""
    return days.where(F.col("positive_actions") > 0).select(
        "player_id", "day", F.col("first_positive_ts").alias("first_ts"))


def consecutive_days(days: DataFrame, keep: int = 7, run: int = 5) -> DataFrame:
    """The last ``keep`` positive days of each player, and whether the last ``run`` of them follow each other.

    The run need not be recent; ``last_day`` tells.
    """
    latest = top_per_group(active_days(days), ["player_id"], [F.desc("day")], keep)
    kept = latest.groupBy("player_id").agg(F.sort_array(F.collect_list("day")).alias("days"))
    return kept.select("player_id", "days", F.element_at("days", -1).alias("last_day"),
                       arrays.days_in_a_row(F.col("days"), run).alias("in_a_row"))


def trailing_count(ledger: DataFrame, keywords: Sequence[str], as_of: dt.datetime, days: int = 14,
                   at_least: int = 2, case_sensitive: bool = True) -> DataFrame:
    """Players with at least ``at_least`` keyword entries later than ``days`` days before ``as_of``."""
    since = as_of - dt.timedelta(days=days)
    recent = (F.col("ts") > cal.ntz(since)) & (F.col("ts") <= cal.ntz(as_of))
    hits = keyword_times(ledger.where(recent), keywords, case_sensitive)
    return hits.groupBy("player_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def first_time_within(times: DataFrame, k: int, days: int) -> DataFrame:
    """When each player first had ``k`` entries within less than ``days`` days.

    Of a player's day only its first ``k`` and last ``k - 1`` entries can matter: with more, the condition already holds at the
    k-th. So a player brings at most ``2k - 1`` rows per calendar day to the final window.
    """
    daily = times.withColumn("day", F.to_date("ts"))
    first = top_per_group(daily, ["player_id", "day"], ["id"], k)
    last = top_per_group(daily, ["player_id", "day"], [F.desc("id")], max(k - 1, 1))
    few = first.unionByName(last).drop("position").distinct()
    earlier = F.lag("ts", k - 1).over(Window.partitionBy("player_id").orderBy("id"))
    return few.withColumn("_earlier", earlier).where(
        F.col("ts") - F.expr(f"INTERVAL {days} DAYS") < F.col("_earlier")
    ).groupBy("player_id").agg(F.min("ts").alias("ts"))


def last_activity(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("player_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def latest_n(ledger: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` entries of every player, the latest first."""
    return top_per_group(ledger, ["player_id"], [F.desc("id")], n)


def latest_entries(ledger: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` entries of the whole ledger."""
    return ledger.orderBy(F.desc("id")).limit(n)


def opening_balance(days: DataFrame) -> DataFrame:
    """Each player's total before the first entry of every day with entries (from ``player_days``).

    Ids rise with time, so this is the sum of the days before, and no window has to see single entries.
    """
    before = Window.partitionBy("player_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.select("player_id", "day", F.coalesce(F.sum("points").over(before), F.lit(0)).alias("opening"))


def is_low_point():
    """A negative entry that leaves a negative total."""
    return (F.col("points") < 0) & (F.col("total") < 0)


def last_negative(ledger: DataFrame, **chunking) -> DataFrame:
    """When a player last had a negative entry that left a negative total."""
    totals = actions_only(running_total(ledger, **chunking))
    return totals.where(is_low_point()).groupBy("player_id").agg(F.max("ts").alias("last_negative"))


def team_last_negative(low_points: DataFrame, players: DataFrame) -> DataFrame:
    """The latest ``last_negative`` of any member, per team that has one."""
    low = low_points.where(F.col("last_negative").isNotNull())
    return low.join(players.select("player_id", "team"), "player_id").groupBy("team").agg(
        F.max("last_negative").alias("last_negative"))


def player_state(ledger: DataFrame, as_of: dt.datetime, praise: Sequence[str] = (text.PRAISE_KEYWORD,),
                 hard: Sequence[str] = (text.HARD_WORK_KEYWORD,), hard_days: int = 14, case_sensitive: bool = True,
                 **chunking) -> DataFrame:
    """One row of counters per player as of a moment; ``ledger`` must end there (see ``until``)."""
    is_hard = text.contains_any(F.col("action"), hard, case_sensitive)
    recent = F.col("ts") > cal.ntz(as_of - dt.timedelta(days=hard_days))
    in_period = {p: cal.within_days(F.col("ts"), *cal.period_range(as_of, p)) for p in ("week", "month")}
    state = actions_only(running_state(ledger, **chunking)).groupBy("player_id").agg(
        F.max_by("total", "id").alias("score"),
        F.max_by("streak", "id").alias("current_streak"), F.max("streak").alias("max_streak"),
        F.min("lowest").alias("lowest_score"),
        F.count_if(text.contains_any(F.col("action"), praise, case_sensitive)).alias("praise_count"),
        F.count_if(is_hard).alias("hard_count"), F.count_if(is_hard & recent).alias("hard_recent"),
        F.count_if((F.col("points") > 0) & in_period["week"]).alias("weekly_actions"),
        F.count_if((F.col("points") > 0) & in_period["month"]).alias("monthly_actions"),
        F.max("ts").alias("last_action"))
    days = consecutive_days(player_days(ledger)).select("player_id", F.col("days").alias("consecutive_days"), "in_a_row")
    return state.join(days, "player_id", "left").withColumn("in_a_row", F.coalesce("in_a_row", F.lit(False)))
