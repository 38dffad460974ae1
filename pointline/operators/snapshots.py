"""States that last: scores as intervals of days, daily ranks, conditions sustained over time.

A daily snapshot of all players would have players x days rows. A score only changes on days with entries, so it is kept
as one row per player and change with the days from which to which it holds. Daily ranks cut these intervals into dyadic spans, of
which each keeps its best rows alone; team conditions add up the changes per day. Neither expands players to days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from .ordered import top_per_group


def score_intervals(days: DataFrame, players: DataFrame, first_day: dt.date, last_day: dt.date) -> DataFrame:
    """Closing scores ``(player_id, team, from_day, to_day, score)`` that cover the days given without gaps.

    ``days`` is ``player_days`` up to the last day. Players start at 0. The window of a player sees one row per calendar day
    with entries. The team comes along with the starting row, which saves a join; without one, a player is left out.
    """
    last = F.lit(last_day)
    entries = days.select("player_id", F.lit(None).cast("string").alias("team"),
                          F.greatest("day", F.lit(first_day)).alias("day"), "points")
    start = players.select("player_id", "team", F.lit(first_day).alias("day"), F.lit(0).cast("bigint").alias("points"))
    daily = entries.unionByName(start).groupBy("player_id", "day").agg(
        F.sum("points").alias("points"), F.max("team").alias("team"))
    by_day = Window.partitionBy("player_id").orderBy("day")
    return daily.select(
        "player_id", F.max("team").over(Window.partitionBy("player_id")).alias("team"), F.col("day").alias("from_day"),
        F.coalesce(F.date_sub(F.lead("day").over(by_day), 1), last).alias("to_day"),
        F.sum("points").over(by_day.rowsBetween(Window.unboundedPreceding, 0)).alias("score"),
    ).where(F.col("team").isNotNull())


def each_day(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("day", F.explode(F.sequence("from_day", "to_day"))).drop("from_day", "to_day")


def dyadic_spans(intervals: DataFrame) -> DataFrame:
    """Each interval cut into spans of ``2 ** level`` days that begin at multiples of their length since 1970: ``_level, _span``.

    At most two spans of a length are needed, of lengths up to the interval's own; one of a day or two stays as it is.
    """
    days = intervals.withColumns({"_begin": F.unix_date("from_day"), "_end": F.unix_date(F.date_add("to_day", 1))})
    levels = F.expr("sequence(0, cast(log2(_end - _begin) + 0.01 as int))")  # one level too many does no harm
    inner = days.where("_begin < _end").withColumn("_level", F.explode(levels)).withColumns({
        "_first": F.expr("shiftright(_begin + shiftleft(1, _level) - 1, _level)"), "_past": F.expr("shiftright(_end, _level)")})
    ends = F.expr("array(if(_first < _past and _first & 1 = 1, _first, null), if(_first < _past and _past & 1 = 1, _past - 1, null))")
    return inner.withColumn("_span", F.explode(ends)).where("_span is not null").drop("_begin", "_end", "_first", "_past")


def best_spans(intervals: DataFrame, k: int, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The spans that can hold one of the ``k`` first of a day: whoever is not among the ``k`` first of the rows that cover a whole span
    has ``k`` others before them on each of its days. Every task gives on ``k`` rows a group and span at most."""
    return top_per_group(dyadic_spans(intervals), [*groups, "_level", "_span"], order, k).drop("position")


def daily_best(intervals: DataFrame, k: int, groups: Sequence[str] = (), worst: bool = False) -> DataFrame:
    """The ``k`` best (or worst) players of every day, per group, ranked by score, then player; exact.

    A day lies in one span of each length, so at most ``k`` rows per day and length are left to be ranked, however many players there
    are and wherever their scores began.
    """
    sign = -1 if worst else 1
    signed = intervals.select("player_id", "team", "from_day", "to_day", (F.col("score") * sign).alias("_score"), (F.col("player_id") * sign).alias("_id"))
    order = [F.desc("_score"), F.col("_id")]
    spans = best_spans(signed, k, groups, order).withColumns({
        "from_day": F.expr("date_from_unix_date(shiftleft(_span, _level))"), "to_day": F.expr("date_from_unix_date(shiftleft(_span + 1, _level) - 1)")})
    best = top_per_group(each_day(spans), [*groups, "day"], order, k)
    return best.select("day", "player_id", "team", (F.col("_score") * sign).alias("score"), "position")


def calendar_of(keys: DataFrame, first_day: dt.date, last_day: dt.date) -> DataFrame:
    """Every key on every day; meant for teams, whose number is small."""
    return keys.withColumn("day", F.explode(F.sequence(F.lit(first_day), F.lit(last_day))))


def team_days_all(intervals: DataFrame, players: DataFrame, holds: Column, first_day: dt.date,
                  last_day: dt.date) -> DataFrame:
    """Days on which ``holds`` is true of the score of every member of a team.

    Counts the members for whom it fails: +1 on the first day of a failing interval, -1 on the day after its last. Changes before
    ``first_day`` open the count.
    """
    failing = intervals.where(~holds)
    changes = failing.select("team", F.explode(F.array(
        F.struct(F.col("from_day").alias("day"), F.lit(1).alias("n")),
        F.struct(F.date_add("to_day", 1).alias("day"), F.lit(-1).alias("n")),
    )).alias("c")).groupBy("team", F.greatest("c.day", F.lit(first_day)).alias("day")).agg(F.sum("c.n").alias("n"))
    days = calendar_of(players.select("team").distinct(), first_day, last_day)
    so_far = Window.partitionBy("team").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(changes, ["team", "day"], "left").withColumn(
        "_failing", F.sum(F.coalesce("n", F.lit(0))).over(so_far)).where(F.col("_failing") == 0).select("team", "day")


def sustained(days: DataFrame, entity: str, months: int = 0, extra_days: int = 0) -> DataFrame:
    """Unbroken runs of days in ``days (entity, day)`` that last ``months`` calendar months and ``extra_days`` days.

    ``held_on`` is the first day on which the run was long enough. A window sees one row per entity and calendar day.
    """
    numbered = days.select(entity, "day").distinct().withColumn(
        "_run", F.date_sub("day", F.row_number().over(Window.partitionBy(entity).orderBy("day"))))
    runs = numbered.groupBy(entity, "_run").agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"))
    return runs.withColumn(
        "held_on", F.date_add(cal.month_shift_day(F.col("from_day"), months), extra_days)
    ).where(F.col("to_day") >= F.col("held_on")).select(entity, "from_day", "to_day", "held_on")


def first_held(runs: DataFrame, entity: str) -> DataFrame:
    return runs.groupBy(entity).agg(F.min("held_on").alias("held_on"))


def rank_turnaround(intervals: DataFrame, players: DataFrame, top: int = 3, bottom: int = 2,
                    min_team: int = 3) -> DataFrame:
    """Players who were among the last ``bottom`` of their team and on a later day among its first ``top``."""
    big = players.groupBy("team").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_team).select("team")
    low = daily_best(intervals, bottom, ["team"], worst=True).groupBy("player_id", "team").agg(
        F.min("day").alias("bottom_day")).join(big, "team", "left_semi")
    high = daily_best(intervals, top, ["team"]).select("player_id", F.col("day").alias("top_day"))
    return low.join(high, "player_id").where(F.col("top_day") > F.col("bottom_day")).groupBy(
        "player_id", "team", "bottom_day").agg(F.min("top_day").alias("top_day"))


def team_days_in_top(intervals: DataFrame, k: int = 10, members: int = 3) -> DataFrame:
    """Days on which a team has at least ``members`` of the overall top ``k``."""
    return daily_best(intervals, k).groupBy("team", "day").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= members).select("team", "day")


def team_daily_totals(days: DataFrame, players: DataFrame, first_day: dt.date, last_day: dt.date) -> DataFrame:
    """Closing total of every team on every day, from ``player_days`` up to the last one."""
    gains = days.join(players.select("player_id", "team"), "player_id").groupBy(
        "team", F.greatest("day", F.lit(first_day)).alias("day")).agg(F.sum("points").alias("points"))
    so_far = Window.partitionBy("team").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return calendar_of(players.select("team").distinct(), first_day, last_day).join(
        gains, ["team", "day"], "left"
    ).select("team", "day", F.sum(F.coalesce("points", F.lit(0))).over(so_far).alias("total"))


def team_positions(totals: DataFrame, moment: str = "day") -> DataFrame:
    """Place of every team at every moment; a moment has one row per team."""
    order = Window.partitionBy(moment).orderBy(F.desc("total"), "team")
    return totals.withColumn("position", F.row_number().over(order))


def team_rank_history(positions: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Per team the list of its places over the last ``days`` days, oldest first."""
    recent = positions.where(F.col("day") >= F.lit(as_of.date() - dt.timedelta(days=days)))
    return recent.groupBy("team").agg(
        F.sort_array(F.collect_list(F.struct("day", "position", "total"))).alias("history"))


def team_hours(ledger: DataFrame, players: DataFrame) -> DataFrame:
    """Points per team and hour with entries; summed per player first."""
    hour = F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour("ts"))
    gains = ledger.groupBy("player_id", hour.alias("hour")).agg(F.sum("points").alias("points"))
    return gains.join(players.select("player_id", "team"), "player_id").groupBy("team", "hour").agg(
        F.sum("points").alias("points"))


def hourly_positions(hourly: DataFrame, teams: DataFrame, first_hour: dt.datetime, as_of: dt.datetime) -> DataFrame:
    """Total and place of every team at the end of each full hour up to ``as_of``; from ``team_hours``.

    What lies before ``first_hour`` opens the totals.
    """
    hourly = hourly.groupBy("team", F.greatest("hour", cal.ntz(first_hour)).alias("hour")).agg(F.sum("points").alias("points"))
    last_hour = as_of.replace(minute=0, second=0, microsecond=0) - dt.timedelta(hours=1)
    checks = teams.select("team").distinct().withColumn("hour", F.explode(F.sequence(
        cal.ntz(first_hour), cal.ntz(last_hour), F.expr("INTERVAL 1 HOUR"))))
    so_far = Window.partitionBy("team").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    totals = checks.join(hourly, ["team", "hour"], "left").select(
        "team", "hour", F.sum(F.coalesce("points", F.lit(0))).over(so_far).alias("total"))
    return team_positions(totals, "hour")


def hours_at_top(hourly: DataFrame, teams: DataFrame, first_hour: dt.datetime, as_of: dt.datetime) -> DataFrame:
    """In how many hourly checks, each at the end of a full hour up to ``as_of``, a team led."""
    return hourly_positions(hourly, teams, first_hour, as_of).groupBy("team").agg(
        F.count_if(F.col("position") == 1).alias("hours"))
