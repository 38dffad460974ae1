"""Award rules for players and teams.

Rules are data. A player rule's predicate is SQL over state columns (``streak``, ``total``, ``lowest``, ``praise``,
``hard_recent``, ``five_in_a_row``), so one pass over the running state judges all of them. Awards come in two forms: *first
time* (the moment the condition first held in the ledger) and *as of* a given moment. Bonus points do not feed back into the
rules: a complete ledger has their rows already.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text
from . import rollups, snapshots, state
from .ordered import running_state, top_per_group


class Rule(NamedTuple):
    badge_id: str
    scope: str
    badge_name: str
    points: int
    rarity: str
    predicate: str | None = None


# Identifiers, names, bonus points and rarities of the awards, and the thresholds in the predicates.
RULES = (
    Rule("hot_streak", "player", "Hot Streak", 5, "bronze", "streak >= 5"),
    Rule("tsunami", "player", "Tsunami", 10, "argent", "streak >= 10"),
    Rule("unstoppable", "player", "Unstoppable", 20, "or", "streak >= 15"),
    Rule("on_fire", "player", "On Fire", 10, "argent", "hard_recent >= 2"),
    Rule("phoenix", "player", "Phoenix", 20, "or", "lowest <= -50 AND total >= 50"),
    Rule("marathon_runner", "player", "Marathon Runner", 5, "bronze", "five_in_a_row"),
    Rule("veteran", "player", "Veteran", 20, "or"),
    Rule("team_player", "player", "Team Player", 5, "bronze"),
    Rule("showtime", "player", "Showtime", 35, "diamant", "praise >= 3"),
    Rule("captain_courage", "player", "Captain Courage", 18, "or"),
    Rule("clockwork", "player", "Clockwork", 12, "argent"),
    Rule("christmas_magic", "player", "Christmas Magic", 50, "legendaire"),
    Rule("game_changer", "player", "Game Changer", 40, "diamant"),
    Rule("collectionneur", "player", "Collectionneur", 12, "or"),
    Rule("rocket_launch", "team", "Rocket Launch", 20, "bronze"),
    Rule("tidal_wave", "team", "Tidal Wave", 100, "or"),
    Rule("lightning_strike", "team", "Lightning Strike", 20, "bronze"),
    Rule("house_on_fire", "team", "House on Fire", 50, "argent"),
    Rule("united_we_stand", "team", "United We Stand", 50, "argent"),
    Rule("perfect_balance", "team", "Perfect Balance", 100, "or"),
    Rule("harmony", "team", "Harmony", 50, "argent"),
    Rule("no_weak_link", "team", "No Weak Link", 60, "argent"),
    Rule("triple_threat", "team", "Triple Threat", 75, "argent"),
    Rule("mutual_support", "team", "Mutual Support", 50, "bronze"),
)
ENTRY_RULES = ("hot_streak", "tsunami", "unstoppable", "phoenix", "showtime")  # judged after every entry
ENTITY = {"player": "player_id", "team": "team"}


def rules_table(spark: SparkSession, rules: Iterable[Rule] = RULES) -> DataFrame:
    schema = "badge_id string, scope string, badge_name string, points bigint, rarity string, predicate string"
    return spark.createDataFrame([tuple(r) for r in rules], schema)


def grant(winners: DataFrame, scope: str = "player", rules: Iterable[Rule] = RULES) -> DataFrame:
    """Award rows for the winners of rules. The rule list is a constant, so it is looked up in a literal map, not joined."""
    details = F.create_map(*[part for r in rules if r.scope == scope for part in (
        F.lit(r.badge_id),
        F.struct(F.lit(r.badge_name).alias("badge_name"), F.lit(r.points).cast("bigint").alias("points"),
                 F.lit(r.rarity).alias("rarity")))])
    return winners.withColumn("_rule", F.try_element_at(details, F.col("badge_id"))).where("_rule IS NOT NULL").select(
        ENTITY[scope], "badge_id", "_rule.badge_name", "_rule.points", "_rule.rarity",
        F.col("date_earned").cast("timestamp_ntz"))


def won(winners: DataFrame, badge_id: str, date_earned: Column | str, scope: str = "player") -> DataFrame:
    """What every rule returns: ``(entity, badge_id, date_earned)``. Any number of them can be united and granted at once."""
    when = F.col(date_earned) if isinstance(date_earned, str) else date_earned
    return winners.select(
        ENTITY[scope], F.lit(badge_id).alias("badge_id"), when.cast("timestamp_ntz").alias("date_earned"))


def rule_dates(rules: Iterable[Rule], badge_ids: Sequence[str], when: Column) -> list[Column]:
    """Aggregates, one per rule: the first ``when`` at which the predicate held."""
    return [F.min(F.when(F.expr(r.predicate), when)).alias(r.badge_id) for r in rules if r.badge_id in badge_ids]


def unfold(firsts: DataFrame, badge_ids: Sequence[str]) -> DataFrame:
    """From a column per rule to a row per award."""
    return firsts.select("player_id", F.explode(F.array(*[
        F.struct(F.lit(b).alias("badge_id"), F.col(b).alias("date_earned")) for b in badge_ids
    ])).alias("w")).select("player_id", "w.*").where(F.col("date_earned").isNotNull())


# players, first time ------------------------------------------------------------------------------------------------

def entry_summary(ledger: DataFrame, praise: Sequence[str], rules: Iterable[Rule] = RULES,
                  case_sensitive: bool = True, **chunking) -> DataFrame:
    """Per player when each rule judged after every entry first held, ``last_negative`` and streaks: one ledger pass."""
    counters = {"praise": text.contains_any(F.col("action"), praise, case_sensitive)}
    states = rollups.actions_only(running_state(ledger, counters, **chunking))
    return states.groupBy("player_id").agg(
        *rule_dates(rules, ENTRY_RULES, F.col("ts")),
        F.max(F.when(state.is_low_point(), F.col("ts"))).alias("last_negative"),
        F.max_by("streak", "id").alias("current_streak"), F.max("streak").alias("max_streak"))


def entry_awards(summary: DataFrame, badge_ids: Sequence[str] = ENTRY_RULES) -> DataFrame:
    """Streak, comeback and praise awards at the entry that first met their condition, from ``entry_summary``."""
    return unfold(summary, badge_ids)


def on_fire(ledger: DataFrame, hard: Sequence[str], k: int = 2, days: int = 14,
            case_sensitive: bool = True) -> DataFrame:
    """Two hard-work entries within two weeks."""
    times = state.keyword_times(ledger, hard, case_sensitive)
    return won(state.first_time_within(times, k, days), "on_fire", "ts")


def marathon(days: DataFrame, run: int = 5) -> DataFrame:
    """Positive actions on five days in a row, earned with the first one of the fifth day; from ``player_days``."""
    earlier = F.lag("day", run - 1).over(Window.partitionBy("player_id").orderBy("day"))
    full = state.active_days(days).withColumn("_earlier", earlier).where(F.datediff("day", "_earlier") == run - 1)
    return won(full.groupBy("player_id").agg(F.min("first_ts").alias("ts")), "marathon_runner", "ts")


def first_time_awards(ledger: DataFrame, summary: DataFrame, days: DataFrame,
                      hard: Sequence[str] = (text.HARD_WORK_KEYWORD,)) -> DataFrame:
    """All player awards that the player's own entries decide; ``summary`` and ``days`` are made from the ledger."""
    return grant(entry_awards(summary).unionByName(on_fire(ledger, hard)).unionByName(marathon(days)))


# players, as of -----------------------------------------------------------------------------------------------------

def recompute(player_state: DataFrame, as_of: dt.datetime, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Awards due by the present state alone, without bonus points."""
    features = player_state.withColumnsRenamed({
        "current_streak": "streak", "score": "total", "lowest_score": "lowest", "praise_count": "praise",
        "in_a_row": "five_in_a_row"})
    judged = [r.badge_id for r in rules if r.predicate]
    due = features.groupBy("player_id").agg(*rule_dates(rules, judged, cal.ntz(as_of)))
    return grant(unfold(due, judged), "player", rules).withColumn("points", F.lit(0).cast("bigint"))


def courage(ledger: DataFrame, as_of: dt.datetime, keywords: Sequence[str] = text.REFEREE_KEYWORDS,
            at_least: int = 5, months: int = 3) -> DataFrame:
    """Enough keyword entries in the last three calendar months."""
    recent = rollups.until(ledger, as_of).where(F.col("ts") >= cal.ntz(cal.months_before(as_of, months)))
    hits = recent.where(text.contains_any(F.col("action"), keywords)).groupBy("player_id").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    return won(hits, "captain_courage", cal.ntz(as_of))


def clockwork(ledger: DataFrame, as_of: dt.datetime, keywords: Sequence[str] = text.LATENESS_KEYWORDS,
              months: int = 3) -> DataFrame:
    """No keyword entry for three months, by players whose first entry is that old."""
    since = F.col("ts") >= cal.ntz(cal.months_before(as_of, months))
    seen = rollups.until(ledger, as_of).groupBy("player_id").agg(
        F.min("ts").alias("first_ts"),
        F.count_if(since & text.contains_any(F.col("action"), keywords)).alias("n"))
    old = cal.month_shift(F.col("first_ts"), months) <= cal.ntz(as_of)
    return won(seen.where(old & (F.col("n") == 0)), "clockwork", cal.ntz(as_of))


def christmas(ledger: DataFrame, as_of: dt.datetime, look_back: int = 10) -> DataFrame:
    """A positive entry in the last ten days, if ``as_of`` lies in 20-31 December."""
    in_season = as_of.month == 12 and as_of.day >= 20
    since = as_of.date() - dt.timedelta(days=look_back)
    recent = rollups.until(ledger, as_of).where((F.col("ts") >= cal.ntz(since)) & (F.col("points") > 0))
    return won(recent.where(F.lit(in_season)).select("player_id").distinct(), "christmas_magic", cal.ntz(as_of))


def game_changer(intervals: DataFrame, players: DataFrame) -> DataFrame:
    """From the last two of the team to its first three."""
    return won(snapshots.rank_turnaround(intervals, players), "game_changer", "top_day")


def veteran(intervals: DataFrame, players: DataFrame, top: int = 3, months: int = 2, days: int = 0) -> DataFrame:
    """Among the first three of the team for two months."""
    ranked = snapshots.daily_best(intervals, top, ["team"]).select("player_id", "day")
    runs = snapshots.sustained(ranked, "player_id", months, days)
    return won(snapshots.first_held(runs, "player_id"), "veteran", "held_on")


def team_player(days: DataFrame, players: DataFrame, as_of: dt.datetime, direct: DataFrame | None = None) -> DataFrame:
    """Members of a team that gained the most points in a finished week, earned when the first such week is over."""
    weeks = rollups.team_period_points(days, players, direct, ("week",)).where(
        F.date_add("period_start", 7) <= F.lit(as_of.date()))
    best = top_per_group(weeks, ["period_start"], [F.desc("points"), F.col("team")], 1)
    first = best.groupBy("team").agg(F.date_add(F.min("period_start"), 7).alias("day"))
    members = players.select("player_id", "team").join(first, "team")
    return won(members, "team_player", "day")


def collector(player_badges: DataFrame, team_badges: DataFrame, players: DataFrame, as_of: dt.datetime,
              own: int = 6, team: int = 6) -> DataFrame:
    """Enough badges of one's own and of the team."""
    mine = badge_counts(player_badges, "player_id").where(F.col("n") >= own).select("player_id")
    teams = badge_counts(team_badges, "team").where(F.col("n") >= team).select("team")
    both = players.select("player_id", "team").join(teams, "team", "left_semi").join(mine, "player_id", "left_semi")
    return won(both, "collectionneur", cal.ntz(as_of))


def badge_counts(badges: DataFrame, entity: str) -> DataFrame:
    return badges.groupBy(entity).agg(F.count_distinct("badge_id").alias("n"))


# teams --------------------------------------------------------------------------------------------------------------

def team_sizes(players: DataFrame) -> DataFrame:
    return players.groupBy("team").agg(F.count(F.lit(1)).alias("size"))


def first_reach(daily: DataFrame, period_type: str, threshold: int) -> DataFrame:
    """First day on which a team's points of the running week or month reached the threshold."""
    periods = rollups.by_period(daily, (period_type,))
    so_far = Window.partitionBy("team", "period_start").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return periods.withColumn("_sum", F.sum("points").over(so_far)).where(F.col("_sum") >= threshold).groupBy(
        "team").agg(F.min("day").alias("day"))


def rocket_launch(daily: DataFrame, threshold: int = 80) -> DataFrame:
    return won(first_reach(daily, "week", threshold), "rocket_launch", "day", "team")


def tidal_wave(daily: DataFrame, threshold: int = 200) -> DataFrame:
    return won(first_reach(daily, "month", threshold), "tidal_wave", "day", "team")


def lightning_strike(days: DataFrame, players: DataFrame) -> DataFrame:
    """All members gain points on the same day."""
    full = rollups.active_players_per_day(days, players).join(team_sizes(players), "team").where(
        F.col("active") == F.col("size"))
    return won(full.groupBy("team").agg(F.min("day").alias("day")), "lightning_strike", "day", "team")


def house_on_fire(days: DataFrame, players: DataFrame, share: float = 0.8) -> DataFrame:
    """Enough members with a positive entry in one week, earned on the day the share was reached."""
    firsts = days.where(F.col("positive_entries") > 0).groupBy(
        "player_id", cal.week_bounds(F.col("day"))[0].alias("week")).agg(F.min("day").alias("day"))
    daily = firsts.join(players.select("player_id", "team"), "player_id").groupBy("team", "week", "day").agg(
        F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("team", "week").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    enough = daily.withColumn("_n", F.sum("n").over(so_far)).join(team_sizes(players), "team").where(
        F.col("_n") >= F.col("size") * share)
    return won(enough.groupBy("team").agg(F.min("day").alias("day")), "house_on_fire", "day", "team")


def united(scores: DataFrame, last_negative: DataFrame, as_of: dt.datetime, days: int = 14) -> DataFrame:
    """No member below 0 now, nor within the last two weeks by an entry of their own."""
    calm = F.coalesce("last_negative", F.lit("2000-01-01").cast("timestamp_ntz")) < cal.ntz(
        as_of - dt.timedelta(days=days))
    lows = scores.groupBy("team").agg(F.min("score").alias("low")).where(F.col("low") >= 0)
    return won(lows.join(last_negative, "team", "left").where(calm), "united_we_stand", cal.ntz(as_of), "team")


def perfect_balance(scores: DataFrame, as_of: dt.datetime, low: int = 25, high: int = 75) -> DataFrame:
    within = scores.groupBy("team").agg(F.bool_and(F.col("score").between(low, high)).alias("ok")).where("ok")
    return won(within, "perfect_balance", cal.ntz(as_of), "team")


def harmony(scores: DataFrame, as_of: dt.datetime, gap: int = 50, month: int = 12) -> DataFrame:
    """Best and worst member close together; only in one month of the year."""
    spread = scores.where(F.lit(as_of.month == month)).groupBy("team").agg(
        (F.max("score") - F.min("score")).alias("gap")).where(F.col("gap") < gap)
    return won(spread, "harmony", cal.ntz(as_of), "team")


def no_weak_link(intervals: DataFrame, players: DataFrame, first_day: dt.date, as_of: dt.datetime, low: int = 25,
                 months: int = 2, days: int = 0) -> DataFrame:
    """Every member at ``low`` or more for two months."""
    good = snapshots.team_days_all(intervals, players, F.col("score") >= low, first_day, as_of.date())
    return won(snapshots.first_held(snapshots.sustained(good, "team", months, days), "team"), "no_weak_link", "held_on",
               "team")


def triple_threat(intervals: DataFrame, k: int = 10, members: int = 3, months: int = 1, days: int = 0) -> DataFrame:
    """Three members in the overall top ten for a month."""
    good = snapshots.team_days_in_top(intervals, k, members)
    return won(snapshots.first_held(snapshots.sustained(good, "team", months, days), "team"), "triple_threat", "held_on",
               "team")


def mutual_support(ledger: DataFrame, players: DataFrame, as_of: dt.datetime,
                   keywords: Sequence[str] = text.VOLUNTEER_KEYWORDS, share: float = 0.8, days: int = 14) -> DataFrame:
    """Enough members with a volunteer entry in the last two weeks."""
    recent = rollups.until(ledger, as_of).where(F.col("ts") >= cal.ntz(as_of - dt.timedelta(days=days)))
    helpers = recent.where(text.contains_any(F.col("action"), keywords)).select("player_id").distinct()
    active = helpers.join(players.select("player_id", "team"), "player_id").groupBy("team").agg(
        F.count(F.lit(1)).alias("n"))
    enough = active.join(team_sizes(players), "team").where(F.col("n") >= F.col("size") * share)
    return won(enough, "mutual_support", cal.ntz(as_of), "team")


# effects ------------------------------------------------------------------------------------------------------------

def award_once(candidates: DataFrame, held: DataFrame, entity: str = "player_id") -> DataFrame:
    """Candidates not held yet, one per entity and badge, at the earliest date."""
    rest = [c for c in candidates.columns if c not in (entity, "badge_id")]
    first = candidates.groupBy(entity, "badge_id").agg(F.min_by(F.struct(*rest), "date_earned").alias("r"))
    return first.select(entity, "badge_id", "r.*").join(held.select(entity, "badge_id"), [entity, "badge_id"], "left_anti")


def bonus_rows(awards: DataFrame) -> DataFrame:
    """Ledger rows of the bonus points of player awards, and the bonus so far; a player has one row per rule at most."""
    so_far = Window.partitionBy("player_id").orderBy("date_earned", "badge_id").rowsBetween(Window.unboundedPreceding, 0)
    return awards.where(F.col("points") > 0).select(
        F.col("date_earned").alias("ts"), "player_id",
        F.concat(F.lit(text.BONUS_ACTION), "badge_name").alias("action"), F.lit("unknown").alias("category"), "points",
        F.lit(text.SYSTEM_ACTOR).alias("actor"), F.lit("system").alias("kind"),
        F.sum("points").over(so_far).alias("bonus_so_far"))
