"""One callable ``(spark, folder) -> DataFrame`` per operator."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, text
from ..functions import calendar as cal
from ..operators import awards, corrections, curves, ordered, records, reports, rollups, snapshots, state
from ..session import shared_folder
from ..sources import ingest, repair, sinks, store, tables, upkeep
from ..streaming import players as stream_players
from ..streaming import sources as stream_sources
from ..streaming import teams as stream_teams
from ..streaming import windows as stream_windows
from . import settings as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Registers the function under its name, with plainly comparable column types."""
    QUERIES[fn.__name__] = lambda spark, folder: comparable(fn(spark, folder))
    return fn


def comparable(frame: DataFrame) -> DataFrame:
    """Dates and arrays as text and whole numbers as BIGINT, for comparison across engines."""
    def plain(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(column.cast("array<string>"), ",").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return column.cast("string").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return column.cast("bigint").alias(field.name)
        return column
    return frame.select(*[plain(f) for f in frame.schema.fields])


def once(method):
    """Keeps the frame a method returned, so that a query builds each view a single time."""
    @functools.wraps(method)
    def kept(self):
        if method.__name__ not in self.frames:
            self.frames[method.__name__] = method(self)
        return self.frames[method.__name__]
    return kept


class Inputs:
    """The views the queries work on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.frames = spark, folder, {}

    @once
    def ledger(self) -> DataFrame:
        return tables.event_ledger(self.spark, self.folder)

    @once
    def recent(self) -> DataFrame:
        return rollups.until(self.ledger(), S.AS_OF)

    @once
    def orders(self) -> DataFrame:
        return tables.order_ledger(self.spark, self.folder)

    @once
    def players(self) -> DataFrame:
        return tables.players(self.spark, self.folder)

    @once
    def active(self) -> DataFrame:
        return tables.active_players(self.spark, self.folder)

    @once
    def direct(self) -> DataFrame:
        return tables.team_ledger(self.spark, self.folder)

    @once
    def scores(self) -> DataFrame:
        return rollups.scoreboard(self.players(), self.ledger())

    @once
    def active_scores(self) -> DataFrame:
        return rollups.scoreboard(self.active(), self.days())

    @once
    def days(self) -> DataFrame:
        """Player days up to ``AS_OF``."""
        return rollups.player_days(self.recent())

    @once
    def summary(self) -> DataFrame:
        return awards.entry_summary(self.recent(), S.PRAISE)

    @once
    def keyworded(self) -> DataFrame:
        """The entries that a keyword rule can look at, for all such rules in one pass."""
        return self.recent().where(text.contains_any(F.col("action"), (*S.HARD, *S.VOLUNTEER)))

    def store(self) -> Inputs:
        """Writes what many rules share to tables and works on with these; what doesn't build on each other is written at a time."""
        def write(name: str, frame: DataFrame) -> None:
            self.frames[name] = sinks.reload_table(frame, shared_folder(self.spark, name))
        for names in (("days", "summary", "keyworded"), ("active_scores", "team_gains")):
            frames = [getattr(self, name)() for name in names]
            with ThreadPoolExecutor(len(names)) as pool:
                list(pool.map(write, names, frames))
        self.frames["active"] = self.active_scores().select("player_id", "name", "team")
        return self

    @once
    def intervals(self) -> DataFrame:
        return snapshots.score_intervals(self.days(), self.active(), S.FIRST_DAY, S.AS_OF.date())

    @once
    def badges(self) -> DataFrame:
        return awards.first_time_awards(self.keyworded(), self.summary(), self.days(), S.HARD)

    @once
    def team_gains(self) -> DataFrame:
        return rollups.team_day_points(self.days(), self.players(), rollups.until(self.direct(), S.AS_OF))

    @once
    def team_badges(self) -> DataFrame:
        players, days = self.active(), self.days()
        scores = self.active_scores()
        parts = [
            awards.rocket_launch(self.team_gains(), S.WEEK_POINTS),
            awards.tidal_wave(self.team_gains(), S.MONTH_POINTS),
            awards.lightning_strike(days, players),
            awards.house_on_fire(days, players),
            awards.united(scores, state.team_last_negative(self.summary(), players), S.AS_OF, S.UNITED_DAYS),
            awards.perfect_balance(scores, S.AS_OF, *S.BALANCE),
            awards.harmony(scores, S.AS_OF, S.HARMONY_GAP, S.HARMONY_MONTH),
            awards.mutual_support(self.keyworded(), players, S.AS_OF, S.VOLUNTEER),
        ]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return awards.grant(result, "team")

    @once
    def state(self) -> DataFrame:
        return state.player_state(self.recent(), S.AS_OF, S.PRAISE, S.HARD)


# sources, sinks and upkeep -------------------------------------------------------------------------------------------

@query
def scan_ledger(spark, folder):
    return Inputs(spark, folder).ledger()


@query
def scan_players(spark, folder):
    return Inputs(spark, folder).scores().orderBy(F.desc("score"), "player_id")


@query
def badge_rules(spark, folder):
    rules = awards.rules_table(spark).drop("predicate")
    return reports.rule_holders(rules, Inputs(spark, folder).badges())


@query
def ingest_validate(spark, folder):
    known = Inputs(spark, folder).players().where(F.col("team") != S.POOL)
    return ingest.validate_entries(tables.raw_entries(spark, folder), known)


@query
def ingest_players(spark, folder):
    x = Inputs(spark, folder)
    requests = x.players().select(
        F.col("player_id").alias("id"), F.concat(F.lit(" "), "name", F.lit(" ")).alias("name"), "team")
    return ingest.validate_players(requests, x.active(), S.OPEN_TEAMS)


@query
def team_direct_totals(spark, folder):
    accepted = ingest.accept_team_entries(Inputs(spark, folder).direct(), S.OPEN_TEAMS)
    return rollups.team_direct_totals(accepted, S.AS_OF)


@query
def team_entries_accepted(spark, folder):
    return ingest.accept_team_entries(Inputs(spark, folder).direct(), S.OPEN_TEAMS)


@query
def backfill_period_stats(spark, folder):
    """Urgent orders lost their category; all roll-ups are rebuilt and stored anew, twice to the same effect."""
    lost = Inputs(spark, folder).orders().withColumn(
        "category", F.when(F.col("action") == "1-URGENT", "unknown").otherwise(F.col("category")))
    stats = rollups.period_stats(rollups.reclassify(lost, tables.ORDER_RULES))
    return sinks.reload_table(stats, shared_folder(spark, "period-stats"), ["period_type"]).select(*stats.columns)


@query
def repair_period_stats(spark, folder):
    """A stored ledger without one day's views takes up these late, with three corrections: errors of that day cost nothing, purchases of the day
    belong to a week later, sign-ups of a day are withdrawn."""
    ledger, late, fixed = Inputs(spark, folder).ledger(), F.col("action") == "view", F.to_date("ts") == F.lit(S.LATE_DAY)
    week, day = F.expr("INTERVAL 7 DAYS"), F.lit(S.LATE_DAY)
    held = store.Store(spark, shared_folder(spark, "repaired"))
    repair.create(held, ledger.where(~(late & fixed)))
    changes = ledger.where(fixed & F.col("action").isin("view", "error", "purchase", "signup")).withColumns({
        "points": F.when(F.col("action") == "error", 0).otherwise(F.col("points")).cast("bigint"),
        "ts": F.when(F.col("action") == "purchase", F.col("ts") + week).otherwise(F.col("ts")),
        "was_day": F.when(F.col("action") == "purchase", day), "gone": F.col("action") == "signup"})
    repair.apply_changes(held, changes)
    return held.read("period_stats")


@query
def export_players(spark, folder):
    x = Inputs(spark, folder).store()
    this_month = rollups.period_stats(
        x.recent().where(cal.within_days(F.col("ts"), *cal.period_range(S.AS_OF, "month"))), ("month",))
    return reports.player_sheet(
        rollups.scoreboard(x.players(), x.days()), this_month, x.summary(), x.badges())


@query
def export_teams(spark, folder):
    return reports.team_sheet(rollups.team_summary(Inputs(spark, folder).scores()))


@query
def export_team_badges(spark, folder):
    return reports.team_badge_sheet(Inputs(spark, folder).store().team_badges())


SHEETS = ("players", "teams", "team_badges")


def _export(spark, folder) -> dict[str, DataFrame]:
    return dict(zip(SHEETS, (export_players(spark, folder), export_teams(spark, folder), export_team_badges(spark, folder))))


@query
def export_csv(spark, folder):
    """The three sheets written as one export, read back with their types: a row per cell."""
    sheets, where, result = _export(spark, folder), shared_folder(spark, "export"), None
    sinks.write_sheets(sheets, where)
    for name, sheet in sheets.items():
        entity = "name" if name == "players" else "team"
        back = sinks.read_sheet(spark, where, name, sheet.schema)
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in back.columns if c != entity]))
        part = back.select(F.lit(name).alias("sheet"), F.col(entity).alias("entity"), cells.alias("c")).select("sheet", "entity", "c.*")
        result = part if result is None else result.unionByName(part)
    return result


@query
def upsert_latest(spark, folder):
    """Daily points up to the 20th, of which the days from the 15th on are replaced by positive points only."""
    daily = Inputs(spark, folder).ledger().withColumn("day", F.to_date("ts"))
    turn, end = F.lit(dt.date(2024, 1, 15)), F.lit(dt.date(2024, 1, 20))
    existing = daily.where(F.col("day") <= end).groupBy("player_id", "day").agg(F.sum("points").alias("points"))
    updates = daily.where((F.col("day") >= turn) & (F.col("points") > 0)).groupBy("player_id", "day").agg(
        F.sum("points").alias("points"))
    return upkeep.upsert_latest(existing, updates, ["player_id", "day"])


@query
def insert_if_absent(spark, folder):
    x = Inputs(spark, folder)
    existing = x.active().select("player_id", "name", F.lit("kept").alias("origin"))
    candidates = x.players().select("player_id", "name", F.lit("new").alias("origin"))
    return upkeep.insert_if_absent(existing, candidates, ["player_id"])


@query
def schema_evolve(spark, folder):
    ledger = Inputs(spark, folder).ledger()
    turn = cal.ntz(dt.date(2024, 1, 15))
    old = ledger.where(F.col("ts") < turn).drop("category", "actor")
    return upkeep.evolve(old, ledger.where(F.col("ts") >= turn), {"category": "unknown", "actor": text.DEFAULT_ACTOR})


@query
def delete_entities(spark, folder):
    x = Inputs(spark, folder)
    return upkeep.delete_entities(x.ledger(), x.players().where(F.col("team") == S.POOL))


@query
def stored_ledger_range(spark, folder):
    """The ledger stored by day, and a week of it read back."""
    where = shared_folder(spark, "ledger")
    sinks.write_ledger(Inputs(spark, folder).ledger(), where)
    return tables.stored_ledger(spark, where, *cal.period_range(S.AS_OF, "week")).select(*tables.LEDGER_COLUMNS)


def _wanted_renames(x: Inputs) -> DataFrame:
    """Ids of one team move up; another team wants ids that are taken."""
    moved = x.players().where(F.col("team") == "BUILDING").select(
        F.col("player_id").alias("old_id"), (F.col("player_id") + S.RENAME_OFFSET).alias("new_id"))
    refused = x.players().where(F.col("team") == "FURNITURE").select(
        F.col("player_id").alias("old_id"), (F.col("player_id") * 0 + 1).alias("new_id"))
    return moved.unionByName(refused)


def _renames(x: Inputs) -> DataFrame:
    return upkeep.checked_renames(_wanted_renames(x), x.players())


@query
def rekey_entities(spark, folder):
    x = Inputs(spark, folder)
    return upkeep.rekey(x.ledger(), _renames(x))


@query
def rename_audit(spark, folder):
    return upkeep.rename_audit(_renames(Inputs(spark, folder)), cal.ntz(S.AS_OF)).drop("id")


@query
def upsert_stored(spark, folder):
    """``upsert_latest`` into a stored table of daily points, done twice to the same effect, and read back."""
    daily = Inputs(spark, folder).ledger().withColumn("day", F.to_date("ts"))
    turn, end = F.lit(dt.date(2024, 1, 15)), F.lit(dt.date(2024, 1, 20))
    points = F.sum("points").alias("points")
    held = store.Store(spark, shared_folder(spark, "daily-points"))
    held.create("daily", daily.where(F.col("day") <= end).groupBy("player_id", "day").agg(points), "day", ["player_id", "day"])
    updates = daily.where((F.col("day") >= turn) & (F.col("points") > 0)).groupBy("player_id", "day").agg(points)
    for _ in range(2):
        held.upsert("daily", updates)
    held.clean()
    return held.read("daily")


def _stored_tables(x: Inputs) -> store.Store:
    """Ledger, dimension, badges and roll-ups in one store."""
    held = store.Store(x.spark, shared_folder(x.spark, "store"))
    held.create("ledger", x.ledger().withColumn("day", F.to_date("ts")), "day", ["day", "id"])
    held.create("players", x.players(), None, ["player_id"])
    held.create("badges", x.badges(), None, ["player_id", "badge_id"])
    held.create("period_stats", rollups.period_stats(x.ledger()), "period_type", ["player_id", "period_type", "period_start"])
    return held


def _store_summary(held: store.Store) -> DataFrame:
    """What each table of the store says of each player."""
    worth = {"ledger": "points", "players": "0", "badges": "points", "period_stats": "total_points"}
    result = None
    for name, points in worth.items():
        part = held.read(name).groupBy("player_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(points)).cast("bigint").alias("points"))
        part = part.select(F.lit(name).alias("stored"), "player_id", "n", "points")
        result = part if result is None else result.unionByName(part)
    return result


@query
def rename_everywhere(spark, folder):
    """Renames in all tables of a store; the same ones again are refused, as the old ids are gone."""
    x = Inputs(spark, folder)
    held = _stored_tables(x)
    wanted = _wanted_renames(x)
    for _ in range(2):
        upkeep.rename_everywhere(held, wanted, cal.ntz(S.AS_OF))
    held.clean()
    return _store_summary(held)


@query
def delete_everywhere(spark, folder):
    """The pool's players removed from all tables of a store."""
    x = Inputs(spark, folder)
    held = _stored_tables(x)
    upkeep.delete_everywhere(held, x.players().where(F.col("team") == S.POOL))
    held.clean()
    return _store_summary(held)


# filters and projections ---------------------------------------------------------------------------------------------

@query
def filter_eq(spark, folder):
    ledger = Inputs(spark, folder).ledger()
    return ledger.where((F.col("player_id") == 7) & (F.col("action") == "view"))


@query
def filter_keywords(spark, folder):
    words = [w for _, keywords in tables.DOCUMENT_RULES for w in keywords]
    return tables.documents(spark, folder).where(text.contains_any(F.col("text"), words)).select("doc_id")


@query
def filter_trailing_days(spark, folder):
    since = S.AS_OF.date() - dt.timedelta(days=10)
    return Inputs(spark, folder).recent().where(F.col("ts") >= cal.ntz(since)).select("id", "ts", "player_id", "points")


@query
def filter_trailing_months(spark, folder):
    since = cal.months_before(S.ORDERS_AS_OF, 3)
    orders = rollups.until(Inputs(spark, folder).orders(), S.ORDERS_AS_OF)
    return orders.where(F.col("ts") >= cal.ntz(since)).select("id", "ts", "player_id", "points")


@query
def project_alias(spark, folder):
    return Inputs(spark, folder).players().select(
        F.col("name").alias("player_name"), F.lit(0).alias("total_points"), F.lit(True).alias("is_drafted"))


# joins ---------------------------------------------------------------------------------------------------------------

@query
def join_badges_players(spark, folder):
    x = Inputs(spark, folder)
    return reports.badges_with_team(x.badges(), x.players())


@query
def reserve_pool(spark, folder):
    x = Inputs(spark, folder)
    return reports.reserve_pool(x.scores(), x.badges(), state.streaks(x.ledger()), S.POOL)


@query
def breakdown_from_ledger(spark, folder):
    x = Inputs(spark, folder)
    return reports.breakdown_from_ledger(x.ledger(), x.players(), S.AS_OF)


@query
def semi_join_team(spark, folder):
    x = Inputs(spark, folder)
    return x.ledger().join(x.players().where(F.col("team") == "BUILDING"), "player_id", "left_semi").select(
        "id", "player_id", "points")


@query
def badge_count_per_player(spark, folder):
    x = Inputs(spark, folder)
    return reports.badge_count_per_player(x.players(), x.badges())


@query
def award_once(spark, folder):
    """Awards of the whole ledger that were not yet earned at ``AS_OF``."""
    x = Inputs(spark, folder)
    ledger = x.ledger()
    found = awards.first_time_awards(
        ledger, awards.entry_summary(ledger, S.PRAISE), rollups.player_days(ledger), S.HARD)
    return awards.award_once(found, x.badges())


@query
def players_with_badges(spark, folder):
    x = Inputs(spark, folder)
    held = reports.players_with_badges(x.players(), x.badges())
    return held.withColumn("badges", F.transform("badges", lambda b: b["badge_id"]))


@query
def team_totals(spark, folder):
    x = Inputs(spark, folder)
    return rollups.team_totals(x.scores(), x.direct())


# aggregates ----------------------------------------------------------------------------------------------------------

@query
def player_scores(spark, folder):
    return rollups.player_scores(Inputs(spark, folder).ledger())


@query
def period_stats(spark, folder):
    return rollups.period_stats(Inputs(spark, folder).orders())


@query
def period_stats_strict_terms(spark, folder):
    return rollups.period_stats(Inputs(spark, folder).orders(), ("term",), strict_terms=True)


@query
def period_stats_paris(spark, folder):
    """Weeks and months as seen from another zone."""
    return rollups.period_stats(Inputs(spark, folder).ledger(), ("week", "month"), tz="Europe/Paris")


@query
def period_stats_team(spark, folder):
    """With the team at the first entry of the period, for a ledger that knows it."""
    x = Inputs(spark, folder)
    return rollups.period_stats(x.ledger().withColumn("team", F.col("action")), ("week",))


@query
def team_ranking(spark, folder):
    return rollups.team_ranking(Inputs(spark, folder).scores())


@query
def daily_progress(spark, folder):
    return curves.daily_progress(Inputs(spark, folder).ledger())


@query
def reserve_stats(spark, folder):
    return rollups.group_stats(Inputs(spark, folder).scores().where(F.col("team") == S.POOL))


@query
def distinct_active_players(spark, folder):
    x = Inputs(spark, folder)
    return rollups.active_players_per_day(rollups.player_days(x.ledger()), x.players())


@query
def distinct_teams(spark, folder):
    return Inputs(spark, folder).players().select("team").distinct()


@query
def team_breakdown(spark, folder):
    x = Inputs(spark, folder)
    return reports.team_breakdown(x.ledger(), x.players(), S.AS_OF)


@query
def most_balanced_team(spark, folder):
    x = Inputs(spark, folder)
    return reports.most_balanced(reports.team_breakdown(x.ledger(), x.players(), S.AS_OF))


@query
def most_active_team(spark, folder):
    x = Inputs(spark, folder)
    return reports.most_active(reports.team_breakdown(x.ledger(), x.players(), S.AS_OF))


@query
def breakdown_totals(spark, folder):
    x = Inputs(spark, folder)
    return reports.breakdown_totals(reports.team_breakdown(x.ledger(), x.players(), S.AS_OF))


@query
def badge_leaders(spark, folder):
    x = Inputs(spark, folder)
    return reports.badge_leaders(x.badges(), x.players())


@query
def period_type_summary(spark, folder):
    return rollups.period_type_summary(rollups.period_stats(Inputs(spark, folder).orders()))


@query
def team_period_points(spark, folder):
    x = Inputs(spark, folder)
    return rollups.team_period_points(rollups.player_days(x.ledger()), x.players(), x.direct())


@query
def player_period_actions(spark, folder):
    return rollups.player_period_actions(rollups.player_days(Inputs(spark, folder).ledger()))


@query
def keyword_counters(spark, folder):
    return state.keyword_counters(Inputs(spark, folder).ledger(), S.PRAISE, S.HARD)


@query
def keyword_times(spark, folder):
    return state.keyword_times(Inputs(spark, folder).ledger(), S.HARD)


@query
def team_last_negative(spark, folder):
    x = Inputs(spark, folder)
    return state.team_last_negative(state.last_negative(x.ledger()), x.players())


@query
def last_activity(spark, folder):
    return state.last_activity(Inputs(spark, folder).ledger())


# ordered -------------------------------------------------------------------------------------------------------------

@query
def ledger_running_total(spark, folder):
    return ordered.running_total(Inputs(spark, folder).ledger()).select(
        "id", "player_id", "points", "prev_total", "total")


@query
def streaks(spark, folder):
    return state.streaks(Inputs(spark, folder).ledger())


@query
def lowest_score(spark, folder):
    return state.lowest_score(Inputs(spark, folder).ledger())


@query
def first_to_milestone(spark, folder):
    return records.first_to_milestone(ordered.staircase(Inputs(spark, folder).ledger()), S.MILESTONES)


@query
def record_progression(spark, folder):
    return records.record_progression(records.stored_steps(Inputs(spark, folder).ledger()))


@query
def rank_in_team(spark, folder):
    return ordered.ranked(Inputs(spark, folder).scores(), "score", "player_id", ["team"], "rank_in_team")


@query
def global_rank(spark, folder):
    return ordered.ranked(Inputs(spark, folder).scores(), "score", "player_id")


@query
def team_positions(spark, folder):
    x = Inputs(spark, folder)
    return snapshots.team_positions(snapshots.team_daily_totals(x.days(), x.players(), S.FIRST_DAY, S.AS_OF.date()))


@query
def consecutive_days(spark, folder):
    return state.consecutive_days(Inputs(spark, folder).days())


@query
def sustained_condition(spark, folder):
    good = snapshots.team_days_in_top(Inputs(spark, folder).intervals())
    return snapshots.sustained(good, "team", extra_days=S.TOP_DAYS)


@query
def rank_turnaround(spark, folder):
    x = Inputs(spark, folder)
    return snapshots.rank_turnaround(x.intervals(), x.active())


@query
def latest_n_per_player(spark, folder):
    return state.latest_n(Inputs(spark, folder).ledger()).select("id", "player_id", "points", "position")


@query
def latest_entries(spark, folder):
    return state.latest_entries(Inputs(spark, folder).ledger())


@query
def team_running_total(spark, folder):
    """Total of each team's direct points after every entry; teams are hot keys by nature."""
    return ordered.running_total(Inputs(spark, folder).direct(), "team").select("id", "team", "points", "total")


@query
def opening_balance(spark, folder):
    return state.opening_balance(rollups.player_days(Inputs(spark, folder).ledger()))


@query
def trailing_count(spark, folder):
    return state.trailing_count(Inputs(spark, folder).ledger(), S.HARD, S.AS_OF, at_least=3)


@query
def hours_at_top(spark, folder):
    x = Inputs(spark, folder)
    return snapshots.hours_at_top(
        snapshots.team_hours(rollups.until(x.ledger(), S.AS_OF), x.players()), x.players(), S.FIRST_HOUR, S.AS_OF)


@query
def global_top10(spark, folder):
    return records.top_players(Inputs(spark, folder).scores(), 10)


# composed ------------------------------------------------------------------------------------------------------------

def _order_leaders(x: Inputs, k: int = 1, metrics=tuple(records.MVP_METRICS)) -> DataFrame:
    orders = x.orders()
    return records.period_leaders(rollups.period_stats(orders), x.players(), rollups.player_scores(orders), k, metrics)


@query
def mvp_per_period(spark, folder):
    return _order_leaders(Inputs(spark, folder))


@query
def top5_per_period(spark, folder):
    return _order_leaders(Inputs(spark, folder), 5, ("academic", "sport"))


@query
def mvp_history(spark, folder):
    return records.closed_periods(_order_leaders(Inputs(spark, folder)), S.ORDERS_AS_OF)


@query
def mvp_history_filtered(spark, folder):
    history = records.closed_periods(_order_leaders(Inputs(spark, folder)), S.ORDERS_AS_OF)
    return records.leader_history(history, "month", "sport", 20)


@query
def progress_curve(spark, folder):
    return curves.progress_curve(Inputs(spark, folder).ledger(), S.AS_OF, S.CURVE_DAYS)


@query
def progress_summary(spark, folder):
    return curves.progress_summary(Inputs(spark, folder).ledger(), S.AS_OF, S.CURVE_DAYS)


@query
def progress_all(spark, folder):
    return curves.progress_curve(Inputs(spark, folder).ledger(), S.AS_OF, None)


@query
def player_state(spark, folder):
    return Inputs(spark, folder).state()


@query
def team_rank_history(spark, folder):
    x = Inputs(spark, folder)
    places = snapshots.team_positions(snapshots.team_daily_totals(x.days(), x.players(), S.FIRST_DAY, S.AS_OF.date()))
    history = snapshots.team_rank_history(places, S.AS_OF, S.CURVE_DAYS)
    return history.withColumn("history", F.transform("history", lambda h: F.concat_ws(
        ":", h["day"].cast("string"), h["position"].cast("string"), h["total"].cast("string"))))


def _hall(x: Inputs) -> DataFrame:
    return records.hall_of_fame(x.ledger(), x.players(), S.MILESTONES)


@query
def hall_of_fame(spark, folder):
    return _hall(Inputs(spark, folder))


@query
def current_records(spark, folder):
    return records.current_records(_hall(Inputs(spark, folder)))


@query
def record_history_50(spark, folder):
    return records.latest_records(_hall(Inputs(spark, folder)))


@query
def absolute_record(spark, folder):
    return records.absolute_record(Inputs(spark, folder).scores())


@query
def badge_feed(spark, folder):
    x = Inputs(spark, folder).store()
    return reports.badge_feed(x.badges(), x.team_badges(), x.players())


# awards --------------------------------------------------------------------------------------------------------------

def _all_entry_awards(spark, folder, *badge_ids: str) -> DataFrame:
    return awards.grant(awards.entry_awards(awards.entry_summary(Inputs(spark, folder).ledger(), S.PRAISE), badge_ids))


@query
def badge_streaks(spark, folder):
    return _all_entry_awards(spark, folder, "hot_streak", "tsunami", "unstoppable")


@query
def badge_on_fire(spark, folder):
    return awards.grant(awards.on_fire(Inputs(spark, folder).ledger(), S.HARD))


@query
def badge_phoenix(spark, folder):
    return _all_entry_awards(spark, folder, "phoenix")


@query
def badge_marathon(spark, folder):
    return awards.grant(awards.marathon(rollups.player_days(Inputs(spark, folder).ledger())))


@query
def badge_showtime(spark, folder):
    return _all_entry_awards(spark, folder, "showtime")


@query
def badge_courage(spark, folder):
    return awards.grant(awards.courage(Inputs(spark, folder).orders(), S.ORDERS_AS_OF, S.REFEREE, S.COURAGE_COUNT))


@query
def badge_clockwork(spark, folder):
    return awards.grant(awards.clockwork(Inputs(spark, folder).orders(), S.ORDERS_AS_OF, S.LATENESS))


@query
def badge_christmas(spark, folder):
    return awards.grant(awards.christmas(Inputs(spark, folder).orders(), S.CHRISTMAS))


@query
def badge_game_changer(spark, folder):
    x = Inputs(spark, folder)
    return awards.grant(awards.game_changer(x.intervals(), x.active()))


@query
def badge_collector(spark, folder):
    x = Inputs(spark, folder).store()
    return awards.grant(awards.collector(x.badges(), x.team_badges(), x.players(), S.AS_OF, S.OWN_BADGES, S.TEAM_BADGES))


@query
def badge_veteran(spark, folder):
    x = Inputs(spark, folder)
    return awards.grant(awards.veteran(x.intervals(), x.active(), months=0, days=S.VETERAN_DAYS))


@query
def badge_team_player(spark, folder):
    x = Inputs(spark, folder)
    return awards.grant(awards.team_player(x.days(), x.players(), S.AS_OF, rollups.until(x.direct(), S.AS_OF)))


@query
def badge_rocket(spark, folder):
    return awards.grant(awards.rocket_launch(Inputs(spark, folder).team_gains(), S.WEEK_POINTS), "team")


@query
def badge_tidal(spark, folder):
    return awards.grant(awards.tidal_wave(Inputs(spark, folder).team_gains(), S.MONTH_POINTS), "team")


@query
def badge_lightning(spark, folder):
    x = Inputs(spark, folder)
    return awards.grant(awards.lightning_strike(x.days(), x.active()), "team")


@query
def badge_united(spark, folder):
    x = Inputs(spark, folder)
    last = state.team_last_negative(state.last_negative(x.recent()), x.active())
    return awards.grant(awards.united(x.active_scores(), last, S.AS_OF, S.UNITED_DAYS), "team")


@query
def badge_balance(spark, folder):
    return awards.grant(awards.perfect_balance(Inputs(spark, folder).active_scores(), S.AS_OF, *S.BALANCE), "team")


@query
def badge_harmony(spark, folder):
    return awards.grant(awards.harmony(Inputs(spark, folder).active_scores(), S.AS_OF, S.HARMONY_GAP, S.HARMONY_MONTH), "team")


@query
def badge_no_weak_link(spark, folder):
    x = Inputs(spark, folder)
    return awards.grant(awards.no_weak_link(
        x.intervals(), x.active(), S.FIRST_DAY, S.AS_OF, S.WEAK_LINK, 0, S.WEAK_LINK_DAYS), "team")


@query
def badge_triple_threat(spark, folder):
    return awards.grant(awards.triple_threat(Inputs(spark, folder).intervals(), months=0, days=S.TOP_DAYS), "team")


@query
def badge_mutual(spark, folder):
    x = Inputs(spark, folder)
    return awards.grant(awards.mutual_support(x.ledger(), x.active(), S.AS_OF, S.VOLUNTEER), "team")


@query
def badge_house_on_fire(spark, folder):
    x = Inputs(spark, folder)
    return awards.grant(awards.house_on_fire(x.days(), x.active()), "team")


@query
def badge_bonus_rows(spark, folder):
    return awards.bonus_rows(Inputs(spark, folder).badges())


@query
def recompute_badges(spark, folder):
    return awards.recompute(Inputs(spark, folder).state(), S.AS_OF)


# corrections ---------------------------------------------------------------------------------------------------------

@query
def undo_last(spark, folder):
    return state.entry_state(corrections.undo_last(Inputs(spark, folder).ledger()))


@query
def apply_transfers(spark, folder):
    x = Inputs(spark, folder)
    return corrections.apply_transfers(x.players(), tables.transfer_requests(spark, folder), S.TEAMS)


@query
def transfer_audit(spark, folder):
    return corrections.transfer_audit(Inputs(spark, folder).players(), tables.transfer_requests(spark, folder), S.TEAMS)


@query
def team_undo_compensate(spark, folder):
    """Two undos in a row: the second one reverses the entry before."""
    direct = ingest.accept_team_entries(Inputs(spark, folder).direct(), S.OPEN_TEAMS)
    once = corrections.undo_team_entry(direct, S.AS_OF)
    twice = corrections.undo_team_entry(once, S.AS_OF)
    return twice.where(F.col("reverses_id").isNotNull())


@query
def team_total_since_reset(spark, folder):
    return corrections.total_since_reset(
        Inputs(spark, folder).direct(), tables.team_resets(spark, folder), S.TEAMS)


@query
def cooldown_accepted(spark, folder):
    return corrections.accepted_changes(tables.class_changes(spark, folder), classes=None)


@query
def cooldown_eligibility(spark, folder):
    return corrections.change_eligibility(tables.class_changes(spark, folder), S.ORDERS_AS_OF, classes=None)


# scalar functions ----------------------------------------------------------------------------------------------------

@query
def classify_category(spark, folder):
    docs = tables.documents(spark, folder)
    return docs.select(
        "doc_id", text.classify(F.col("text"), tables.DOCUMENT_RULES).alias("category"),
        text.classify(F.col("text")).alias("default_category"))


@query
def week_bounds(spark, folder):
    start, end = cal.week_bounds(F.to_date("ts"))
    return Inputs(spark, folder).ledger().select("id", start.alias("week_start"), end.alias("week_end"))


@query
def month_bounds(spark, folder):
    start, end = cal.month_bounds(F.to_date("ts"))
    return Inputs(spark, folder).orders().select("id", start.alias("month_start"), end.alias("month_end"))


@query
def term_bounds(spark, folder):
    start, end = cal.term_bounds(F.to_date("ts"))
    return Inputs(spark, folder).orders().select("id", start.alias("term_start"), end.alias("term_end"))


@query
def month_shift(spark, folder):
    ts = F.col("ts")
    return Inputs(spark, folder).orders().select(
        "id", cal.month_shift(ts, 1).alias("plus_1"), cal.month_shift(ts, 2).alias("plus_2"),
        cal.month_shift(ts, -3).alias("minus_3"))


@query
def round_pct(spark, folder):
    daily = Inputs(spark, folder).ledger().groupBy("player_id", F.to_date("ts").alias("day")).agg(
        rollups.points_in("sport", True).alias("sport"), rollups.points_in("academic", True).alias("academic"))
    return daily.select(
        "player_id", "day", text.share_pct(F.col("sport"), F.col("sport") + F.col("academic")).alias("sport_pct"))


@query
def array_last_n(spark, folder):
    """The last five of the last seven positive days, and whether they hold the last day before ``AS_OF``."""
    days = state.consecutive_days(Inputs(spark, folder).days())
    return days.select(
        "player_id", arrays.keep_last(F.col("days"), 5).alias("last_days"),
        F.array_contains("days", F.lit(S.AS_OF.date())).alias("today"),
        F.size(F.filter("days", lambda d: F.dayofweek(d) == 2)).alias("mondays"),
        F.forall("days", lambda d: d >= F.lit(dt.date(2024, 1, 18))).alias("all_recent"),
        F.exists("days", lambda d: d < F.lit(dt.date(2024, 1, 15))).alias("any_old"))


@query
def json_array_roundtrip(spark, folder):
    days = state.consecutive_days(Inputs(spark, folder).days()).select(
        "player_id", arrays.to_json_days(F.col("days")).alias("days_json"))
    return days.withColumn("days", arrays.from_json_days(F.col("days_json")))


@query
def pseudonym_key(spark, folder):
    return Inputs(spark, folder).players().select("player_id", text.pseudonym_key(F.col("name"), S.SALT).alias("code"))


@query
def flatten_roster(spark, folder):
    """Rosters of at most 1024 neighbouring ids per team and array, flattened again."""
    rosters = Inputs(spark, folder).players().groupBy("team", F.floor(F.col("player_id") / 1024).alias("part")).agg(
        F.collect_list(F.struct("player_id", "name")).alias("members"))
    return rosters.select("team", F.explode("members").alias("m")).select("team", "m.*")


# streams -------------------------------------------------------------------------------------------------------------

@query
def stream_player_state(spark, folder):
    entries = stream_sources.event_stream(spark, folder)
    log = stream_sources.run_appending(stream_players.player_state(entries, S.PRAISE), "player-state")
    rest = list(stream_players.COUNTERS)
    return log.groupBy("player_id").agg(F.max_by(F.struct(*rest), "n").alias("s")).select("player_id", "s.*")


@query
def stream_week_points(spark, folder):
    entries = stream_sources.event_stream(spark, folder)
    weeks = stream_sources.run_updating(stream_windows.week_points(entries), ["player_id", "week_start"], "week-points", "week_start")
    return stream_windows.per_team(weeks, tables.players(spark, folder), "week_start")


@query
def stream_month_points(spark, folder):
    entries = stream_sources.event_stream(spark, folder)
    months = stream_sources.run_updating(stream_windows.month_points(entries), ["player_id", "month"], "month-points", "month")
    return stream_windows.per_team(months, tables.players(spark, folder), "month")


@query
def stream_period_stats(spark, folder):
    """Roll-ups of a ledger that is kept from a stream, whatever the order in which its entries come."""
    entries = stream_sources.event_stream(spark, folder).withColumn("ts", cal.as_wall_clock(F.col("ts")))
    return stream_sources.run_into_ledger(tables.as_ledger(entries, tables.EVENT_RULES), "kept-ledger").read("period_stats")


@query
def stream_hours_at_top(spark, folder):
    """Team points per hour from a stream; the hourly checks read what it has emitted."""
    players = tables.players(spark, folder)
    hours = stream_sources.run_appending(stream_windows.hour_points(stream_sources.event_stream(spark, folder)), "hour-points")
    return snapshots.hours_at_top(stream_windows.per_team(hours, players, "hour"), players, S.FIRST_HOUR, S.AS_OF)


@query
def stream_standings(spark, folder):
    """The hourly checks up to ``NOW``, within the last day of the stream, from hours so far; those the watermark has not closed yet
    are provisional."""
    players, entries = tables.players(spark, folder), stream_sources.event_stream(spark, folder)
    hours = stream_sources.run_updating(stream_windows.hour_points(entries), ["player_id", "hour", "day"], "standings", "day")
    places = snapshots.hourly_positions(stream_windows.per_team(hours, players, "hour"), players, S.FIRST_HOUR, S.NOW)
    closed = Inputs(spark, folder).ledger().agg(F.max("ts") - F.expr(f"INTERVAL {stream_windows.LATENESS}")).scalar()
    provisional = F.col("hour") + F.expr("INTERVAL 1 HOUR") > closed
    led = F.col("position") == 1
    return places.groupBy("team").agg(F.count_if(led).alias("hours"), F.count_if(led & provisional).alias("provisional_hours"))


@query
def stream_award_once(spark, folder):
    entries = stream_sources.event_stream(spark, folder)
    return stream_sources.run_appending(stream_players.awards_once(entries, S.PRAISE), "awards")


@query
def stream_sustained(spark, folder):
    entries = stream_sources.event_stream(spark, folder)
    return stream_sources.run_appending(stream_players.sustained(entries, S.LEVEL, S.LEVEL_DAYS), "sustained")


@query
def stream_no_weak_link(spark, folder):
    """The award of ``badge_no_weak_link`` from a stream of the entries up to ``AS_OF``, whose day is then closed."""
    clock = stream_sources.Clock(spark)
    entries = stream_sources.event_stream(spark, folder).where(F.col("ts") <= cal.as_instant(cal.ntz(S.AS_OF)))
    runs = stream_teams.all_members_sustained(
        clock.with_entries(entries), tables.active_players(spark, folder), S.WEAK_LINK, S.FIRST_DAY, days=S.WEAK_LINK_DAYS)
    end = dt.datetime.combine(S.AS_OF.date() + dt.timedelta(days=1), dt.time(0, 0, 1))
    runs = stream_sources.run_appending(runs, "no-weak-link", clock, end)
    return awards.grant(awards.won(snapshots.first_held(runs, "team"), "no_weak_link", "held_on", "team"), "team")
