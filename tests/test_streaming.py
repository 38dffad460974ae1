"""A stream over several files, one per micro-batch, ends where the batch operators do."""

import datetime as dt
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pointline.functions import calendar as cal
from pointline.operators import awards, rollups, snapshots, state
from pointline.session import shared_folder
from pointline.sources import tables
from pointline.streaming import players as stream_players
from pointline.streaming import sources, teams, windows

from .conftest import rows_of

PRAISE = ("signup",)


@pytest.fixture(scope="module")
def folder(spark):
    """Events in seven files in order of arrival, with a player who has a third of them."""
    dice = random.Random(11)
    start, moment, rows = dt.datetime(2024, 1, 29), dt.timedelta(), []
    for i in range(1400):
        moment += dt.timedelta(minutes=dice.randint(1, 80))
        rows.append((i, start + moment, 0 if dice.random() < 0.33 else dice.randint(1, 12),
                     dice.choice(["error", "click", "signup", "view"]), dice.choice([0.4, 3.0, 20.5, 60.0])))
    where = shared_folder(spark, "events")
    frame = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    for part in range(7):
        path = os.path.join(where, f"part{part}")
        frame.where(f"event_id DIV 200 = {part}").coalesce(1).write.parquet(path)
        written, = [f for f in os.listdir(path) if f.endswith(".parquet")]
        os.link(os.path.join(path, written), os.path.join(where, f"events{part}.parquet"))
        os.utime(os.path.join(where, f"events{part}.parquet"), (1_700_000_000 + part, 1_700_000_000 + part))
    return where


@pytest.fixture(scope="module")
def entries(spark, folder):
    schema = spark.read.parquet(os.path.join(folder, "events0.parquet")).schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
              .option("maxFilesPerTrigger", 1).parquet(folder))
    return stream.select(
        F.col("event_id").alias("id"), cal.as_instant(F.col("ts")).alias("ts"), F.col("user_id").alias("player_id"),
        F.col("event_type").alias("action"), tables.event_points().alias("points"))


@pytest.fixture(scope="module")
def ledger(spark, folder):
    events = spark.read.parquet(*[os.path.join(folder, f"events{i}.parquet") for i in range(7)])
    return tables.as_ledger(events.select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("player_id"), F.col("event_type").alias("action"),
        tables.event_points().alias("points")), tables.EVENT_RULES)


@pytest.fixture(scope="module")
def players(spark):
    return spark.createDataFrame([(p, str(p), "TU"[p % 2]) for p in range(13)], "player_id bigint, name string, team string")


def test_player_state(spark, entries, ledger):
    log = sources.run_appending(stream_players.player_state(entries, PRAISE), "state")
    assert log.groupBy("player_id").count().agg(F.max("count")).first()[0] == 7  # one row per micro-batch
    latest = log.groupBy("player_id").agg(F.max_by(F.struct(*stream_players.COUNTERS[1:]), "n").alias("s"))
    batch = state.player_state(ledger, dt.datetime(2024, 3, 1), PRAISE)
    columns = ("player_id", *stream_players.COUNTERS[1:])
    assert rows_of(latest.select("player_id", "s.*"), *columns) == rows_of(batch, *columns)


def test_awards_are_given_once(spark, entries, ledger):
    stream = sources.run_appending(stream_players.awards_once(entries, PRAISE), "awards")
    batch = awards.grant(awards.entry_awards(awards.entry_summary(ledger, PRAISE)))
    columns = ("player_id", "badge_id", "points", "date_earned")
    assert rows_of(stream, *columns) == rows_of(batch, *columns)


def test_weeks_are_emitted_when_over(spark, entries, ledger, players):
    stream = windows.per_team(sources.run_appending(windows.week_points(entries), "weeks"), players, "week_start").withColumn(
        "period_start", F.to_date("week_start"))
    batch = rollups.team_period_points(rollups.player_days(ledger), players, period_types=("week",))
    found, wanted = rows_of(stream, "team", "period_start", "points"), rows_of(batch, "team", "period_start", "points")
    assert found and set(found) < set(wanted)
    # the watermark is a day behind the last gain
    end = ledger.where("points > 0").agg(F.max("ts")).first()[0] - dt.timedelta(days=1)
    closed = [r for r in wanted if dt.datetime.combine(r[1], dt.time()) + dt.timedelta(days=7) <= end]
    assert found == closed


def test_months_grow(spark, entries, ledger, players):
    stream = windows.per_team(sources.run_updating(windows.month_points(entries), ["player_id", "month"], "months", "month"), players, "month")
    batch = rollups.team_period_points(rollups.player_days(ledger), players, period_types=("month",)).withColumn(
        "month", F.date_format("period_start", "yyyy-MM"))
    columns = ("team", "month", "points")
    assert rows_of(stream, *columns) == rows_of(batch, *columns)


@pytest.mark.parametrize("level, days", [(50, 2), (0, 5), (400, 3)])
def test_sustained(spark, entries, ledger, level, days):
    stream = sources.run_appending(stream_players.sustained(entries, level, days), "sustained")
    span, total, start, wanted, last = dt.timedelta(days=days), {}, {}, [], {}
    rows = sorted(ledger.select("id", "ts", "player_id", "points").collect())
    for _, ts, player, points in rows:
        total[player] = total.get(player, 0) + points
        last[player] = ts
        if total[player] >= level:
            start.setdefault(player, ts)
        elif player in start:
            begin = start.pop(player)
            if ts >= begin + span:
                wanted.append((player, begin))
    mark = rows[-1][1] - dt.timedelta(days=1)
    wanted += [(p, b) for p, b in start.items() if max(last[p], mark) >= b + span]
    found = stream.select("player_id", "from_ts")
    assert wanted and rows_of(found) == sorted(wanted)


def test_shared_folder_follows_the_setting():
    def session(master, setting=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting or default),
                               sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("yarn", "hdfs://x/y/"), "z").startswith("hdfs://x/y/z-")
    assert os.path.isdir(os.path.dirname(shared_folder(session("local[2]"), "z")))
    with pytest.raises(ValueError):
        shared_folder(session("yarn"), "z")


def test_weeks_so_far(entries, ledger, players):
    stream = windows.per_team(sources.run_updating(windows.week_points(entries), ["player_id", "week_start"], "weeks", "week_start"), players, "week_start")
    batch = rollups.team_period_points(rollups.player_days(ledger), players, period_types=("week",))
    found = rows_of(stream.withColumn("period_start", F.to_date("week_start")), "team", "period_start", "points")
    assert found == rows_of(batch, "team", "period_start", "points")


def test_hours_so_far_are_kept_by_key(entries, ledger, players):
    """One row per player and hour, the last day's hours among them, from seven micro-batches."""
    kept = sources.run_updating(windows.hour_points(entries), ["player_id", "hour", "day"], "hours", "day")
    assert kept.count() == kept.select("player_id", "hour").distinct().count()
    found = rows_of(windows.per_team(kept, players, "hour"), "team", "hour", "points")
    assert found == rows_of(snapshots.team_hours(ledger, players), "team", "hour", "points")
    assert max(h for _, h, _ in found) == ledger.agg(F.max("ts")).first()[0].replace(minute=0)


def test_stream_reads_a_file_a_folder_and_no_neighbour(spark, tmp_path):
    rows = spark.range(10).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    rows.repartition(3).write.parquet(str(tmp_path / "folder/events.parquet"))
    rows.coalesce(1).toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    rows.write.parquet(str(tmp_path / "folder/events_old.parquet"))
    for place in (tmp_path / "folder", tmp_path):
        assert sources.run_appending(sources.stream_table(spark, str(place), "events"), "copy").count() == 10
    with pytest.raises(FileNotFoundError):
        sources.stream_table(spark, str(tmp_path / "none"), "events")


@pytest.mark.parametrize("files, level, months, days", [(7, 40, 0, 4), (1, -1000, 0, 5), (7, 0, 1, 2)])
def test_all_members_sustained(spark, folder, ledger, players, files, level, months, days):
    """Equal to the batch operator however many files a micro-batch has; players without entries, an empty team, the last day."""
    end = ledger.agg(F.max("ts")).first()[0]
    schema = spark.read.parquet(os.path.join(folder, "events0.parquet")).schema
    events = (spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files).parquet(folder))
    entries = events.select(F.col("event_id").alias("id"), cal.as_instant(F.col("ts")).alias("ts"), F.col("user_id").alias("player_id"),
                            tables.event_points().alias("points"))
    members = players.where("player_id < 13").unionByName(spark.createDataFrame([(99, "idle", "V")], players.schema))
    first = dt.date(2024, 2, 2)
    clock = sources.Clock(spark)
    runs = teams.all_members_sustained(clock.with_entries(entries), members, level, first, months, days)
    runs = sources.run_appending(runs, "all-members", clock, dt.datetime.combine(end.date() + dt.timedelta(days=1), dt.time(0, 0, 1)))
    intervals = snapshots.score_intervals(rollups.player_days(ledger), members, first, end.date())
    good = snapshots.team_days_all(intervals, members, F.col("score") >= level, first, end.date())
    wanted = rows_of(snapshots.sustained(good, "team", months, days), "team", "from_day", "held_on")
    assert wanted and rows_of(runs) == wanted
