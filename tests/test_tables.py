"""Ingest, upkeep, sinks and corrections."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from pointline.functions import text
from pointline.operators import corrections, reports, rollups, state
from pointline.plans.settings import TEAMS
from pointline.session import shared_folder
from pointline.sources import ingest, sinks, upkeep

from .conftest import rows_of

AT = dt.datetime(2024, 1, 20)


def test_entries_are_judged_in_order(spark, make_players):
    raw = spark.createDataFrame([
        (1, "1", "ok", "5", "me"), (2, "  ", "ok", "x", None), (3, "1", "ok", "x", None), (4, "1", " ", "1", None),
        (5, "9", "ok", "1", None), (6, None, "ok", "1", None), (7, "2", None, "1", None), (8, "2", "ok", "-2.5", None),
        (9, "2", "ok", "NaN", None), (10, "2", "ok", None, None), (11, "2", "ok", "Infinity", None), (12, "2", "ok", "1e300", None),
        (13, "2", "ok", "10d", None), (14, "2", "ok", " 9007199254740993", None), (15, "2", "ok", "10000000000000001", None)],
        "id bigint, player_id string, action string, points string, actor string").withColumn("ts", F.lit("t"))
    judged = ingest.validate_entries(raw, make_players([(1, "a", "T"), (2, "b", "T")]))
    assert [s for _, s in rows_of(judged, "id", "status")] == [
        "accepted", "blank player", "bad points", "blank action", "unknown player", "blank player", "blank action",
        "accepted", "bad points", "bad points", "bad points", "bad points", "bad points", "accepted", "bad points"]
    good, bad = ingest.split_accepted(judged)
    assert rows_of(good, "id", "points", "actor") == [(1, 5, "me"), (8, -3, text.DEFAULT_ACTOR), (14, 9007199254740993, text.DEFAULT_ACTOR)]
    assert bad.count() == 12 and "reason" in bad.columns


def test_new_players(spark):
    requests = spark.createDataFrame(
        [(1, " new ", "T"), (2, "new", "T"), (3, "old", "T"), (4, " ", "T"), (5, "x", "?"), (6, "p", "POOL"), (7, "y", None)],
        "id bigint, name string, team string")
    existing = spark.createDataFrame([("old",)], "name string")
    found = ingest.validate_players(requests, existing, ["T"])
    assert rows_of(found, "id", "status") == [
        (1, "accepted"), (2, "duplicate name"), (3, "duplicate name"), (4, "blank name"), (5, "bad team"),
        (6, "accepted"), (7, "bad team")]
    assert rows_of(found.where("id IN (1, 6)"), "id", "is_drafted") == [(1, True), (6, False)]


def test_team_entries_get_a_default_text(spark):
    entries = spark.createDataFrame([("T", None, 3), ("T", "x", 3), ("?", "x", 3)], "team string, action string, points bigint")
    assert rows_of(ingest.accept_team_entries(entries, ["T"]), "action") == [("Points franchise (+3)",), ("x",)]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k bigint, v string, n bigint")
    new = spark.createDataFrame([(2, "c", 3), (3, "d", 4)], "k bigint, v string, n bigint")
    assert rows_of(upkeep.upsert_latest(old, new, ["k"])) == [(1, "a", 1), (2, "c", 3), (3, "d", 4)]
    twice = spark.createDataFrame([(2, "y", 9, 1), (2, "c", 3, 2), (3, "d", 4, 1)], "k bigint, v string, n bigint, seq int")
    for rows in (twice, twice.orderBy("seq"), twice.orderBy(F.desc("seq"))):
        assert rows_of(upkeep.upsert_latest(old, rows, ["k"], "seq")) == [(1, "a", 1), (2, "c", 3), (3, "d", 4)]
        assert rows_of(upkeep.insert_if_absent(old.where("k = 1"), rows, ["k"], "seq")) == [(1, "a", 1), (2, "y", 9), (3, "d", 4)]
    once = upkeep.insert_if_absent(old, new.unionByName(new), ["k"])
    assert rows_of(once) == [(1, "a", 1), (2, "b", 2), (3, "d", 4)]
    assert rows_of(upkeep.insert_if_absent(once, new, ["k"])) == rows_of(once)


def test_evolve(spark):
    old = spark.createDataFrame([(1,)], "k bigint")
    new = spark.createDataFrame([(2, None), (3, "c")], "k bigint, v string")
    assert rows_of(upkeep.evolve(old, new, {"v": "?"})) == [(1, "?"), (2, "?"), (3, "c")]


def test_renames_are_checked(spark, make_ledger, make_players):
    players = make_players([(p, str(p), "T") for p in (1, 2, 3, 4, 5)])
    mapping = spark.createDataFrame(
        [(1, 10), (2, 5), (3, 30), (4, 30), (9, 90), (5, 50), (5, 51)], "old_id bigint, new_id bigint")
    renames = upkeep.checked_renames(mapping, players)
    assert rows_of(renames) == [(1, 10)]
    ledger = make_ledger([(1, "2024-01-01", 1, "a", 1), (2, "2024-01-01", 2, "a", 1)])
    moved = upkeep.rekey(ledger, renames)
    assert moved.columns == ledger.columns and rows_of(moved, "player_id") == [(2,), (10,)]
    audit = upkeep.rename_audit(renames, F.lit(AT).cast("timestamp_ntz"))
    assert rows_of(audit, "player_id", "points", "kind") == [(10, 0, "system")]


def test_delete_leaves_no_trace(spark, make_ledger):
    ledger = make_ledger([(1, "2024-01-01", 1, "a", 1), (2, "2024-01-01", 2, "a", 1)])
    gone = spark.createDataFrame([(1,), (1,)], "player_id bigint")
    assert rows_of(upkeep.delete_entities(ledger, gone), "player_id") == [(2,)]


def test_reload_is_idempotent(spark, make_ledger):
    stats = rollups.period_stats(make_ledger([(1, "2024-01-01", 1, "a", 4), (2, "2024-02-01", 1, "a", 5)]))
    folder = shared_folder(spark, "reload")
    once = rows_of(sinks.reload_table(stats, folder, ["period_type"]).select(*stats.columns))
    assert rows_of(sinks.reload_table(stats, folder, ["period_type"]).select(*stats.columns)) == once == rows_of(stats)
    assert sorted(p for p in os.listdir(folder) if "=" in p) == [
        "period_type=month", "period_type=term", "period_type=week"]


def test_partition_overwrite_keeps_the_others(spark):
    folder = shared_folder(spark, "partitions")
    sinks.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "p string, v int"), folder, ["p"])
    sinks.replace_partitions(spark.createDataFrame([("b", 3)], "p string, v int"), folder, ["p"])
    assert rows_of(spark.read.parquet(folder), "p", "v") == [("a", 1), ("b", 3)]


def test_ledger_by_day_is_pruned(spark, make_ledger):
    folder = shared_folder(spark, "ledger")
    sinks.write_ledger(make_ledger([(i, f"2024-01-{i:02d} 05:00:00", 1, "a", 1) for i in range(1, 10)]), folder)
    back = spark.read.parquet(folder).where(F.col("day") >= F.lit(dt.date(2024, 1, 8)))
    assert rows_of(back, "id") == [(8,), (9,)]
    assert "PartitionFilters: [isnotnull(day" in back._jdf.queryExecution().executedPlan().toString()


def test_csv_sheets(spark, make_ledger, make_players):
    players = make_players([(1, "a;b", "T"), (2, "b", "T"), (3, "c", "U")])
    ledger = make_ledger([(1, "2024-01-01", 1, "sport", 4), (2, "2024-01-01", 2, "school", 3)])
    scores = rollups.scoreboard(players, ledger)
    badges = spark.createDataFrame([(1, "x")], "player_id bigint, badge_id string")
    sheet = reports.player_sheet(scores, rollups.period_stats(ledger, ("month",)), state.streaks(ledger), badges)
    folder = shared_folder(spark, "sheets")
    sinks.write_sheets({"players": sheet, "teams": reports.team_sheet(rollups.team_summary(scores))}, folder)
    back = spark.read.option("sep", ";").option("header", True).csv(os.path.join(folder, "players"))
    assert [tuple(r) for r in back.collect()] == [
        ("a;b", "T", "4", "4", "0", "1", "1", "1"), ("b", "T", "3", "0", "3", "1", "1", "0"),
        ("c", "U", "0", "0", "0", "0", "0", "0")]
    teams = spark.read.option("sep", ";").option("header", True).csv(os.path.join(folder, "teams"))
    assert rows_of(teams, "team", "avg_score") == [("T", "3.5"), ("U", "0")]


def test_sheets_are_read_back_as_they_were(spark):
    odd = spark.createDataFrame([("a;b", 'say "x"', 1, 2.5), ("two\nlines", "", 2, None), (None, "é", None, 0.1), ('"', "\\", 3, 1.0), ("", "end\\", 4, None)],
                                "a string, b string, n int, x double")
    folder = shared_folder(spark, "odd-sheets")
    for rows in (odd.limit(1), odd):  # the second export replaces the first as a whole
        sinks.write_sheets({"odd": rows, "more": rows.select("n")}, folder)
    wanted = odd.replace("", None, ["a", "b"])
    assert sorted(map(str, sinks.read_sheet(spark, folder, "odd", odd.schema).collect())) == sorted(map(str, wanted.collect()))
    assert sinks.read_sheet(spark, folder, "more", odd.select("n").schema).where("n IS NOT NULL").count() == 4
    sinks.write_sheets({"odd": odd}, folder)
    assert not os.path.exists(os.path.join(folder.removeprefix("file://"), "more"))


# corrections ---------------------------------------------------------------------------------------------------------

def test_undo_then_replay_restores_state(make_ledger):
    dice = random.Random(2)
    rows = [(i, f"2024-01-{1 + i // 10:02d}", dice.randint(1, 5), "a", dice.randint(-3, 5)) for i in range(200)]
    ledger = make_ledger(rows)
    undone = corrections.undo_last(ledger)
    assert undone.count() == 195
    last = ledger.join(undone.select("id"), "id", "left_anti")
    assert rows_of(state.streaks(undone.unionByName(last))) == rows_of(state.streaks(ledger))
    one = corrections.undo_last(ledger, ledger.where("player_id = 3").select("player_id"))
    assert one.count() == 199


def test_undo_restores_a_streak_broken_by_the_undone_entry(make_ledger):
    ledger = make_ledger([(1, "2024-01-01", 1, "a", 1), (2, "2024-01-01", 1, "a", 1), (3, "2024-01-02", 1, "a", -9)])
    assert rows_of(state.streaks(corrections.undo_last(ledger))) == [(1, 2, 2)]


def test_team_undo_twice_reverses_two_entries(spark):
    direct = spark.sql("""SELECT * FROM VALUES (1L, TIMESTAMP_NTZ '2024-01-01', 'T', 'a', 5L, 'x'),
        (2L, TIMESTAMP_NTZ '2024-01-02', 'T', 'b', 7L, 'x'), (3L, TIMESTAMP_NTZ '2024-01-02', 'U', 'c', 9L, 'x')
        AS d(id, ts, team, action, points, actor)""")
    once = corrections.undo_team_entry(direct, AT)
    twice = corrections.undo_team_entry(once, AT)
    thrice = corrections.undo_team_entry(twice, AT)
    assert rows_of(once.groupBy("team").agg(F.sum("points"))) == [("T", 5), ("U", 0)]
    assert rows_of(twice.groupBy("team").agg(F.sum("points"))) == [("T", 0), ("U", 0)]
    assert thrice.count() == twice.count() == 6
    assert twice.select("id").distinct().count() == 6
    assert rows_of(once.where("reverses_id = 2"), "action", "points") == [("Annulation: b", -7)]


def test_reset_counts_only_what_follows(spark):
    direct = spark.createDataFrame([(1, "A", 5), (4, "A", 2), (5, "B", 3), (6, "?", 9)], "id bigint, team string, points bigint")
    resets = spark.createDataFrame([(2, "A"), (3, "A"), (7, "?")], "id bigint, team string")
    assert rows_of(corrections.total_since_reset(direct, resets, ["A", "B"])) == [("A", 2), ("B", 3)]


def test_last_valid_transfer_wins(spark, make_players):
    players = make_players([(1, "a", TEAMS[0]), (2, "b", TEAMS[0]), (3, "c", TEAMS[0])])
    requests = spark.createDataFrame([(1, 1, TEAMS[1]), (2, 1, "POOL"), (3, 1, "?"), (4, 2, TEAMS[2]), (5, 2, TEAMS[3])],
                                     "id bigint, player_id bigint, target string").withColumn("ts", F.lit("t"))
    assert rows_of(corrections.apply_transfers(players, requests, TEAMS), "player_id", "team", "is_drafted") == [
        (1, "POOL", False), (2, TEAMS[3], True), (3, TEAMS[0], True)]
    audit = corrections.transfer_audit(players, requests, TEAMS)
    assert rows_of(audit, "id", "category", "action") == [
        (1, "draft", f"Drafté vers {TEAMS[1]}"), (2, "undraft", f"Renvoyé de {TEAMS[1]} vers la réserve"),
        (4, "draft", f"Drafté vers {TEAMS[2]}"), (5, "draft", f"Drafté vers {TEAMS[3]}")]
    for bits in (0, 20):
        origins = corrections.transfer_origins(players, requests, TEAMS, bits=bits)
        assert rows_of(origins, "id", "origin") == [(1, TEAMS[0]), (2, TEAMS[1]), (4, TEAMS[0]), (5, TEAMS[2])]


def changes(spark, *moments):
    frame = spark.createDataFrame(
        [(i, m, 1, "mage" if i % 2 else "bard") for i, m in enumerate(moments, 1)],
        "id bigint, ts string, player_id bigint, player_class string")
    return frame.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_cooldown_counts_months_not_days(spark):
    requests = changes(spark, "2024-01-31", "2024-03-31", "2024-04-01", "2024-04-02", "2024-06-30", "2024-07-01")
    assert rows_of(corrections.accepted_changes(requests), "id") == [(1,), (3,), (6,)]


def test_cooldown_against_brute_force(spark):
    dice = random.Random(4)
    rows = [(i, str(dt.date(2020, 1, 1) + dt.timedelta(days=dice.randint(0, 1500))), dice.randint(1, 20), "mage")
            for i in range(600)]
    frame = spark.createDataFrame(rows, "id bigint, ts string, player_id bigint, player_class string")
    wanted, last = [], {}
    for i, t, p, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        month = int(t[:4]) * 12 + int(t[5:7])
        if p not in last or month - last[p] >= 3:
            last[p] = month
            wanted.append((i,))
    found = corrections.accepted_changes(frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert rows_of(found, "id") == sorted(wanted)


def test_eligibility_names_the_next_date(spark):
    requests = changes(spark, "2023-11-30")
    early = corrections.change_eligibility(requests, dt.datetime(2024, 1, 31)).first()
    assert (early["can_change"], early["next_change"]) == (False, dt.datetime(2024, 3, 1))
    later = corrections.change_eligibility(requests, dt.datetime(2024, 2, 1)).first()
    assert (later["can_change"], later["next_change"]) == (True, None)
    assert corrections.accepted_changes(requests, classes=["bard"]).count() == 0


# reports -------------------------------------------------------------------------------------------------------------

def test_breakdown_guards_and_ties(make_ledger, make_players):
    players = make_players([(1, "a", "T"), (2, "b", "U"), (3, "c", "V"), (4, "d", "W")])
    ledger = make_ledger([
        (1, "2024-01-15", 1, "sport", 6), (2, "2024-01-16", 1, "school", -2), (3, "2024-01-17", 2, "other", 3),
        (4, "2024-01-18", 4, "sport", 1), (5, "2024-01-18", 4, "school", 1), (6, "2024-01-22", 3, "sport", 5)])
    signed = reports.team_breakdown(ledger, players, AT)
    assert rows_of(signed, "team", "total_points", "sport_percentage", "academic_percentage") == [
        ("T", 4, 150.0, -50.0), ("U", 3, 0.0, 0.0), ("W", 2, 50.0, 50.0)]
    positive = reports.breakdown_from_ledger(ledger, players, AT)
    assert rows_of(positive, "team", "total_points", "active_players", "sport_percentage") == [
        ("T", 6, 1, 100.0), ("U", 3, 1, 0.0), ("V", 0, 0, 0.0), ("W", 2, 1, 50.0)]
    assert rows_of(reports.most_balanced(signed), "team") == [("W",)]
    assert rows_of(reports.most_active(signed), "team") == [("W",)]
    assert rows_of(reports.breakdown_totals(signed).where("team = 'ALL'"), "total_points", "active_players") == [(9, 3)]


def test_badge_list_is_empty_not_null(spark, make_players):
    badges = spark.createDataFrame([(1, "x", "X", "or"), (1, "a", "A", "or")],
                                   "player_id bigint, badge_id string, badge_name string, rarity string")
    found = reports.players_with_badges(make_players([(1, "a", "T"), (2, "b", "T")]), badges)
    assert {r["player_id"]: [b["badge_id"] for b in r["badges"]] for r in found.collect()} == {1: ["a", "x"], 2: []}
