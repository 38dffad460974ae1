"""Stored tables that change together: upserts, renames and deletions in one step."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pointline.functions import calendar as cal
from pointline.operators import rollups
from pointline.session import shared_folder
from pointline.sources import store, upkeep

from .conftest import rows_of

DAILY = "player_id bigint, day date, points bigint"


def files(held, name):
    """Data files of a table and when they were written."""
    return {f: os.stat(f.removeprefix("file://").removeprefix("file:")).st_mtime_ns for f in held.read(name).inputFiles()}


@pytest.fixture
def held(spark):
    return store.Store(spark, shared_folder(spark, "store"))


def daily(spark, rows):
    return spark.createDataFrame(rows, "player_id bigint, day string, points bigint").withColumn("day", F.col("day").cast("date"))


def test_upsert_touches_what_it_must(spark, held):
    held.create("daily", daily(spark, [(p, f"2024-01-{d:02d}", p + d) for p in range(5) for d in range(1, 11)]), "day", ["player_id", "day"])
    before = files(held, "daily")
    updates = daily(spark, [(1, "2024-01-03", 100), (9, "2024-01-03", 9), (2, "2024-02-01", 7)])
    assert sorted(held.upsert("daily", updates)) == ["2024-01-03", "2024-02-01"]
    wanted = sorted([(p, dt.date(2024, 1, d), p + d) for p in range(5) for d in range(1, 11) if (p, d) != (1, 3)]
                    + [(1, dt.date(2024, 1, 3), 100), (9, dt.date(2024, 1, 3), 9), (2, dt.date(2024, 2, 1), 7)])
    assert rows_of(held.read("daily")) == wanted
    after = files(held, "daily")
    assert {f for f in before if f not in after} == {f for f in before if "2024-01-03" in f}
    assert all(after[f] == t for f, t in before.items() if f in after)
    held.upsert("daily", updates)  # again: the same rows
    held.upsert("daily", updates.limit(0))
    assert rows_of(held.read("daily")) == wanted and held.snapshot()[0] == 3
    held.clean()
    assert rows_of(held.read("daily")) == wanted
    assert rows_of(held.read("daily", ["2024-02-01", "no such day"])) == [(2, dt.date(2024, 2, 1), 7)]


def test_a_cut_off_or_late_change_is_not_seen(spark, held):
    held.create("daily", daily(spark, [(1, "2024-01-01", 1)]), "day", ["player_id", "day"])
    base, tables = held.snapshot()
    table = tables["daily"]
    changed = held.replaced("daily", table, ["2024-01-01"], daily(spark, [(1, "2024-01-01", 5)]))  # written, not published
    assert rows_of(held.read("daily", None), "points") == [(1,)]
    held.upsert("daily", daily(spark, [(2, "2024-01-01", 2)]))
    with pytest.raises(Exception, match="exist"):
        held.commit(base, {"daily": changed})  # another change came first
    assert rows_of(held.read("daily"), "player_id", "points") == [(1, 1), (2, 2)]


def test_odd_tables(spark, held):
    rows = spark.createDataFrame([(1, None, "a;b"), (2, "x y/z=%", None)], "k bigint, `part` string, v string")
    held.create("odd", rows, "part", ["k", "part"])
    held.upsert("odd", spark.createDataFrame([(1, None, "new"), (3, "x y/z=%", "")], rows.schema))
    assert rows_of(held.read("odd"), "k", "v") == [(1, "new"), (2, None), (3, "")]
    held.create("none", rows.limit(0), None, ["k"])
    assert held.read("none").count() == 0
    held.upsert("none", rows)
    assert held.read("none").count() == 2
    held.create("moving", rows, "part", ["k"])
    with pytest.raises(ValueError):
        held.upsert("moving", rows)
    held.create("by_key", rows, "k", ["k"])
    with pytest.raises(ValueError):
        held.change_rows("k", rows, lambda r: r)


@pytest.fixture
def full(spark, held, make_ledger, make_players):
    ledger = make_ledger([(i, f"2024-01-{1 + i // 10:02d} 10:00:00", i % 7, "sport" if i % 2 else "school", i - 20) for i in range(90)])
    held.create("ledger", ledger.withColumn("day", F.to_date("ts")), "day", ["day", "id"])
    held.create("players", make_players([(p, str(p), "TU"[p % 2]) for p in range(8)]), None, ["player_id"])
    held.create("badges", spark.createDataFrame([(p, "b", 5) for p in range(7)], "player_id bigint, badge_id string, points bigint"), None, ["player_id", "badge_id"])
    held.create("period_stats", rollups.period_stats(ledger), "period_type", ["player_id", "period_type", "period_start"])
    return held


def agree(held):
    """Roll-ups are those of the ledger; everyone in them and in the badges is a player."""
    stats = held.read("period_stats")
    fresh = rollups.period_stats(held.read("ledger"))
    assert rows_of(stats, *sorted(stats.columns)) == rows_of(fresh, *sorted(stats.columns))
    for name in ("ledger", "badges", "period_stats"):
        assert held.read(name).join(held.read("players"), "player_id", "left_anti").count() == 0


def test_rename_everywhere(spark, full):
    """Free ids are taken; chains, cycles, doubled and taken ids are refused, whatever their order."""
    renames = spark.createDataFrame([(1, 101), (2, 102), (3, 4), (4, 5), (5, 6), (6, 5), (0, 7), (7, 200), (7, 201), (50, 300)], "old_id bigint, new_id bigint")
    totals = {p: s for p, s in rows_of(rollups.player_scores(full.read("ledger")))}
    seen = upkeep.rename_everywhere(full, renames, cal.ntz(dt.datetime(2024, 3, 1)))
    assert rows_of(full.read("players"), "player_id") == [(p,) for p in (0, 3, 4, 5, 6, 7, 101, 102)]
    assert full.snapshot()[0] == 5 and "2024-03-01" in seen["ledger"]  # one step for all tables
    assert rows_of(full.read("badges"), "player_id") == [(p,) for p in (0, 3, 4, 5, 6, 101, 102)]
    after = {p: s for p, s in rows_of(rollups.player_scores(full.read("ledger")))}
    assert after == {{1: 101, 2: 102}.get(p, p): s for p, s in totals.items()}
    added = full.read("ledger").where("id >= 90")
    assert rows_of(added, "id", "player_id", "points", "kind", "action") == [
        (90, 101, 0, "system", 'Nom changé de "1" vers "101"'), (91, 102, 0, "system", 'Nom changé de "2" vers "102"')]
    agree(full)
    upkeep.rename_everywhere(full, renames, cal.ntz(dt.datetime(2024, 3, 1)))  # nothing is left to rename
    assert full.read("ledger").count() == 92


def test_delete_everywhere(spark, full):
    gone = spark.createDataFrame([(1,), (1,), (5,), (77,)], "player_id bigint")
    full.upsert("ledger", full.read("ledger").where("id = 89").withColumns({"id": F.lit(500).cast("bigint"), "day": F.lit("2024-06-01").cast("date"), "ts": F.lit("2024-06-01").cast("timestamp_ntz"), "player_id": F.lit(2).cast("bigint")}))
    before = files(full, "ledger")
    seen = upkeep.delete_everywhere(full, gone)
    for name in ("ledger", "players", "badges", "period_stats"):
        assert full.read(name).where("player_id IN (1, 5)").count() == 0
    assert "2024-06-01" not in seen["ledger"] and {f for f in before if "2024-06-01" in f} <= set(files(full, "ledger"))
    full.upsert("period_stats", rollups.period_stats(full.read("ledger")))  # the added entry
    agree(full)
