"""Roll-ups kept by differences are those of a full rebuild, and only what changes is written."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from pointline.operators import rollups
from pointline.session import shared_folder
from pointline.sources import repair, store
from pointline.streaming import sources

from .conftest import rows_of
from .test_store import files


@pytest.fixture
def held(spark):
    return store.Store(spark, shared_folder(spark, "store"))


def entries(count, seed):
    """Two months, a third of the entries by one player, out of order by id."""
    dice = random.Random(seed)
    return [(i, f"{dt.datetime(2024, 1, 1) + dt.timedelta(hours=dice.randint(0, 1500))}", 0 if dice.random() < 0.33 else dice.randint(1, 9),
             dice.choice(["sport", "school", "rest"]), dice.randint(-9, 20), dice.choice(["action"] * 4 + ["system"])) for i in range(count)]


def rebuilt(held):
    return rows_of(rollups.period_stats(held.read("ledger")), *repair.KEYS, *repair.MEASURES)


def kept(held):
    return rows_of(held.read("period_stats"), *repair.KEYS, *repair.MEASURES)


def test_late_corrected_moved_and_withdrawn(spark, held, make_ledger):
    rows = entries(400, 1)
    ledger = make_ledger(rows)
    repair.create(held, ledger.where("id < 390"))
    before, stats = files(held, "ledger"), files(held, "period_stats")
    change = ledger.where("id BETWEEN 385 AND 394").withColumns({
        "points": F.when(F.col("id") == 386, 500).otherwise(F.col("points")).cast("bigint"),
        "player_id": F.when(F.col("id") == 387, 77).otherwise(F.col("player_id")).cast("bigint"),
        "was_day": F.when(F.col("id") == 388, F.to_date("ts")),
        "ts": F.when(F.col("id") == 388, F.col("ts") + F.expr("INTERVAL 40 DAYS")).otherwise(F.col("ts")),
        "gone": F.col("id").isin(385, 394)})
    seen = repair.apply_changes(held, change)
    assert kept(held) == rebuilt(held)
    stored = {r.id: r for r in held.read("ledger").collect()}
    assert sorted(stored) == [i for i in range(394) if i != 385]  # 394 was never there
    assert (stored[386].points, stored[387].player_id, stored[388].day) == (500, 77, stored[388].ts.date())
    assert 1 < len(seen["ledger"]) <= 11 and len(seen["period_stats"]) < len(stats)
    after = files(held, "ledger")
    untouched = [f for f in before if not any(d in f for d in seen["ledger"])]
    assert len(untouched) > 30 and all(after[f] == before[f] for f in untouched)
    after = files(held, "period_stats")
    assert all(after[f] == stats[f] for f in stats if not any(s in f for s in seen["period_stats"]))
    assert "period_stats" not in repair.apply_changes(held, change)  # again: no sum changes
    assert kept(held) == rebuilt(held)


def test_periods_vanish_with_their_last_entry(spark, held, make_ledger):
    repair.create(held, make_ledger([(1, "2024-01-01 10:00:00", 1, "sport", 0), (2, "2024-05-05 10:00:00", 1, "sport", 3)]))
    repair.apply_changes(held, make_ledger([(1, "2024-01-01 10:00:00", 1, "sport", 0)]).withColumn("gone", F.lit(True)))
    assert {r.period_start.month for r in held.read("period_stats").collect()} == {4, 5}  # the week of Monday, 29 April
    assert kept(held) == rebuilt(held)


def test_odd_changes(spark, held, make_ledger):
    none = make_ledger([(1, "2024-01-01 10:00:00", 1, "sport", 4)]).limit(0)
    repair.create(held, none)
    assert repair.apply_changes(held, none) == {} and held.snapshot()[0] == 2
    odd = make_ledger([(1, "2024-01-01 10:00:00", 1, "sport", 4), (1, "2024-01-01 10:00:00", 1, "sport", 4), (1, "2024-01-01 10:00:00", 1, "sport", 9),
                       (None, "2024-01-01 10:00:00", 1, "sport", 1), (2, None, 1, "sport", 1)]).withColumns({"note": F.lit("x"), "gone": F.lit(None).cast("boolean")})
    repair.apply_changes(held, odd)
    assert rows_of(held.read("ledger"), "id", "points") == [(1, 9)]
    assert kept(held) == rebuilt(held)


def test_stream_in_any_order(spark, make_ledger):
    """Four files, the days of each all over the two months; the last repeats entries with other points."""
    rows = entries(300, 2)
    where = shared_folder(spark, "late")
    ledger = make_ledger(rows)
    parts = [ledger.where(f"id % 3 = {k}") for k in range(3)] + [ledger.where("id < 30").withColumn("points", F.col("points") * 2)]
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(os.path.join(where, f"f{k}"))
        path, = [os.path.join(where, f"f{k}", f) for f in os.listdir(os.path.join(where, f"f{k}")) if f.endswith(".parquet")]
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(where, "f*"))
    held = sources.run_into_ledger(stream, "kept")
    last = ledger.withColumn("points", F.when(F.col("id") < 30, F.col("points") * 2).otherwise(F.col("points")))
    assert held.read("ledger").count() == 300
    assert kept(held) == rebuilt(held) == rows_of(rollups.period_stats(last), *repair.KEYS, *repair.MEASURES)
