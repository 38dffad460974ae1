"""Ordered operators with a player who holds a third of all rows, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pointline.operators import ordered

from .conftest import rows_of


@pytest.fixture(scope="module")
def entries():
    dice = random.Random(7)
    rows = []
    for i in range(3000):
        player = 0 if dice.random() < 0.34 else dice.randint(1, 60)
        kind = "system" if dice.random() < 0.05 else "action"
        rows.append((i * 3, f"2024-01-{1 + i // 120:02d} 10:00:00", player, dice.choice(["good", "bad"]),
                     dice.choice([-9, -2, 0, 1, 3, 5]), kind))
    dice.shuffle(rows)
    return rows


def expected_states(entries):
    state = defaultdict(lambda: [0, 0, 0, 0])
    out = []
    for i, _, player, action, points, kind in sorted(entries):
        s = state[player]
        s[0] += points
        if kind == "action":
            s[1] = min(s[1], s[0])
            s[2] = s[2] + 1 if points > 0 else 0
            s[3] += action == "good"
        out.append((i, *s))
    return out


# bits 20: one chunk holds all ids; 0: each entry is a chunk of its own
@pytest.mark.parametrize("bits", [20, 7, 4, 0])
def test_running_state(make_ledger, entries, bits):
    state = ordered.running_state(make_ledger(entries), {"good": F.col("action") == "good"}, bits=bits)
    assert rows_of(state, "id", "total", "lowest", "streak", "good") == expected_states(entries)


@pytest.mark.parametrize("bits", [20, 6, 0])
def test_running_total_and_record(make_ledger, entries, bits):
    totals = ordered.running_total(make_ledger(entries), bits=bits)
    wanted = [(i, total) for i, total, *_ in expected_states(entries)]
    assert rows_of(totals, "id", "total") == wanted
    assert totals.where(F.col("prev_total") + F.col("points") != F.col("total")).count() == 0

    records, best = [], None
    for i, total in wanted:
        if best is None or total > best:
            records.append((i, total))
            best = total
    found = rows_of(ordered.running_record(totals, bits), "id", "total", "is_current")
    assert [(i, t) for i, t, _ in found] == records
    assert [i for i, _, current in found if current] == [records[-1][0]]

    steps = ordered.staircase(make_ledger(entries), bits=bits)
    assert set(rows_of(steps, "id", "total")) <= set(wanted)
    assert rows_of(ordered.running_record(steps, bits), "id", "total", "is_current") == found


def test_first_entry_is_a_record_even_below_zero(make_ledger):
    ledger = make_ledger([(1, "2024-01-01", 1, "a", -5), (2, "2024-01-02", 2, "a", -7), (3, "2024-01-03", 2, "a", 5)])
    records = ordered.running_record(ordered.running_total(ledger), bits=1)
    assert rows_of(records, "id", "is_current") == [(1, False), (3, True)]


def test_no_chunk_of_a_hot_player_is_over_its_bound(make_ledger, entries):
    chunks = ordered.with_chunks(make_ledger(entries), bits=4).groupBy("player_id", "_chunk").count()
    assert chunks.agg(F.max("count")).first()[0] <= 2**4


@pytest.mark.parametrize("buckets, sample, bits", [(256, 1024, 20), (8, 1, 3), (4, 2, 5)])
def test_ranked_with_a_hot_group_and_many_ties(spark, buckets, sample, bits):
    dice = random.Random(3)
    rows = [(i, "big" if dice.random() < 0.7 else f"t{i % 5}", dice.choice([0, 0, 0, dice.randint(-50, 50)]))
            for i in range(1500)]
    frame = spark.createDataFrame(rows, "player_id bigint, team string, score bigint")
    ranks = ordered.ranked(frame, "score", "player_id", ["team"], buckets=buckets, sample=sample, bits=bits)
    wanted = []
    for team in {t for _, t, _ in rows}:
        members = sorted((-s, i) for i, t, s in rows if t == team)
        wanted += [(i, place) for place, (_, i) in enumerate(members, 1)]
    assert rows_of(ranks, "player_id", "rank") == sorted(wanted)


def test_top_per_group_limits_before_the_shuffle(make_ledger, entries):
    top = ordered.top_per_group(make_ledger(entries), ["player_id"], [F.desc("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    assert top.groupBy("player_id").count().where("count > 2").count() == 0
