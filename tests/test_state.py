import datetime as dt
import random

import pytest

from pointline.operators import curves, records, rollups, snapshots, state

from .conftest import rows_of

AS_OF = dt.datetime(2024, 1, 20, 12)


def test_zero_and_last_row_break_streaks(make_ledger):
    ledger = make_ledger([
        (1, "2024-01-01", 1, "a", 2), (2, "2024-01-01", 1, "a", 0), (3, "2024-01-02", 1, "a", 2),
        (4, "2024-01-02", 1, "a", 3), (5, "2024-01-03", 2, "a", 1), (6, "2024-01-03", 2, "a", 1),
        (7, "2024-01-04", 2, "a", -1)])
    assert rows_of(state.streaks(ledger)) == [(1, 2, 2), (2, 0, 2)]


def test_system_rows_count_for_the_total_only(make_ledger):
    ledger = make_ledger([
        (1, "2024-01-01", 1, "a", -5), (2, "2024-01-01", 1, "bonus", -20, "system"), (3, "2024-01-02", 1, "a", 22),
        (4, "2024-01-02", 1, "fix", 0, "system"), (5, "2024-01-02", 1, "a", 1)])
    assert rows_of(state.streaks(ledger)) == [(1, 2, 2)]
    assert rows_of(state.lowest_score(ledger)) == [(1, -5)]
    assert rows_of(rollups.period_stats(ledger, ("month",)), "total_points", "actions_count") == [(18, 3)]
    assert rows_of(rollups.player_scores(ledger)) == [(1, -2)]


def test_lowest_score_starts_at_zero(make_ledger):
    assert rows_of(state.lowest_score(make_ledger([(1, "2024-01-01", 1, "a", 9)]))) == [(1, 0)]


def test_week_edge(make_ledger):
    ledger = make_ledger([(1, "2024-01-07 23:59:59", 1, "a", 1), (2, "2024-01-08 00:00:00", 1, "a", 2)])
    stats = rollups.period_stats(ledger, ("week",))
    assert rows_of(stats, "period_start", "total_points") == [(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 8), 2)]


def test_week_roll_up_sums_to_the_ledger(make_ledger):
    dice = random.Random(1)
    ledger = make_ledger([(i, f"2024-0{1 + i // 100}-{1 + i % 28:02d}", dice.randint(1, 9), "a", dice.randint(-9, 9))
                          for i in range(500)])
    for period in ("week", "month", "term"):
        total = rollups.period_stats(ledger, (period,)).agg({"total_points": "sum"}).first()[0]
        assert total == ledger.agg({"points": "sum"}).first()[0]


def test_consecutive_days_need_no_recency_but_no_gap(make_ledger):
    run = [(i, f"2024-01-{i:02d}", 1, "a", 1) for i in range(1, 6)]
    gap = [(10 + i, f"2024-01-{d:02d}", 2, "a", 1) for i, d in enumerate((1, 2, 4, 5, 6))]
    stale = [(20 + i, f"2024-01-{d:02d}", 3, "a", 1) for i, d in enumerate((1, 2, 3, 4, 5, 9))]
    loss = [(30 + i, f"2024-01-{i + 1:02d}", 4, "a", -1 if i == 2 else 1) for i in range(5)]
    days = state.consecutive_days(rollups.player_days(make_ledger(run + gap + stale + loss)))
    assert rows_of(days, "player_id", "in_a_row") == [(1, True), (2, False), (3, False), (4, False)]
    assert {r["player_id"]: len(r["days"]) for r in days.collect()} == {1: 5, 2: 5, 3: 6, 4: 4}


def test_only_seven_days_are_kept(make_ledger):
    ledger = make_ledger([(i, f"2024-01-{i:02d}", 1, "a", 1) for i in range(1, 12)])
    assert state.consecutive_days(rollups.player_days(ledger)).first()["days"] == [
        dt.date(2024, 1, d) for d in range(5, 12)]


def test_first_time_within_needs_strictly_less(make_ledger):
    times = state.keyword_times(make_ledger([
        (1, "2024-01-01 10:00:00", 1, "Hard", 1), (2, "2024-01-15 10:00:00", 1, "Hard", 1),
        (3, "2024-01-15 11:00:00", 1, "Hard", 1), (4, "2024-01-01 10:00:00", 2, "Hard", 1),
        (5, "2024-01-15 09:59:59", 2, "Hard", 1), (6, "2024-01-15 10:00:00", 3, "Hard", 1)]), ["Hard"])
    assert rows_of(state.first_time_within(times, 2, 14)) == [
        (1, dt.datetime(2024, 1, 15, 11)), (2, dt.datetime(2024, 1, 15, 9, 59, 59))]


def test_first_time_within_against_brute_force(make_ledger):
    dice = random.Random(5)
    moments = sorted(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=dice.randint(0, 60 * 24 * 25)) for _ in range(200))
    rows = [(i, str(t), dice.randint(1, 30), "Hard", 1) for i, t in enumerate(moments)]
    for k, days in ((2, 1), (3, 2), (4, 3)):
        wanted = {}
        for _, _, player, _, _ in rows:
            mine = [dt.datetime.fromisoformat(t) for _, t, p, _, _ in rows if p == player]
            hits = [b for a, b in zip(mine, mine[k - 1:]) if a > b - dt.timedelta(days=days)]
            if hits:
                wanted[player] = hits[0]
        found = state.first_time_within(state.keyword_times(make_ledger(rows), ["Hard"]), k, days)
        assert rows_of(found) == sorted(wanted.items())


def test_trailing_count_is_strict_at_the_start(make_ledger):
    ledger = make_ledger([(1, "2024-01-06 12:00:00", 1, "Hard", 1), (2, "2024-01-07", 1, "Hard", 1),
                          (3, "2024-01-07", 2, "Hard", 1), (4, "2024-01-08", 2, "Hard", 1)])
    assert rows_of(state.trailing_count(ledger, ["Hard"], AS_OF)) == [(2, 2)]


def test_counters_respect_case(make_ledger):
    ledger = make_ledger([(1, "2024-01-01", 1, "Félicitations!", 1), (2, "2024-01-01", 1, "félicitations", 1),
                          (3, "2024-01-02", 1, "Hardworker", 1)])
    assert rows_of(state.keyword_counters(ledger), "praise_count", "hard_count") == [(1, 1)]
    assert rows_of(state.keyword_counters(ledger, case_sensitive=False), "praise_count") == [(2,)]


def test_milestones_and_ties(make_ledger):
    from pointline.operators.ordered import running_total

    totals = running_total(make_ledger([
        (1, "2024-01-01", 1, "a", 49), (2, "2024-01-01", 2, "a", 120), (3, "2024-01-01", 1, "a", 1),
        (4, "2024-01-02", 2, "a", -100), (5, "2024-01-03", 2, "a", 100)]))
    assert rows_of(records.first_to_milestone(totals), "milestone", "player_id") == [(50, 2), (100, 2)]


def test_leaders_need_points_and_a_valid_request(make_ledger, make_players):
    ledger = make_ledger([(1, "2024-01-01", 1, "sport", 5), (2, "2024-01-01", 2, "sport", 5),
                          (3, "2024-01-01", 3, "school", -5), (4, "2024-01-01", 9, "sport", 50)])
    players = make_players([(1, "a", "T"), (2, "b", "T"), (3, "c", "U")])
    leaders = records.period_leaders(rollups.period_stats(ledger, ("week",)), players, rollups.player_scores(ledger))
    assert rows_of(leaders, "mvp_type", "player_id") == [("progression", 1), ("sport", 1)]
    import pytest
    for bad in (dict(limit=0), dict(limit=1001), dict(period="year")):
        with pytest.raises(ValueError):
            records.leader_history(leaders, **bad)
    assert records.leader_history(leaders, "week", "sport", 5).count() == 1


def test_curve_fills_idle_days(make_ledger):
    ledger = make_ledger([
        (1, "2024-01-01", 1, "a", 10), (2, "2024-01-17 08:00:00", 1, "a", 5), (3, "2024-01-17 09:00:00", 1, "a", -8),
        (4, "2024-01-19", 1, "a", 1), (5, "2024-01-02", 2, "a", 3)])
    curve = rows_of(curves.progress_curve(ledger, AS_OF, 5), "day", "daily_points", "max_total", "cumulative", "actions_count")
    day = lambda d: dt.date(2024, 1, d)
    assert curve == [
        (day(15), 0, 10, 10, 0), (day(16), 0, 10, 10, 0), (day(17), -3, 15, 7, 2), (day(18), 0, 7, 7, 0),
        (day(19), 1, 8, 8, 1), (day(20), 0, 8, 8, 0)]
    assert rows_of(curves.progress_summary(ledger, AS_OF, 5)) == [(1, 10, -2, 3, 2)]
    assert rows_of(curves.progress_curve(ledger, AS_OF, None), "player_id", "cumulative") == [
        (1, 7), (1, 8), (1, 10), (2, 3)]


def test_curve_range_is_checked(make_ledger):
    import pytest
    with pytest.raises(ValueError):
        curves.progress_curve(make_ledger([(1, "2024-01-01", 1, "a", 1)]), AS_OF, 400)


def test_empty_ledger(make_ledger, make_players):
    empty = make_ledger([(1, "2024-01-01", 1, "a", 1)]).where("id < 0")
    players = make_players([(1, "a", "T")])
    assert curves.progress_curve(empty, AS_OF, 5).count() == 0
    assert state.streaks(empty).count() == 0
    assert records.hall_of_fame(empty, players).count() == 0
    assert rows_of(rollups.scoreboard(players, empty), "player_id", "score") == [(1, 0)]


# lasting states ------------------------------------------------------------------------------------------------------

FIRST, LAST = dt.date(2023, 12, 25), dt.date(2024, 2, 10)


def season(seed, n_players=14, n=260):
    dice = random.Random(seed)
    days = sorted(dice.randint(0, (LAST - FIRST).days) for _ in range(n))
    rows = [(i, str(FIRST + dt.timedelta(days=d)), dice.randint(1, n_players - 1), "a", dice.choice([-20, -5, 1, 4, 15, 30]))
            for i, d in enumerate(days)]
    players = [(p, f"p{p}", "ABC"[p % 3]) for p in range(1, n_players + 1)]
    return rows, players


def daily_scores(rows, players):
    """Closing score of every player on every day."""
    result, score = {}, {p: 0 for p, _, _ in players}
    day = FIRST
    while day <= LAST:
        for _, t, p, _, points in rows:
            if t == str(day):
                score[p] += points
        result[day] = dict(score)
        day += dt.timedelta(days=1)
    return result


def test_daily_best_against_brute_force(make_ledger, make_players):
    for seed in (1, 2):
        rows, players = season(seed)
        team = {p: t for p, _, t in players}
        intervals = snapshots.score_intervals(
            rollups.player_days(make_ledger(rows)), make_players(players), FIRST, LAST)
        scores = daily_scores(rows, players)
        for groups, k, worst in (((), 10, False), (("team",), 3, False), (("team",), 2, True), ((), 1, True)):
            wanted = []
            for day, by_player in scores.items():
                for group in (set(team.values()) if groups else {None}):
                    members = sorted((-s, p) for p, s in by_player.items() if group is None or team[p] == group)
                    chosen = members[::-1][:k] if worst else members[:k]
                    wanted += [(day, p, -s, place) for place, (s, p) in enumerate(chosen, 1)]
            found = snapshots.daily_best(intervals, k, groups, worst)
            assert rows_of(found, "day", "player_id", "score", "position") == sorted(wanted)


def test_daily_best_expands_no_players(spark, make_players):
    """2000 players over 64 days who all start at 0: under a twentieth of players x days is expanded, and the ranks are exact."""
    from pyspark.sql import functions as F

    n, first, last = 2000, dt.date(2024, 1, 1), dt.date(2024, 3, 4)
    players = make_players([(p, str(p), "AB"[p % 2]) for p in range(n)])
    days = spark.range(n * 12).select((F.col("id") % n).alias("player_id"), F.date_add(F.lit(first), F.pmod(F.hash("id"), F.lit(64))).alias("day"),
                                      (F.pmod(F.xxhash64("id"), F.lit(60)) - 15).alias("points")).groupBy("player_id", "day").agg(F.sum("points").alias("points"))
    intervals = snapshots.score_intervals(days, players, first, last).cache()
    signed = intervals.select("*", F.col("score").alias("_score"), F.col("player_id").alias("_id"))
    spans = snapshots.best_spans(signed, 10, (), [F.desc("_score"), F.col("_id")])
    assert spans.agg(F.sum(F.expr("shiftleft(1, _level)"))).first()[0] < 0.05 * n * 64
    every = snapshots.each_day(intervals)
    whole = snapshots.top_per_group(every, ["day"], [F.desc("score"), F.col("player_id")], 10)
    columns = ("day", "player_id", "score", "position")
    assert rows_of(snapshots.daily_best(intervals, 10), *columns) == rows_of(whole, *columns)
    cut = snapshots.dyadic_spans(intervals)
    assert cut.agg(F.sum(F.expr("shiftleft(1, _level)"))).first()[0] == n * 64  # every day of every player in one span


def test_team_days_all_against_brute_force(make_ledger, make_players):
    rows, players = season(3)
    team = {p: t for p, _, t in players}
    intervals = snapshots.score_intervals(rollups.player_days(make_ledger(rows)), make_players(players), FIRST, LAST)
    for low in (-30, 0, 10):
        wanted = [(t, day) for day, scores in daily_scores(rows, players).items() for t in set(team.values())
                  if all(s >= low for p, s in scores.items() if team[p] == t)]
        from pyspark.sql import functions as F
        found = snapshots.team_days_all(intervals, make_players(players), F.col("score") >= low, FIRST, LAST)
        assert rows_of(found, "team", "day") == sorted(wanted)


def test_sustained_restarts_after_a_break(spark):
    good = [("A", f"2024-01-{d:02d}") for d in (1, 2, 3, 5, 6, 7, 8)] + [("B", f"2024-01-{d:02d}") for d in range(1, 4)]
    days = spark.createDataFrame(good, "team string, d string").selectExpr("team", "CAST(d AS date) AS day")
    assert rows_of(snapshots.sustained(days, "team", extra_days=3), "team", "from_day", "held_on") == [
        ("A", dt.date(2024, 1, 5), dt.date(2024, 1, 8))]


def test_sustained_months_overflow(spark):
    days = spark.sql("SELECT 'A' AS team, explode(sequence(DATE '2024-01-31', DATE '2024-03-02')) AS day")
    assert rows_of(snapshots.sustained(days, "team", months=1), "held_on") == [(dt.date(2024, 3, 2),)]
    assert snapshots.sustained(days.where("day < DATE '2024-03-02'"), "team", months=1).count() == 0


def test_turnaround_in_a_team_of_three_and_none_in_two(make_ledger, make_players):
    players = make_players([(1, "a", "T"), (2, "b", "T"), (3, "c", "T"), (4, "d", "U"), (5, "e", "U")])
    ledger = make_ledger([(1, "2024-01-01", 1, "a", 10), (2, "2024-01-02", 2, "a", 5), (3, "2024-01-02", 5, "a", 5)])
    intervals = snapshots.score_intervals(
        rollups.player_days(ledger), players, dt.date(2024, 1, 1), dt.date(2024, 1, 3))
    # with three members the second is both in the bottom two and in the top three
    assert rows_of(snapshots.rank_turnaround(intervals, players), "player_id", "top_day") == [
        (2, dt.date(2024, 1, 2)), (3, dt.date(2024, 1, 2))]


def test_hours_at_top(make_ledger, make_players):
    players = make_players([(1, "a", "T"), (2, "b", "U")])
    ledger = make_ledger([(1, "2024-01-01 00:10:00", 2, "a", 5), (2, "2024-01-01 02:00:00", 1, "a", 9),
                          (3, "2024-01-01 04:30:00", 2, "a", 90)])
    hours = snapshots.hours_at_top(
        snapshots.team_hours(ledger, players), players, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 4, 45))
    assert rows_of(hours) == [("T", 2), ("U", 2)]


def test_team_joins_carry_no_hint(spark, make_ledger, make_players):
    rows, players = season(4)
    ledger, people = make_ledger(rows), make_players(players)
    intervals = snapshots.score_intervals(rollups.player_days(ledger), people, FIRST, LAST)
    found = snapshots.rank_turnaround(intervals, people)
    assert "ResolvedHint" not in found._jdf.queryExecution().analyzed().toString()
    small = rows_of(found)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert small and rows_of(snapshots.rank_turnaround(intervals, people)) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hours_at_top_open_with_what_came_before(make_ledger, make_players):
    ledger = make_ledger([(1, "2024-01-01 10:00:00", 1, "x", 100), (2, "2024-01-02 05:00:00", 2, "x", 5)])
    players = make_players([(1, "a", "A"), (2, "b", "B")])
    hours = snapshots.hours_at_top(snapshots.team_hours(ledger, players), players, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3))
    assert rows_of(hours, "team", "hours") == [("A", 24), ("B", 0)]


def test_cooldown_needs_a_month(make_ledger):
    from pointline.operators import corrections

    with pytest.raises(ValueError):
        corrections.accepted_changes(make_ledger([]), months=0)
