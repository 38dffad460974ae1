import datetime as dt

from pointline.operators import awards, rollups, snapshots, state

from .conftest import rows_of

AS_OF = dt.datetime(2024, 1, 20, 12)


def entries(make_ledger, *rows):
    return make_ledger([(i, *r) for i, r in enumerate(rows, 1)])


def test_streaks_are_earned_once_at_their_entry(make_ledger):
    ledger = entries(make_ledger, *[(f"2024-01-01 {h:02d}:00:00", 1, "a", 1) for h in range(1, 13)],
                     ("2024-01-02", 1, "a", -1), *[(f"2024-01-03 {h:02d}:00:00", 1, "a", 1) for h in range(1, 7)])
    earned = awards.grant(awards.entry_awards(awards.entry_summary(ledger, ["x"])))
    assert rows_of(earned, "badge_id", "points", "date_earned") == [
        ("hot_streak", 5, dt.datetime(2024, 1, 1, 5)), ("tsunami", 10, dt.datetime(2024, 1, 1, 10))]


def test_phoenix_needs_the_fall_first(make_ledger):
    ledger = entries(make_ledger, ("2024-01-01", 1, "a", 60), ("2024-01-02", 1, "a", -110), ("2024-01-03", 1, "a", 100),
                     ("2024-01-01", 2, "a", 60), ("2024-01-02", 2, "a", -109))
    earned = awards.entry_awards(awards.entry_summary(ledger, ["x"]), ("phoenix",))
    assert rows_of(earned, "player_id", "date_earned") == [(1, dt.datetime(2024, 1, 3))]


def test_marathon_is_earned_on_the_fifth_day(make_ledger):
    ledger = entries(make_ledger, *[(f"2024-01-{d:02d} 09:00:00", 1, "a", 1) for d in (1, 3, 4, 5, 6, 7, 8)])
    earned = awards.marathon(rollups.player_days(ledger))
    assert rows_of(earned, "date_earned") == [(dt.datetime(2024, 1, 7, 9),)]


def test_courage_and_clockwork(make_ledger):
    late = dt.datetime(2024, 6, 15, 12)
    ledger = entries(
        make_ledger, *[(f"2024-05-{d:02d}", 1, "Arbitrage", 1) for d in range(1, 6)],
        *[(f"2024-02-{d:02d}", 2, "Table de marque", 1) for d in range(1, 6)],
        ("2024-03-15 12:00:00", 3, "Retard", -1), ("2024-01-01", 3, "a", 1),
        ("2024-03-15 11:59:59", 4, "Retard", -1), ("2024-03-16", 5, "a", 1))
    assert rows_of(awards.courage(ledger, late), "player_id") == [(1,)]
    # 3 was late within three months, 1 and 5 have no three months behind them
    assert rows_of(awards.clockwork(ledger, late), "player_id") == [(2,), (4,)]


def test_christmas_only_in_season(make_ledger):
    ledger = entries(make_ledger, ("2023-12-12", 1, "a", 1), ("2023-12-11 23:59:59", 2, "a", 1), ("2023-12-20", 3, "a", 0))
    assert rows_of(awards.christmas(ledger, dt.datetime(2023, 12, 22, 8)), "player_id") == [(1,)]
    for out in (dt.datetime(2023, 12, 19, 23), dt.datetime(2024, 1, 1)):
        assert awards.christmas(ledger, out).count() == 0


def test_team_points_restart_each_period(make_ledger, make_players, spark):
    players = make_players([(1, "a", "T"), (2, "b", "T"), (3, "c", "U")])
    ledger = entries(make_ledger, ("2024-01-05", 1, "a", 50), ("2024-01-08", 2, "a", 60), ("2024-01-09", 1, "a", -90),
                     ("2024-01-10", 1, "a", 25), ("2024-01-10", 3, "a", 70))
    direct = spark.sql("SELECT 1L AS id, TIMESTAMP_NTZ '2024-01-11' AS ts, 'U' AS team, 9L AS points")
    daily = rollups.team_day_points(rollups.player_days(ledger), players, direct)
    assert rows_of(awards.rocket_launch(daily), "team", "date_earned") == [("T", dt.datetime(2024, 1, 10))]
    assert rows_of(awards.rocket_launch(daily, 79), "team") == [("T",), ("U",)]
    assert awards.tidal_wave(daily).count() == 0


def test_everyone_on_one_day(make_ledger, make_players):
    players = make_players([(1, "a", "T"), (2, "b", "T"), (3, "c", "U"), (4, "d", "U")])
    days = rollups.player_days(entries(
        make_ledger, ("2024-01-01", 1, "a", 1), ("2024-01-02", 1, "a", 1), ("2024-01-02", 2, "a", 1),
        ("2024-01-02", 3, "a", 1), ("2024-01-03", 4, "a", 1)))
    assert rows_of(awards.lightning_strike(days, players), "team", "date_earned") == [("T", dt.datetime(2024, 1, 2))]
    assert rows_of(awards.house_on_fire(days, players), "team", "date_earned") == [
        ("T", dt.datetime(2024, 1, 2)), ("U", dt.datetime(2024, 1, 3))]


def test_solidarity(make_ledger, make_players):
    players = make_players([(1, "a", "T"), (2, "b", "T"), (3, "c", "U"), (4, "d", "U"), (5, "e", "V")])
    ledger = entries(make_ledger, ("2024-01-01", 1, "a", -5), ("2024-01-02", 1, "a", 35), ("2024-01-02", 2, "a", 75),
                     ("2024-01-10", 3, "a", -5), ("2024-01-11", 3, "a", 35), ("2024-01-11", 4, "a", 76),
                     ("2024-01-11", 5, "a", -1))
    scores = rollups.scoreboard(players, ledger)
    last = state.team_last_negative(state.last_negative(ledger), players)
    assert rows_of(last) == [("T", dt.datetime(2024, 1, 1)), ("U", dt.datetime(2024, 1, 10)), ("V", dt.datetime(2024, 1, 11))]
    assert rows_of(awards.united(scores, last, AS_OF), "team") == [("T",)]
    assert rows_of(awards.perfect_balance(scores, AS_OF), "team") == [("T",)]
    december = dt.datetime(2023, 12, 1)
    assert rows_of(awards.harmony(scores, december), "team") == [("T",), ("U",), ("V",)]
    assert rows_of(awards.harmony(scores, december, gap=46), "team") == [("T",), ("V",)]
    assert awards.harmony(scores, AS_OF).count() == 0


def test_mutual_support_share(make_ledger, make_players):
    players = make_players([(p, str(p), "T") for p in range(1, 6)] + [(p, str(p), "U") for p in range(6, 11)])
    rows = [("2024-01-15", p, "Atelier", 1) for p in (1, 2, 3, 4, 6, 7, 8)] + [("2024-01-06 11:59:59", 9, "Conseil", 1)]
    assert rows_of(awards.mutual_support(entries(make_ledger, *rows), players, AS_OF), "team") == [("T",)]


def test_weak_link_and_triple_threat(make_ledger, make_players):
    players = make_players([(p, str(p), "T" if p <= 3 else "U") for p in range(1, 6)])
    first = dt.date(2024, 1, 1)
    ledger = entries(make_ledger, *[(f"2024-01-0{p}", p, "a", 30) for p in (1, 2, 3)], ("2024-01-02", 4, "a", 30),
                     ("2024-01-15", 3, "a", -10), ("2024-01-16", 3, "a", 5))
    intervals = snapshots.score_intervals(rollups.player_days(ledger), players, first, AS_OF.date())
    earned = awards.no_weak_link(intervals, players, first, AS_OF, months=0, days=10)
    assert rows_of(earned, "team", "date_earned") == [("T", dt.datetime(2024, 1, 13))]
    assert awards.no_weak_link(intervals, players, first, AS_OF, months=0, days=12).count() == 0
    assert awards.no_weak_link(intervals, players, first, AS_OF).count() == 0
    best = awards.triple_threat(intervals, k=3, months=0, days=5)
    # on the 1st all idle players tie at 0 and the lower ids lead, so the three of T are on top until U's player scores
    assert rows_of(best, "team", "date_earned") == [("T", dt.datetime(2024, 1, 8))]


def test_collector_needs_both_kinds(spark, make_players):
    players = make_players([(1, "a", "T"), (2, "b", "T"), (3, "c", "U")])
    own = spark.createDataFrame([(p, f"b{i}") for p in (1, 3) for i in range(2)], "player_id bigint, badge_id string")
    ours = spark.createDataFrame([("T", "x"), ("T", "y"), ("U", "x")], "team string, badge_id string")
    assert rows_of(awards.collector(own, ours, players, AS_OF, 2, 2), "player_id") == [(1,)]


def test_award_once_and_bonus(make_ledger):
    ledger = entries(make_ledger, *[("2024-01-01", 1, "a", 1)] * 10, *[("2024-01-02", 2, "a", 1)] * 5)
    found = awards.grant(awards.entry_awards(awards.entry_summary(ledger, ["x"])))
    held = found.where("player_id = 1 AND badge_id = 'hot_streak'")
    new = awards.award_once(found.unionByName(found), held)
    assert rows_of(new, "player_id", "badge_id") == [(1, "tsunami"), (2, "hot_streak")]
    assert awards.award_once(found, found).count() == 0
    bonus = awards.bonus_rows(found)
    assert rows_of(bonus, "player_id", "points", "bonus_so_far", "kind") == [
        (1, 5, 5, "system"), (1, 10, 15, "system"), (2, 5, 5, "system")]


def test_recompute_gives_no_points(make_ledger):
    ledger = entries(make_ledger, *[("2024-01-01", 1, "a", 1)] * 6, ("2024-01-02", 2, "a", 1))
    due = awards.recompute(state.player_state(ledger, AS_OF), AS_OF)
    assert rows_of(due, "player_id", "badge_id", "points") == [(1, "hot_streak", 0)]
