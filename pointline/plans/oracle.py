"""The same results in plain SQL, for comparison with another engine.

Written straight from the definitions, with ordinary windows over whole players and teams: right, but not made to scale.
"""

from __future__ import annotations

import re

from ..functions import text
from ..operators.awards import RULES
from ..sources import tables
from . import settings as S


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(column: str, keywords) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {_literal(k.lower())})" for k in keywords) + ")"


def _classify(column: str, rules) -> str:
    cases = " ".join(f"WHEN {_any(column, words)} THEN {_literal(name)}" for name, words in rules)
    return f"CASE {cases} ELSE 'unknown' END"


def _in(values) -> str:
    return "(" + ", ".join(_literal(v) for v in values) + ")"


_TERM = {
    "start": "make_date(year(ts), CASE WHEN month(ts) >= 9 THEN 9 WHEN month(ts) <= 3 THEN 1 ELSE 4 END, 1)",
    "end": "CASE WHEN month(ts) >= 9 THEN make_date(year(ts), 12, 31) WHEN month(ts) <= 3 "
           "THEN make_date(year(ts), 3, 31) ELSE make_date(year(ts), 6, 30) END",
}
_POINTS = "(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) * CAST(floor(value) AS BIGINT)"
_AS_OF = f"TIMESTAMP '{S.AS_OF}'"
_TODAY = f"DATE '{S.AS_OF.date()}'"
_FIRST = f"DATE '{S.FIRST_DAY}'"
_ORDERS_AS_OF = f"TIMESTAMP '{S.ORDERS_AS_OF}'"
_THREE_MONTHS_AGO = "TIMESTAMP '2000-12-15 12:00:00'"
_WEEK = "ts >= DATE '2024-01-22' AND ts < DATE '2024-01-29'"
_PRAISE, _HARD = f"action = {_literal(S.PRAISE[0])}", f"action = {_literal(S.HARD[0])}"


def _shift(ts: str, months: int) -> str:
    """Month shift that carries surplus days over."""
    return (f"(CAST(date_trunc('month', {ts}) AS DATE) + INTERVAL ({months}) MONTH + INTERVAL (day({ts}) - 1) DAY "
            f"+ ({ts} - date_trunc('day', {ts})))")


def _pct(part: str, whole: str) -> str:
    return f"round(CASE WHEN {whole} = 0 THEN 0 ELSE {part} * 100.0 / {whole} END, 1)"


# Named parts, each of which may use those above it.
PARTS = {
    "t_ledger": f"""SELECT event_id AS id, ts, user_id AS player_id, event_type AS action,
        {_classify('event_type', tables.EVENT_RULES)} AS category, {_POINTS} AS points,
        '{text.DEFAULT_ACTOR}' AS actor, 'action' AS kind FROM events""",
    "t_recent": f"SELECT * FROM t_ledger WHERE ts <= {_AS_OF}",
    "t_orders": f"""SELECT o_orderkey AS id, o_orderdate AS ts, o_custkey AS player_id, o_orderpriority AS action,
        {_classify('o_orderpriority', tables.ORDER_RULES)} AS category,
        (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) * CAST(floor(o_totalprice / 10000) AS BIGINT) AS points
        FROM orders""",
    "t_players": "SELECT c_custkey AS player_id, c_name AS name, c_mktsegment AS team FROM customer",
    "t_active": "SELECT * FROM t_players WHERE player_id IN (SELECT user_id FROM events)",
    "t_direct": f"""SELECT event_id AS id, ts, team, CASE WHEN {_POINTS} > 10 THEN event_type END AS action,
        {_POINTS} AS points, '{text.DEFAULT_ACTOR}' AS actor
        FROM events JOIN t_players ON user_id = player_id WHERE event_type = 'signup'""",
    "t_accepted": f"""SELECT id, ts, team, points, actor, coalesce(action, 'Points franchise (' ||
        CASE WHEN points > 0 THEN '+' ELSE '' END || points || ')') AS action
        FROM t_direct WHERE team IN {_in(S.OPEN_TEAMS)}""",
    "t_requests": """SELECT event_id AS id, ts, user_id AS player_id, CASE WHEN floor(value) < 2 THEN 'POOL'
        WHEN floor(value) < 4 THEN 'AUTOMOBILE' WHEN floor(value) < 8 THEN 'BUILDING' WHEN floor(value) < 14 THEN 'FURNITURE'
        WHEN floor(value) < 22 THEN 'HOUSEHOLD' WHEN floor(value) < 40 THEN 'MACHINERY' ELSE 'NOWHERE' END AS target
        FROM events WHERE event_type = 'view'""",
    "t_scores": """SELECT p.*, coalesce(s.score, 0) AS score FROM t_players p
        LEFT JOIN (SELECT player_id, sum(points) AS score FROM t_ledger GROUP BY 1) s USING (player_id)""",
    "t_recent_scores": """SELECT p.*, coalesce(s.score, 0) AS score FROM t_players p
        LEFT JOIN (SELECT player_id, sum(points) AS score FROM t_recent GROUP BY 1) s USING (player_id)""",
    "t_active_scores": "SELECT * FROM t_recent_scores WHERE player_id IN (SELECT player_id FROM t_active)",
    "t_run0": """SELECT *, sum(points) OVER w AS total, count(*) FILTER (points <= 0) OVER w AS resets
        FROM t_ledger WINDOW w AS (PARTITION BY player_id ORDER BY id ROWS UNBOUNDED PRECEDING)""",
    "t_run": f"""SELECT *, least(0, min(total) OVER w) AS lowest, count(*) FILTER ({_PRAISE}) OVER w AS praise,
        count(*) FILTER (points > 0) OVER (PARTITION BY player_id, resets ORDER BY id ROWS UNBOUNDED PRECEDING) AS streak
        FROM t_run0 WINDOW w AS (PARTITION BY player_id ORDER BY id ROWS UNBOUNDED PRECEDING)""",
    "t_run_recent": f"SELECT * FROM t_run WHERE ts <= {_AS_OF}",
    "t_state": """SELECT player_id, max_by(streak, id) AS current_streak, max(streak) AS max_streak,
        min(lowest) AS lowest_score FROM t_run GROUP BY 1""",
    "t_state_recent": """SELECT player_id, max_by(streak, id) AS current_streak, max(streak) AS max_streak,
        min(lowest) AS lowest_score FROM t_run_recent GROUP BY 1""",
    "t_days": """SELECT player_id, CAST(ts AS DATE) AS day, min(ts) AS first_ts FROM t_ledger
        WHERE points > 0 GROUP BY 1, 2""",
    "t_days_recent": f"""SELECT player_id, CAST(ts AS DATE) AS day, min(ts) AS first_ts FROM t_recent
        WHERE points > 0 GROUP BY 1, 2""",
    "t_last_days": """SELECT player_id, list(day ORDER BY day) AS days, max(day) AS last_day FROM (
        SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY day DESC) AS n FROM t_days_recent)
        WHERE n <= 7 GROUP BY 1""",
    "t_run_of_days": """SELECT player_id, coalesce(bool_or(n = 1 AND day - earlier = 4), false) AS in_a_row FROM (
        SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY day DESC) AS n,
        lag(day, 4) OVER (PARTITION BY player_id ORDER BY day) AS earlier FROM t_days_recent) GROUP BY 1""",
    "t_rules": "SELECT * FROM (VALUES " + ", ".join(
        f"({_literal(r.badge_id)}, '{r.scope}', {_literal(r.badge_name)}, {r.points}, '{r.rarity}')" for r in RULES
    ) + ") AS r(badge_id, scope, badge_name, points, rarity)",
    "t_first": f"""SELECT player_id, 'hot_streak' AS badge_id, ts AS date_earned FROM t_run WHERE streak >= 5
        UNION ALL SELECT player_id, 'tsunami', ts FROM t_run WHERE streak >= 10
        UNION ALL SELECT player_id, 'unstoppable', ts FROM t_run WHERE streak >= 15
        UNION ALL SELECT player_id, 'phoenix', ts FROM t_run WHERE lowest <= -50 AND total >= 50
        UNION ALL SELECT player_id, 'showtime', ts FROM t_run WHERE praise >= 3
        UNION ALL SELECT player_id, 'on_fire', ts FROM (
            SELECT player_id, ts, lag(ts) OVER (PARTITION BY player_id ORDER BY id) AS p FROM t_ledger WHERE {_HARD})
            WHERE p > ts - INTERVAL 14 DAY
        UNION ALL SELECT player_id, 'marathon_runner', first_ts FROM (
            SELECT *, lag(day, 4) OVER (PARTITION BY player_id ORDER BY day) AS p FROM t_days) WHERE day - p = 4""",
    "t_all_badges": """SELECT player_id, badge_id, badge_name, points, rarity, min(date_earned) AS date_earned
        FROM t_first JOIN t_rules USING (badge_id) GROUP BY ALL""",
    "t_badges": f"SELECT * FROM t_all_badges WHERE date_earned <= {_AS_OF}",
    "t_order_stats": f"""SELECT player_id, period_type, period_start, period_end,
        sum(CASE WHEN category = 'sport' THEN points ELSE 0 END) AS sport_points,
        sum(CASE WHEN category = 'academic' THEN points ELSE 0 END) AS academic_points,
        sum(points) AS total_points, count(*) AS actions_count FROM (
        SELECT *, 'week' AS period_type, CAST(date_trunc('week', ts) AS DATE) AS period_start,
            CAST(date_trunc('week', ts) AS DATE) + 6 AS period_end FROM t_orders
        UNION ALL SELECT *, 'month', CAST(date_trunc('month', ts) AS DATE), last_day(ts) FROM t_orders
        UNION ALL SELECT *, 'term', {_TERM['start']}, {_TERM['end']} FROM t_orders) GROUP BY ALL""",
    "t_order_scores": "SELECT player_id, sum(points) AS total_score FROM t_orders GROUP BY 1",
    "t_leaders": """SELECT *, row_number() OVER (PARTITION BY period_type, period_start, mvp_type
            ORDER BY points_earned DESC, player_id) AS position FROM (
        SELECT player_id, period_type, period_start, period_end, mvp_type, points_earned FROM t_order_stats,
            LATERAL (VALUES ('academic', academic_points), ('sport', sport_points), ('progression', total_points))
            AS m(mvp_type, points_earned) WHERE points_earned > 0)
        JOIN t_players USING (player_id) JOIN t_order_scores USING (player_id)""",
    "t_mvp": """SELECT period_type, period_start, period_end, mvp_type, position, player_id, team, points_earned,
        total_score FROM t_leaders WHERE position = 1""",
    "t_breakdown": f"""SELECT *, {_pct('total_sport', '(total_sport + total_academic)')} AS sport_percentage,
        {_pct('total_academic', '(total_sport + total_academic)')} AS academic_percentage FROM (
        SELECT team, sum(CASE WHEN category = 'sport' THEN points ELSE 0 END) AS total_sport,
            sum(CASE WHEN category = 'academic' THEN points ELSE 0 END) AS total_academic,
            sum(points) AS total_points, count(DISTINCT player_id) AS active_players
        FROM t_ledger JOIN t_players USING (player_id) WHERE {_WEEK} GROUP BY 1)""",
    "t_calendar": f"SELECT CAST(d AS DATE) AS day FROM generate_series({_FIRST}, {_TODAY}, INTERVAL 1 DAY) AS g(d)",
    "t_daily_players": """SELECT player_id, team, day, sum(coalesce(points, 0)) OVER (
            PARTITION BY player_id ORDER BY day) AS score FROM t_active CROSS JOIN t_calendar LEFT JOIN (
        SELECT player_id, CAST(ts AS DATE) AS day, sum(points) AS points FROM t_recent GROUP BY 1, 2)
        USING (player_id, day)""",
    "t_daily_ranks": """SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, player_id) AS overall,
        row_number() OVER (PARTITION BY day, team ORDER BY score DESC, player_id) AS in_team,
        count(*) OVER (PARTITION BY day, team) AS size FROM t_daily_players""",
    "t_turnaround": """SELECT player_id, team, bottom_day, min(day) AS top_day FROM (
        SELECT player_id, min(day) AS bottom_day FROM t_daily_ranks WHERE in_team >= size - 1 AND size >= 3 GROUP BY 1)
        JOIN t_daily_ranks USING (player_id) WHERE in_team <= 3 AND day > bottom_day GROUP BY 1, 2, 3""",
    "t_team_daily": """SELECT team, day, sum(coalesce(points, 0)) OVER (PARTITION BY team ORDER BY day) AS total
        FROM (SELECT DISTINCT team FROM t_players) CROSS JOIN t_calendar LEFT JOIN (
        SELECT team, CAST(ts AS DATE) AS day, sum(points) AS points FROM t_recent JOIN t_players USING (player_id)
        GROUP BY 1, 2) USING (team, day)""",
    "t_positions": "SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, team) AS position FROM t_team_daily",
    "t_top_runs": """SELECT team, min(day) AS from_day, max(day) AS to_day FROM (
        SELECT team, day, day - CAST(row_number() OVER (PARTITION BY team ORDER BY day) AS INTEGER) AS run FROM (
        SELECT team, day FROM t_daily_ranks WHERE overall <= 10 GROUP BY 1, 2 HAVING count(*) >= 3)) GROUP BY team, run""",
    "t_veteran_runs": """SELECT player_id, min(day) AS from_day, max(day) AS to_day FROM (
        SELECT player_id, day, day - CAST(row_number() OVER (PARTITION BY player_id ORDER BY day) AS INTEGER) AS run
        FROM t_daily_ranks WHERE in_team <= 3) GROUP BY player_id, run""",
    "t_strong_runs": f"""SELECT team, min(day) AS from_day, max(day) AS to_day FROM (
        SELECT team, day, day - CAST(row_number() OVER (PARTITION BY team ORDER BY day) AS INTEGER) AS run FROM (
        SELECT team, day FROM t_daily_players GROUP BY 1, 2 HAVING min(score) >= {S.WEAK_LINK})) GROUP BY team, run""",
    "t_gains": f"""SELECT team, CAST(ts AS DATE) AS day, points, ts FROM t_ledger JOIN t_players USING (player_id)
        WHERE points > 0 UNION ALL SELECT team, CAST(ts AS DATE), points, ts FROM t_direct""",
    "t_gain_days": f"SELECT team, day, sum(points) AS points FROM t_gains WHERE ts <= {_AS_OF} GROUP BY 1, 2",
    "t_sizes": "SELECT team, count(*) AS size FROM t_active GROUP BY 1",
    "t_records0": "SELECT *, max(total) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM t_run0",
    "t_records": """SELECT id, player_id, total AS score, ts AS date_achieved,
        lead(id) OVER (ORDER BY id) IS NULL AS is_current FROM t_records0 WHERE best IS NULL OR total > best""",
    "t_milestones": "SELECT milestone, min_by(player_id, id) AS player_id, min_by(total, id) AS score, "
        "min(ts) AS date_achieved FROM t_run0, (VALUES " + ", ".join(f"({m})" for m in S.MILESTONES) + ") AS m(milestone) "
        "WHERE total - points < milestone AND total >= milestone GROUP BY 1",
    "t_hall": """SELECT r.*, team FROM (
        SELECT 'first_' || milestone AS record_type, player_id, score, date_achieved, true AS is_current FROM t_milestones
        UNION ALL SELECT 'highest_score', player_id, score, date_achieved, is_current FROM t_records) r
        LEFT JOIN t_players USING (player_id)""",
    "t_curve_days": f"""SELECT player_id, CAST(ts AS DATE) AS day, sum(points) AS daily_points, max(total) AS max_total,
        max_by(total, id) AS close_total, count(*) AS actions_count, sum(greatest(points, 0)) AS positive_points,
        sum(least(points, 0)) AS negative_points, min_by(total - points, id) AS opening
        FROM t_run_recent GROUP BY 1, 2""",
    "t_window": f"SELECT * FROM t_curve_days WHERE day >= {_TODAY} - {S.CURVE_DAYS}",
    "t_initial": "SELECT player_id, min_by(opening, day) AS initial FROM t_window GROUP BY 1",
    "t_renames": f"""SELECT player_id AS old_id, player_id + {S.RENAME_OFFSET} AS new_id FROM t_players
        WHERE team = 'BUILDING'""",
    "t_undone": """SELECT * FROM t_ledger WHERE id NOT IN (SELECT max(id) FROM t_ledger GROUP BY player_id)""",
    "t_undone_run0": """SELECT *, sum(points) OVER w AS total, count(*) FILTER (points <= 0) OVER w AS resets
        FROM t_undone WINDOW w AS (PARTITION BY player_id ORDER BY id ROWS UNBOUNDED PRECEDING)""",
    "t_undone_run": """SELECT *, count(*) FILTER (points > 0) OVER (
        PARTITION BY player_id, resets ORDER BY id ROWS UNBOUNDED PRECEDING) AS streak FROM t_undone_run0""",
    "t_changes": """SELECT o_orderkey AS id, o_orderdate AS ts, o_custkey AS player_id, o_orderpriority AS player_class,
        year(o_orderdate) * 12 + month(o_orderdate) AS month, row_number() OVER (
        PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders""",
    "t_chain": """SELECT * FROM (WITH RECURSIVE chain AS (
        SELECT * FROM t_changes WHERE n = 1
        UNION ALL SELECT c.* FROM chain l JOIN t_changes c USING (player_id) WHERE c.n = (
            SELECT min(d.n) FROM t_changes d WHERE d.player_id = l.player_id AND d.n > l.n AND d.month - l.month >= 3))
        SELECT * FROM chain)""",
}


def _award(source: str, badge_id: str, entity: str = "player_id") -> str:
    """Award rows from ``(entity, date_earned)``."""
    return f"""SELECT {entity}, badge_id, badge_name, points, rarity, CAST(date_earned AS TIMESTAMP) AS date_earned
        FROM ({source}) w JOIN t_rules ON badge_id = '{badge_id}'"""


def _reach(period: str, threshold: int) -> str:
    return f"""SELECT team, min(day) AS date_earned FROM (SELECT *, sum(points) OVER (
        PARTITION BY team, date_trunc('{period}', day) ORDER BY day) AS so_far FROM t_gain_days)
        WHERE so_far >= {threshold} GROUP BY 1"""


_TEAM_AWARDS = {
    "badge_rocket": _award(_reach("week", S.WEEK_POINTS), "rocket_launch", "team"),
    "badge_tidal": _award(_reach("month", S.MONTH_POINTS), "tidal_wave", "team"),
    "badge_lightning": _award("""SELECT team, min(day) AS date_earned FROM (
        SELECT team, CAST(ts AS DATE) AS day FROM t_recent JOIN t_active USING (player_id) JOIN t_sizes USING (team)
        WHERE points > 0 GROUP BY team, day, size HAVING count(DISTINCT player_id) = size) GROUP BY 1""",
        "lightning_strike", "team"),
    "badge_house_on_fire": _award("""SELECT team, min(day) AS date_earned FROM (
        SELECT *, count(*) OVER (PARTITION BY team, week ORDER BY day) AS n FROM (
            SELECT team, size, player_id, date_trunc('week', day) AS week, min(day) AS day FROM t_days_recent
            JOIN t_active USING (player_id) JOIN t_sizes USING (team) GROUP BY ALL)) WHERE n >= size * 0.8 GROUP BY 1""",
        "house_on_fire", "team"),
    "badge_united": _award(f"""SELECT team, {_AS_OF} AS date_earned FROM (
        SELECT team, min(score) AS low FROM t_active_scores GROUP BY 1) LEFT JOIN (
        SELECT team, max(ts) AS bad FROM t_run_recent JOIN t_players USING (player_id) WHERE points < 0 AND total < 0
        GROUP BY 1) USING (team)
        WHERE low >= 0 AND (bad IS NULL OR bad < {_AS_OF} - INTERVAL {S.UNITED_DAYS} DAY)""", "united_we_stand", "team"),
    "badge_balance": _award(f"""SELECT team, {_AS_OF} AS date_earned FROM t_active_scores GROUP BY 1
        HAVING min(score) >= {S.BALANCE[0]} AND max(score) <= {S.BALANCE[1]}""", "perfect_balance", "team"),
    "badge_harmony": _award(f"""SELECT team, {_AS_OF} AS date_earned FROM t_active_scores
        WHERE month({_AS_OF}) = {S.HARMONY_MONTH} GROUP BY 1 HAVING max(score) - min(score) < {S.HARMONY_GAP}""",
        "harmony", "team"),
    "badge_mutual": _award(f"""SELECT team, {_AS_OF} AS date_earned FROM t_recent JOIN t_active USING (player_id)
        JOIN t_sizes USING (team) WHERE {_any('action', S.VOLUNTEER)} AND ts >= {_AS_OF} - INTERVAL 14 DAY
        GROUP BY team, size HAVING count(DISTINCT player_id) >= size * 0.8""", "mutual_support", "team"),
}
PARTS["t_team_badges"] = " UNION ALL ".join(_TEAM_AWARDS.values())

_NAMES = re.compile(r"\b(" + "|".join(PARTS) + r")\b")


def _sql(body: str, ints: str = "", days: str = "") -> str:
    """Full query: the named parts it needs, then ``body`` with sums as BIGINT and dates as text."""
    needed, todo = set(), [body]
    while todo:
        for name in _NAMES.findall(todo.pop()):
            if name not in needed:
                needed.add(name)
                todo.append(PARTS[name])
    casts = [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in days.split()]
    replaced = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({body})" if casts else body
    parts = ",\n".join(f"{n} AS ({sql})" for n, sql in PARTS.items() if n in needed)
    return f"WITH {parts}\n{replaced}" if parts else replaced


def _text_list(column: str) -> str:
    return f"array_to_string([CAST(x AS VARCHAR) FOR x IN {column}], ',')"


_STATS = "sport_points academic_points total_points"
_BREAKDOWN = "total_sport total_academic total_points"
_FIRST_BADGE = "SELECT * FROM t_all_badges WHERE badge_id IN "
_LEADER_INTS, _LEADER_DAYS = "points_earned total_score", "period_start period_end"
_CURVE_INTS = "daily_points max_total cumulative positive_points negative_points"


def _event_stats(start: str, end: str, period: str, ts: str = "ts", extra: str = "", source: str = "t_ledger") -> str:
    return f"""SELECT player_id, '{period}' AS period_type, {start} AS period_start, {end} AS period_end,
        sum(CASE WHEN category = 'sport' THEN points ELSE 0 END) AS sport_points,
        sum(CASE WHEN category = 'academic' THEN points ELSE 0 END) AS academic_points, sum(points) AS total_points,
        count(*) AS actions_count{extra} FROM (SELECT * REPLACE ({ts} AS ts) FROM {source})
        GROUP BY player_id, period_start, period_end"""


_HOURS = f"""SELECT team, count(*) FILTER (place = 1) AS hours FROM (
        SELECT team, row_number() OVER (PARTITION BY hour ORDER BY total DESC, team) AS place FROM (
        SELECT team, hour, sum(coalesce(points, 0)) OVER (PARTITION BY team ORDER BY hour) AS total
        FROM (SELECT DISTINCT team FROM t_players) CROSS JOIN generate_series(TIMESTAMP '{S.FIRST_DAY}',
            {_AS_OF} - INTERVAL 1 HOUR, INTERVAL 1 HOUR) AS g(hour) LEFT JOIN (
        SELECT team, date_trunc('hour', ts) AS hour, sum(points) AS points FROM t_ledger
        JOIN t_players USING (player_id) WHERE ts < {_AS_OF} GROUP BY 1, 2) USING (team, hour))) GROUP BY 1"""
_STANDINGS = f"""SELECT team, count(*) FILTER (place = 1) AS hours, count(*) FILTER (place = 1 AND hour + INTERVAL 1 HOUR > (
        SELECT max(ts) - INTERVAL 1 DAY FROM t_ledger)) AS provisional_hours FROM (
        SELECT team, hour, row_number() OVER (PARTITION BY hour ORDER BY total DESC, team) AS place FROM (
        SELECT team, hour, sum(coalesce(points, 0)) OVER (PARTITION BY team ORDER BY hour) AS total
        FROM (SELECT DISTINCT team FROM t_players) CROSS JOIN generate_series(TIMESTAMP '{S.FIRST_DAY}',
            date_trunc('hour', TIMESTAMP '{S.NOW}') - INTERVAL 1 HOUR, INTERVAL 1 HOUR) AS g(hour) LEFT JOIN (
        SELECT team, date_trunc('hour', ts) AS hour, sum(points) AS points FROM t_ledger
        JOIN t_players USING (player_id) GROUP BY 1, 2) USING (team, hour))) GROUP BY 1"""
_LATE = f"CAST(ts AS DATE) = DATE '{S.LATE_DAY}'"
_REPAIRED = f"""(SELECT * REPLACE (CASE WHEN {_LATE} AND action = 'error' THEN 0 ELSE points END AS points,
        CASE WHEN {_LATE} AND action = 'purchase' THEN ts + INTERVAL 7 DAY ELSE ts END AS ts) FROM t_ledger
        WHERE NOT ({_LATE} AND action = 'signup'))"""
_PARIS = "ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Paris'"
_WEEK_START = "CAST(date_trunc('week', ts) AS DATE)"


def _all_event_stats(source: str) -> str:
    bounds = {"week": (_WEEK_START, f"{_WEEK_START} + 6"), "month": ("CAST(date_trunc('month', ts) AS DATE)", "last_day(ts)"),
              "term": (_TERM["start"], _TERM["end"])}
    return _sql(" UNION ALL ".join(_event_stats(start, end, name, source=source) for name, (start, end) in bounds.items()), _STATS, _LEADER_DAYS)


def _stored(new_id: str, kept: str, renamed: str) -> str:
    """What each table of the store says of each player, under new ids, of the players kept, with the entries of renames."""
    term = _TERM["start"]
    return f"""SELECT stored, {new_id} AS player_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(points) AS BIGINT) AS points FROM (
        SELECT 'ledger' AS stored, player_id, count(*) AS n, sum(points) AS points FROM t_ledger GROUP BY ALL
        UNION ALL SELECT 'players', player_id, 1, 0 FROM t_players
        UNION ALL SELECT 'badges', player_id, count(*), sum(points) FROM t_badges GROUP BY ALL
        UNION ALL SELECT 'period_stats', player_id, count(DISTINCT date_trunc('week', ts)) + count(DISTINCT date_trunc('month', ts))
            + count(DISTINCT {term}), 3 * sum(points) FROM t_ledger GROUP BY ALL
        {renamed}) LEFT JOIN t_renames ON player_id = old_id WHERE {kept} GROUP BY ALL"""


ORACLE: dict[str, str] = {
    # sources and upkeep
    "scan_ledger": _sql("SELECT * FROM t_ledger"),
    "scan_players": _sql("SELECT * FROM t_scores", "score"),
    "badge_rules": _sql("""SELECT r.badge_id, r.scope, r.badge_name, r.points, r.rarity, count(b.badge_id) AS holders
        FROM t_rules r LEFT JOIN t_badges b USING (badge_id) GROUP BY ALL""", "points"),
    "ingest_validate": _sql(f"""SELECT r.id, r.ts, r.player_id, r.action, TRY_CAST(r.points AS BIGINT) AS points, r.actor,
        CASE WHEN r.player_id = '' THEN 'blank player' WHEN TRY_CAST(r.points AS DOUBLE) IS NULL THEN 'bad points'
        WHEN trim(r.action) = '' THEN 'blank action' WHEN p.player_id IS NULL THEN 'unknown player'
        ELSE 'accepted' END AS status FROM (
        SELECT event_id AS id, ts, CASE WHEN value < 80 THEN CAST(user_id AS VARCHAR) ELSE '' END AS player_id,
            CASE WHEN floor(value) = 0 THEN '  ' ELSE event_type END AS action,
            CASE WHEN value >= 50 AND value < 60 THEN 'n/a' ELSE CAST({_POINTS} AS VARCHAR) END AS points,
            CASE WHEN value >= 3 THEN 'staff' ELSE '{text.DEFAULT_ACTOR}' END AS actor FROM events) r
        LEFT JOIN t_players p ON r.player_id = CAST(p.player_id AS VARCHAR) AND p.team <> '{S.POOL}'"""),
    "ingest_players": _sql(f"""SELECT player_id AS id, name, team, team <> 'POOL' AS is_drafted,
        CASE WHEN team NOT IN {_in((*S.OPEN_TEAMS, 'POOL'))} THEN 'bad team'
        WHEN name IN (SELECT name FROM t_active) THEN 'duplicate name' ELSE 'accepted' END AS status FROM t_players"""),
    "team_direct_totals": _sql(f"""SELECT team, sum(points) AS total_points,
        sum(CASE WHEN {_WEEK} THEN points ELSE 0 END) AS week_points,
        sum(CASE WHEN date_trunc('month', ts) = DATE '2024-01-01' THEN points ELSE 0 END) AS month_points,
        count(*) AS entries FROM t_accepted WHERE ts <= {_AS_OF} GROUP BY 1""", "total_points week_points month_points"),
    "team_entries_accepted": _sql("SELECT * FROM t_accepted"),
    "backfill_period_stats": _sql("SELECT * FROM t_order_stats", _STATS, _LEADER_DAYS),
    "repair_period_stats": _all_event_stats(_REPAIRED),
    "stream_period_stats": _all_event_stats("t_ledger"),
    "export_players": _sql("""SELECT name, team, score, coalesce(sport_points, 0) AS sport_points,
        coalesce(academic_points, 0) AS academic_points, coalesce(current_streak, 0) AS current_streak,
        coalesce(max_streak, 0) AS max_streak, coalesce(badge_count, 0) AS badge_count
        FROM t_recent_scores LEFT JOIN (
            SELECT player_id, sum(CASE WHEN category = 'sport' THEN points ELSE 0 END) AS sport_points,
                sum(CASE WHEN category = 'academic' THEN points ELSE 0 END) AS academic_points
            FROM t_recent WHERE date_trunc('month', ts) = DATE '2024-01-01' GROUP BY 1) USING (player_id)
        LEFT JOIN t_state_recent USING (player_id)
        LEFT JOIN (SELECT player_id, count(*) AS badge_count FROM t_badges GROUP BY 1) USING (player_id)""",
        "score sport_points academic_points"),
    "export_teams": _sql("""SELECT team, sum(score) AS total_score, count(*) AS n_players,
        CASE WHEN sum(score) % count(*) = 0 THEN CAST(CAST(sum(score) // count(*) AS BIGINT) AS VARCHAR)
        ELSE printf('%.1f', round(avg(score), 1)) END AS avg_score, max(score) AS best_score, min(score) AS worst_score
        FROM t_scores GROUP BY 1""", "total_score best_score worst_score"),
    "export_team_badges": _sql("""SELECT team, count(*) AS n_badges, sum(points) AS badge_points FROM t_team_badges
        GROUP BY 1""", "badge_points"),
    "upsert_latest": _sql("""SELECT player_id, day, coalesce(u.points, e.points) AS points FROM (
        SELECT player_id, CAST(ts AS DATE) AS day, sum(points) AS points FROM t_ledger WHERE ts < DATE '2024-01-21'
        GROUP BY 1, 2) e FULL JOIN (
        SELECT player_id, CAST(ts AS DATE) AS day, sum(points) AS points FROM t_ledger
        WHERE ts >= DATE '2024-01-15' AND points > 0 GROUP BY 1, 2) u USING (player_id, day)""", "points", "day"),
    "upsert_stored": _sql("""SELECT player_id, day, coalesce(u.points, e.points) AS points FROM (
        SELECT player_id, CAST(ts AS DATE) AS day, sum(points) AS points FROM t_ledger WHERE ts < DATE '2024-01-21'
        GROUP BY 1, 2) e FULL JOIN (
        SELECT player_id, CAST(ts AS DATE) AS day, sum(points) AS points FROM t_ledger
        WHERE ts >= DATE '2024-01-15' AND points > 0 GROUP BY 1, 2) u USING (player_id, day)""", "points", "day"),
    "rename_everywhere": _sql(_stored("coalesce(new_id, player_id)", "true",
        "UNION ALL SELECT 'ledger', old_id, 1, 0 FROM t_renames"), "n points"),
    "delete_everywhere": _sql(_stored("player_id", f"player_id NOT IN (SELECT player_id FROM t_players WHERE team = '{S.POOL}')", ""), "n points"),
    "insert_if_absent": _sql("""SELECT player_id, name, CASE WHEN player_id IN (SELECT player_id FROM t_active)
        THEN 'kept' ELSE 'new' END AS origin FROM t_players"""),
    "schema_evolve": _sql("""SELECT * REPLACE (CASE WHEN ts < DATE '2024-01-15' THEN 'unknown' ELSE category END
        AS category) FROM t_ledger"""),
    "delete_entities": _sql(f"""SELECT * FROM t_ledger WHERE player_id NOT IN (
        SELECT player_id FROM t_players WHERE team = '{S.POOL}')"""),
    "stored_ledger_range": _sql(f"SELECT * FROM t_ledger WHERE {_WEEK}"),
    "rekey_entities": _sql("""SELECT l.* REPLACE (coalesce(new_id, player_id) AS player_id) FROM t_ledger l
        LEFT JOIN t_renames ON player_id = old_id"""),
    "rename_audit": _sql(f"""SELECT {_AS_OF} AS ts, new_id AS player_id,
        'Nom changé de "' || old_id || '" vers "' || new_id || '"' AS action, 'unknown' AS category,
        CAST(0 AS BIGINT) AS points, '{text.SYSTEM_ACTOR}' AS actor, 'system' AS kind FROM t_renames"""),
    # filters and projections
    "filter_eq": _sql("SELECT * FROM t_ledger WHERE player_id = 7 AND action = 'view'"),
    "filter_keywords": _sql("SELECT doc_id FROM documents WHERE " + _any(
        "text", [w for _, words in tables.DOCUMENT_RULES for w in words])),
    "filter_trailing_days": _sql(f"""SELECT id, ts, player_id, points FROM t_recent
        WHERE CAST(ts AS DATE) >= {_TODAY} - 10"""),
    "filter_trailing_months": _sql(f"""SELECT id, ts, player_id, points FROM t_orders
        WHERE ts <= {_ORDERS_AS_OF} AND ts >= {_THREE_MONTHS_AGO}"""),
    "project_alias": _sql("""SELECT name AS player_name, CAST(0 AS BIGINT) AS total_points, true AS is_drafted
        FROM t_players"""),
    # joins
    "join_badges_players": _sql("SELECT b.*, team FROM t_badges b JOIN t_players USING (player_id)", "points"),
    "reserve_pool": _sql(f"""SELECT player_id, name, score, coalesce(badge_count, 0) AS badge_count,
        coalesce(current_streak, 0) AS current_streak, coalesce(max_streak, 0) AS max_streak FROM t_scores
        LEFT JOIN (SELECT player_id, count(DISTINCT badge_id) AS badge_count FROM t_badges GROUP BY 1) USING (player_id)
        LEFT JOIN (SELECT player_id, current_streak, max_streak FROM t_state) USING (player_id)
        WHERE team = '{S.POOL}'""", "score"),
    "breakdown_from_ledger": _sql(f"""SELECT *, {_pct('total_sport', '(total_sport + total_academic)')} AS sport_percentage,
        {_pct('total_academic', '(total_sport + total_academic)')} AS academic_percentage FROM (
        SELECT team, coalesce(sum(CASE WHEN category = 'sport' AND points > 0 THEN points END), 0) AS total_sport,
            coalesce(sum(CASE WHEN category = 'academic' AND points > 0 THEN points END), 0) AS total_academic,
            coalesce(sum(CASE WHEN points > 0 THEN points END), 0) AS total_points,
            count(DISTINCT l.player_id) AS active_players
        FROM t_players p LEFT JOIN t_ledger l ON p.player_id = l.player_id AND {_WEEK} GROUP BY 1)""", _BREAKDOWN),
    "semi_join_team": _sql("""SELECT id, player_id, points FROM t_ledger WHERE player_id IN (
        SELECT player_id FROM t_players WHERE team = 'BUILDING')"""),
    "badge_count_per_player": _sql("""SELECT player_id, (SELECT count(*) FROM t_badges b WHERE b.player_id = p.player_id)
        AS badge_count FROM t_players p"""),
    "award_once": _sql(f"SELECT * FROM t_all_badges WHERE date_earned > {_AS_OF}", "points"),
    "players_with_badges": _sql("""SELECT p.*, coalesce(string_agg(badge_id, ',' ORDER BY badge_id), '') AS badges
        FROM t_players p LEFT JOIN t_badges USING (player_id) GROUP BY ALL"""),
    "team_totals": _sql("""SELECT team, players_total, coalesce(d, 0) AS team_points,
        players_total + coalesce(d, 0) AS total FROM (SELECT team, sum(score) AS players_total FROM t_scores GROUP BY 1)
        LEFT JOIN (SELECT team, sum(points) AS d FROM t_direct GROUP BY 1) USING (team)""",
        "players_total team_points total"),
    # aggregates
    "player_scores": _sql("SELECT player_id, sum(points) AS score FROM t_ledger GROUP BY 1", "score"),
    "period_stats": _sql("SELECT * FROM t_order_stats", _STATS, _LEADER_DAYS),
    "period_stats_strict_terms": _sql("""SELECT player_id, 'term' AS period_type, period_start, period_end,
        sum(CASE WHEN category = 'sport' THEN points ELSE 0 END) AS sport_points,
        sum(CASE WHEN category = 'academic' THEN points ELSE 0 END) AS academic_points, sum(points) AS total_points,
        count(*) AS actions_count FROM (SELECT *, """ + f"{_TERM['start']} AS period_start, {_TERM['end']} AS period_end "
        "FROM t_orders WHERE month(ts) NOT IN (7, 8)) GROUP BY ALL", _STATS, _LEADER_DAYS),
    "period_stats_paris": _sql(
        _event_stats(_WEEK_START, f"{_WEEK_START} + 6", "week", _PARIS) + " UNION ALL "
        + _event_stats("CAST(date_trunc('month', ts) AS DATE)", "last_day(ts)", "month", _PARIS), _STATS, _LEADER_DAYS),
    "period_stats_team": _sql(_event_stats(_WEEK_START, f"{_WEEK_START} + 6", "week", extra=", min_by(action, id) AS team"),
        _STATS, _LEADER_DAYS),
    "team_ranking": _sql("SELECT team, sum(score) AS total FROM t_scores GROUP BY 1", "total"),
    "daily_progress": _sql("""SELECT player_id, CAST(ts AS DATE) AS day, sum(points) AS daily_points,
        max(total) AS max_total, max_by(total, id) AS close_total, count(*) AS actions_count,
        sum(CASE WHEN points > 0 THEN points ELSE 0 END) AS positive_points,
        sum(CASE WHEN points < 0 THEN points ELSE 0 END) AS negative_points FROM t_run0 GROUP BY 1, 2""",
        "daily_points max_total close_total positive_points negative_points", "day"),
    "reserve_stats": _sql(f"""SELECT count(*) AS total_players, sum(score) AS total_points,
        round(avg(score), 6) AS avg_points, max(score) AS max_points, min(score) AS min_points FROM t_scores
        WHERE team = '{S.POOL}'""", "total_points max_points min_points"),
    "distinct_active_players": _sql("""SELECT team, CAST(ts AS DATE) AS day, count(DISTINCT player_id) AS active
        FROM t_ledger JOIN t_players USING (player_id) WHERE points > 0 GROUP BY 1, 2""", days="day"),
    "distinct_teams": _sql("SELECT DISTINCT team FROM t_players"),
    "team_breakdown": _sql("SELECT * FROM t_breakdown", _BREAKDOWN),
    "most_balanced_team": _sql("""SELECT * FROM t_breakdown WHERE total_points > 0 AND abs(50 - sport_percentage) < 100
        ORDER BY abs(50 - sport_percentage), total_points DESC, team LIMIT 1""", _BREAKDOWN),
    "most_active_team": _sql("""SELECT * FROM t_breakdown ORDER BY active_players DESC, total_points, team DESC
        LIMIT 1""", _BREAKDOWN),
    "breakdown_totals": _sql("""SELECT coalesce(team, 'ALL') AS team, sum(total_sport) AS total_sport,
        sum(total_academic) AS total_academic, sum(total_points) AS total_points, sum(active_players) AS active_players
        FROM t_breakdown GROUP BY ROLLUP (t_breakdown.team)""", _BREAKDOWN + " active_players"),
    "badge_leaders": _sql("""SELECT player_id, team, count(*) AS badge_count, sum(points) AS bonus_points
        FROM t_badges JOIN t_players USING (player_id) GROUP BY 1, 2
        ORDER BY badge_count DESC, bonus_points DESC, player_id LIMIT 10""", "bonus_points"),
    "period_type_summary": _sql("""SELECT period_type, count(*) AS rows, sum(total_points) AS total_points,
        max(period_start) AS latest_start FROM t_order_stats GROUP BY 1""", "total_points", "latest_start"),
    "team_period_points": _sql("""SELECT team, 'week' AS period_type, CAST(date_trunc('week', day) AS DATE) AS period_start,
        sum(points) AS points FROM t_gains GROUP BY 1, 2, 3 UNION ALL SELECT team, 'month',
        CAST(date_trunc('month', day) AS DATE), sum(points) FROM t_gains GROUP BY 1, 2, 3""", "points", "period_start"),
    "player_period_actions": _sql("""SELECT player_id, 'week' AS period_type,
        CAST(date_trunc('week', ts) AS DATE) AS period_start, count(*) AS positive_actions FROM t_ledger WHERE points > 0
        GROUP BY 1, 2, 3 UNION ALL SELECT player_id, 'month', CAST(date_trunc('month', ts) AS DATE), count(*)
        FROM t_ledger WHERE points > 0 GROUP BY 1, 2, 3""", "", "period_start"),
    "keyword_counters": _sql(f"""SELECT player_id, count(*) FILTER ({_PRAISE}) AS praise_count,
        count(*) FILTER ({_HARD}) AS hard_count, coalesce(string_agg(DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR), ','
        ORDER BY CAST(CAST(ts AS DATE) AS VARCHAR)) FILTER ({_HARD}), '') AS hard_days FROM t_ledger GROUP BY 1"""),
    "keyword_times": _sql(f"SELECT player_id, id, ts FROM t_ledger WHERE {_HARD}"),
    "team_last_negative": _sql("""SELECT team, max(ts) AS last_negative FROM t_run0 JOIN t_players USING (player_id)
        WHERE points < 0 AND total < 0 GROUP BY 1"""),
    "last_activity": _sql("SELECT player_id, min(ts) AS first_ts, max(ts) AS last_ts FROM t_ledger GROUP BY 1"),
    # ordered
    "ledger_running_total": _sql("SELECT id, player_id, points, total - points AS prev_total, total FROM t_run0",
                                 "prev_total total"),
    "streaks": _sql("SELECT player_id, current_streak, max_streak FROM t_state"),
    "lowest_score": _sql("SELECT player_id, lowest_score FROM t_state", "lowest_score"),
    "first_to_milestone": _sql("SELECT * FROM t_milestones", "milestone score"),
    "record_progression": _sql("SELECT * FROM t_records", "score"),
    "rank_in_team": _sql("""SELECT *, row_number() OVER (PARTITION BY team ORDER BY score DESC, player_id) AS rank_in_team
        FROM t_scores""", "score"),
    "global_rank": _sql("SELECT *, row_number() OVER (ORDER BY score DESC, player_id) AS rank FROM t_scores", "score"),
    "team_positions": _sql("SELECT * FROM t_positions", "total", "day"),
    "consecutive_days": _sql(f"""SELECT player_id, {_text_list('days')} AS days, last_day, in_a_row FROM t_last_days
        JOIN t_run_of_days USING (player_id)""", days="last_day"),
    "sustained_condition": _sql(f"""SELECT *, from_day + {S.TOP_DAYS} AS held_on FROM t_top_runs
        WHERE to_day >= from_day + {S.TOP_DAYS}""", days="from_day to_day held_on"),
    "rank_turnaround": _sql("SELECT * FROM t_turnaround", days="bottom_day top_day"),
    "latest_n_per_player": _sql("""SELECT id, player_id, points, position FROM (SELECT *, row_number() OVER (
        PARTITION BY player_id ORDER BY id DESC) AS position FROM t_ledger) WHERE position <= 50"""),
    "latest_entries": _sql("SELECT * FROM t_ledger ORDER BY id DESC LIMIT 10"),
    "team_running_total": _sql("""SELECT id, team, points, sum(points) OVER (
        PARTITION BY team ORDER BY id ROWS UNBOUNDED PRECEDING) AS total FROM t_direct""", "total"),
    "opening_balance": _sql("""SELECT player_id, CAST(ts AS DATE) AS day, min_by(total - points, id) AS opening
        FROM t_run0 GROUP BY 1, 2""", "opening", "day"),
    "trailing_count": _sql(f"""SELECT player_id, count(*) AS n FROM t_recent
        WHERE {_HARD} AND ts > {_AS_OF} - INTERVAL 14 DAY GROUP BY 1 HAVING count(*) >= 3"""),
    "hours_at_top": _sql(_HOURS),
    "global_top10": _sql("SELECT * FROM t_scores ORDER BY score DESC, player_id LIMIT 10", "score"),
    # composed
    "mvp_per_period": _sql("SELECT * FROM t_mvp", _LEADER_INTS, _LEADER_DAYS),
    "top5_per_period": _sql("""SELECT period_type, period_start, period_end, mvp_type, position, player_id, team,
        points_earned, total_score FROM t_leaders WHERE position <= 5 AND mvp_type IN ('academic', 'sport')""",
        _LEADER_INTS, _LEADER_DAYS),
    "mvp_history": _sql(f"SELECT * FROM t_mvp WHERE period_end < DATE '{S.ORDERS_AS_OF.date()}'", _LEADER_INTS, _LEADER_DAYS),
    "mvp_history_filtered": _sql(f"""SELECT * FROM t_mvp WHERE period_end < DATE '{S.ORDERS_AS_OF.date()}'
        AND period_type = 'month' AND mvp_type = 'sport' ORDER BY period_end DESC LIMIT 20""", _LEADER_INTS, _LEADER_DAYS),
    "progress_curve": _sql(f"""SELECT player_id, day, coalesce(daily_points, 0) AS daily_points,
        coalesce(max_total, initial + so_far) AS max_total, initial + so_far AS cumulative,
        coalesce(actions_count, 0) AS actions_count, coalesce(positive_points, 0) AS positive_points,
        coalesce(negative_points, 0) AS negative_points FROM (
        SELECT *, sum(coalesce(daily_points, 0)) OVER (PARTITION BY player_id ORDER BY day) AS so_far
        FROM t_initial CROSS JOIN (SELECT day FROM t_calendar WHERE day >= {_TODAY} - {S.CURVE_DAYS})
        LEFT JOIN t_window USING (player_id, day))""", _CURVE_INTS, "day"),
    "progress_summary": _sql("""SELECT player_id, initial, sum(daily_points) AS total_points,
        sum(actions_count) AS total_actions, count(*) AS active_days FROM t_window JOIN t_initial USING (player_id)
        GROUP BY 1, 2""", "initial total_points total_actions"),
    "progress_all": _sql("""SELECT player_id, day, daily_points, max_total, sum(daily_points) OVER (
        PARTITION BY player_id ORDER BY day) AS cumulative, actions_count, positive_points, negative_points
        FROM t_curve_days""", _CURVE_INTS, "day"),
    "player_state": _sql(f"""SELECT player_id, score, current_streak, max_streak, lowest_score, praise_count, hard_count,
        hard_recent, weekly_actions, monthly_actions, last_action, {_text_list('days')} AS consecutive_days,
        coalesce(in_a_row, false) AS in_a_row FROM (
        SELECT player_id, sum(points) AS score, count(*) FILTER ({_PRAISE}) AS praise_count,
            count(*) FILTER ({_HARD}) AS hard_count,
            count(*) FILTER ({_HARD} AND ts > {_AS_OF} - INTERVAL 14 DAY) AS hard_recent,
            count(*) FILTER (points > 0 AND {_WEEK}) AS weekly_actions,
            count(*) FILTER (points > 0 AND date_trunc('month', ts) = DATE '2024-01-01') AS monthly_actions,
            max(ts) AS last_action FROM t_recent GROUP BY 1)
        JOIN t_state_recent USING (player_id) LEFT JOIN t_last_days USING (player_id)
        LEFT JOIN t_run_of_days USING (player_id)""", "score lowest_score"),
    "team_rank_history": _sql(f"""SELECT team, string_agg(day || ':' || position || ':' || CAST(total AS BIGINT), ','
        ORDER BY day) AS history FROM t_positions WHERE day >= {_TODAY} - {S.CURVE_DAYS} GROUP BY 1"""),
    "hall_of_fame": _sql("SELECT * FROM t_hall", "score"),
    "current_records": _sql("SELECT * FROM t_hall WHERE is_current", "score"),
    "record_history_50": _sql("SELECT * FROM t_hall ORDER BY date_achieved DESC, record_type LIMIT 50", "score"),
    "absolute_record": _sql("SELECT * FROM t_scores ORDER BY score DESC, player_id LIMIT 1", "score"),
    "badge_feed": _sql("""SELECT 'player' AS scope, player_id, team, badge_id, badge_name, points, rarity, date_earned
        FROM t_badges JOIN t_players USING (player_id) UNION ALL SELECT 'team', CAST(NULL AS BIGINT), team, badge_id,
        badge_name, points, rarity, date_earned FROM t_team_badges""", "points"),
    # awards
    "badge_streaks": _sql(_FIRST_BADGE + "('hot_streak', 'tsunami', 'unstoppable')", "points"),
    "badge_on_fire": _sql(_FIRST_BADGE + "('on_fire')", "points"),
    "badge_phoenix": _sql(_FIRST_BADGE + "('phoenix')", "points"),
    "badge_marathon": _sql(_FIRST_BADGE + "('marathon_runner')", "points"),
    "badge_showtime": _sql(_FIRST_BADGE + "('showtime')", "points"),
    "badge_courage": _sql(_award(f"""SELECT player_id, {_ORDERS_AS_OF} AS date_earned FROM t_orders
        WHERE {_any('action', S.REFEREE)} AND ts >= {_THREE_MONTHS_AGO} AND ts <= {_ORDERS_AS_OF} GROUP BY 1
        HAVING count(*) >= {S.COURAGE_COUNT}""", "captain_courage"), "points"),
    "badge_clockwork": _sql(_award(f"""SELECT player_id, {_ORDERS_AS_OF} AS date_earned FROM t_orders
        WHERE ts <= {_ORDERS_AS_OF} GROUP BY 1 HAVING {_shift('min(ts)', 3)} <= {_ORDERS_AS_OF}
        AND count(*) FILTER ({_any('action', S.LATENESS)} AND ts >= {_THREE_MONTHS_AGO}) = 0""", "clockwork"), "points"),
    "badge_christmas": _sql(_award(f"""SELECT DISTINCT player_id, TIMESTAMP '{S.CHRISTMAS}' AS date_earned FROM t_orders
        WHERE points > 0 AND ts <= TIMESTAMP '{S.CHRISTMAS}' AND CAST(ts AS DATE) >= DATE '{S.CHRISTMAS.date()}' - 10""",
        "christmas_magic"), "points"),
    "badge_game_changer": _sql(_award("SELECT player_id, top_day AS date_earned FROM t_turnaround", "game_changer"), "points"),
    "badge_collector": _sql(_award(f"""SELECT player_id, {_AS_OF} AS date_earned FROM t_players
        WHERE (SELECT count(*) FROM t_badges b WHERE b.player_id = t_players.player_id) >= {S.OWN_BADGES}
        AND (SELECT count(*) FROM t_team_badges b WHERE b.team = t_players.team) >= {S.TEAM_BADGES}""",
        "collectionneur"), "points"),
    "badge_veteran": _sql(_award(f"""SELECT player_id, min(from_day + {S.VETERAN_DAYS}) AS date_earned FROM t_veteran_runs
        WHERE to_day >= from_day + {S.VETERAN_DAYS} GROUP BY 1""", "veteran"), "points"),
    "badge_team_player": _sql(_award(f"""SELECT player_id, date_earned FROM t_players JOIN (
        SELECT team, min(week + INTERVAL 7 DAY) AS date_earned FROM (
            SELECT team, date_trunc('week', day) AS week, row_number() OVER (
                PARTITION BY date_trunc('week', day) ORDER BY sum(points) DESC, team) AS place
            FROM t_gain_days GROUP BY 1, 2)
        WHERE place = 1 AND week + INTERVAL 7 DAY <= {_TODAY} GROUP BY 1) USING (team)""", "team_player"), "points"),
    **{name: _sql(body, "points") for name, body in _TEAM_AWARDS.items()},
    "badge_no_weak_link": _sql(_award(f"""SELECT team, min(from_day + {S.WEAK_LINK_DAYS}) AS date_earned FROM t_strong_runs
        WHERE to_day >= from_day + {S.WEAK_LINK_DAYS} GROUP BY 1""", "no_weak_link", "team"), "points"),
    "badge_triple_threat": _sql(_award(f"""SELECT team, min(from_day + {S.TOP_DAYS}) AS date_earned FROM t_top_runs
        WHERE to_day >= from_day + {S.TOP_DAYS} GROUP BY 1""", "triple_threat", "team"), "points"),
    "badge_bonus_rows": _sql(f"""SELECT date_earned AS ts, player_id, '{text.BONUS_ACTION}' || badge_name AS action,
        'unknown' AS category, points, '{text.SYSTEM_ACTOR}' AS actor, 'system' AS kind, sum(points) OVER (
        PARTITION BY player_id ORDER BY date_earned, badge_id ROWS UNBOUNDED PRECEDING) AS bonus_so_far FROM t_badges""",
        "points bonus_so_far"),
    "recompute_badges": _sql(f"""SELECT player_id, badge_id, badge_name, CAST(0 AS BIGINT) AS points, rarity,
        {_AS_OF} AS date_earned FROM (
        SELECT player_id, current_streak, lowest_score, coalesce(in_a_row, false) AS in_a_row,
            (SELECT sum(points) FROM t_recent l WHERE l.player_id = s.player_id) AS score,
            (SELECT count(*) FROM t_recent l WHERE l.player_id = s.player_id AND {_PRAISE}) AS praise,
            (SELECT count(*) FROM t_recent l WHERE l.player_id = s.player_id AND {_HARD}
                AND ts > {_AS_OF} - INTERVAL 14 DAY) AS hard
        FROM t_state_recent s LEFT JOIN t_run_of_days USING (player_id)) JOIN t_rules ON
        (badge_id = 'hot_streak' AND current_streak >= 5) OR (badge_id = 'tsunami' AND current_streak >= 10)
        OR (badge_id = 'unstoppable' AND current_streak >= 15) OR (badge_id = 'on_fire' AND hard >= 2)
        OR (badge_id = 'phoenix' AND lowest_score <= -50 AND score >= 50) OR (badge_id = 'marathon_runner' AND in_a_row)
        OR (badge_id = 'showtime' AND praise >= 3)"""),
    # corrections
    "undo_last": _sql("""SELECT player_id, max_by(streak, id) AS current_streak, max(streak) AS max_streak,
        sum(points) AS score, least(0, min(total)) AS lowest_score FROM t_undone_run GROUP BY 1""", "score lowest_score"),
    "apply_transfers": _sql(f"""SELECT player_id, name, coalesce(target, team) AS team,
        coalesce(target, team) <> 'POOL' AS is_drafted FROM t_players LEFT JOIN (
        SELECT player_id, max_by(target, id) AS target FROM t_requests WHERE target IN {_in((*S.TEAMS, 'POOL'))} GROUP BY 1)
        USING (player_id)"""),
    "transfer_audit": _sql(f"""SELECT id, ts, player_id, CASE WHEN target = 'POOL'
        THEN 'Renvoyé' || coalesce(' de ' || coalesce(before, team), '') || ' vers la réserve'
        ELSE 'Drafté vers ' || target END AS action, CASE WHEN target = 'POOL' THEN 'undraft' ELSE 'draft' END AS category,
        CAST(0 AS BIGINT) AS points, '{text.SYSTEM_ACTOR}' AS actor, 'system' AS kind FROM (
        SELECT *, lag(target) OVER (PARTITION BY player_id ORDER BY id) AS before FROM t_requests
        WHERE target IN {_in((*S.TEAMS, 'POOL'))}) LEFT JOIN t_players USING (player_id)"""),
    "team_undo_compensate": _sql(f"""SELECT (SELECT max(id) FROM t_accepted) + (n - 1) * count(*) OVER (PARTITION BY n)
        + row_number() OVER (PARTITION BY n ORDER BY team) AS id, {_AS_OF} AS ts, team,
        '{text.UNDO_ACTION}' || action AS action, -points AS points, actor, id AS reverses_id FROM (
        SELECT *, row_number() OVER (PARTITION BY team ORDER BY id DESC) AS n FROM t_accepted) WHERE n <= 2"""),
    "team_total_since_reset": _sql("""SELECT team, sum(CASE WHEN r IS NULL OR id > r THEN points ELSE 0 END)
        AS points_since_reset FROM t_direct LEFT JOIN (SELECT team, max(event_id) AS r FROM events JOIN t_players
        ON user_id = player_id WHERE event_type = 'error' AND floor(value) = 0 GROUP BY 1) USING (team) GROUP BY 1""",
        "points_since_reset"),
    "cooldown_accepted": _sql("SELECT player_id, ts, id, player_class FROM t_chain"),
    "cooldown_eligibility": _sql(f"""SELECT player_id, player_class, changed, can_change,
        CASE WHEN NOT can_change THEN {_shift('changed', 3)} END AS next_change FROM (
        SELECT player_id, max_by(player_class, ts) AS player_class, max(ts) AS changed,
            {S.ORDERS_AS_OF.year * 12 + S.ORDERS_AS_OF.month} - max(month) >= 3 AS can_change
        FROM t_chain WHERE ts <= {_ORDERS_AS_OF} GROUP BY 1)"""),
    # scalar functions
    "classify_category": _sql(f"""SELECT doc_id, {_classify('text', tables.DOCUMENT_RULES)} AS category,
        {_classify('text', text.DEFAULT_RULES)} AS default_category FROM documents"""),
    "week_bounds": _sql("""SELECT id, CAST(date_trunc('week', ts) AS DATE) AS week_start,
        CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end FROM t_ledger""", days="week_start week_end"),
    "month_bounds": _sql("""SELECT id, CAST(date_trunc('month', ts) AS DATE) AS month_start, last_day(ts) AS month_end
        FROM t_orders""", days="month_start month_end"),
    "term_bounds": _sql(f"SELECT id, {_TERM['start']} AS term_start, {_TERM['end']} AS term_end FROM t_orders",
                        days="term_start term_end"),
    "month_shift": _sql(f"""SELECT id, {_shift('ts', 1)} AS plus_1, {_shift('ts', 2)} AS plus_2,
        {_shift('ts', -3)} AS minus_3 FROM t_orders"""),
    "round_pct": _sql(f"""SELECT player_id, day, {_pct('sport', '(sport + academic)')} AS sport_pct FROM (
        SELECT player_id, CAST(ts AS DATE) AS day,
        sum(CASE WHEN category = 'sport' AND points > 0 THEN points ELSE 0 END) AS sport,
        sum(CASE WHEN category = 'academic' AND points > 0 THEN points ELSE 0 END) AS academic
        FROM t_ledger GROUP BY 1, 2)""", days="day"),
    "array_last_n": _sql(f"""SELECT player_id, {_text_list('list_slice(days, -5, -1)')} AS last_days,
        list_contains(days, {_TODAY}) AS today, len([d FOR d IN days IF dayofweek(d) = 1]) AS mondays,
        len([d FOR d IN days IF d < DATE '2024-01-18']) = 0 AS all_recent,
        len([d FOR d IN days IF d < DATE '2024-01-15']) > 0 AS any_old FROM t_last_days"""),
    "json_array_roundtrip": _sql(f"""SELECT player_id, CAST(to_json([CAST(d AS VARCHAR) FOR d IN days]) AS VARCHAR)
        AS days_json, {_text_list('days')} AS days FROM t_last_days"""),
    "pseudonym_key": _sql(f"""SELECT player_id, substr(h, 1, 3) || '-' || substr(h, 4, 3) AS code FROM (
        SELECT player_id, upper(md5('{S.SALT}' || lower(name))) AS h FROM t_players)"""),
    "flatten_roster": _sql("SELECT team, player_id, name FROM t_players"),
    # streams, run over all that is there
    "stream_player_state": _sql("""SELECT player_id, count(*) AS n, sum(points) AS score, min(lowest) AS lowest_score,
        max_by(streak, id) AS current_streak, max(streak) AS max_streak, max(praise) AS praise_count FROM t_run
        GROUP BY 1""", "score lowest_score"),
    "stream_week_points": _sql("""SELECT team, date_trunc('week', ts) AS week_start, sum(points) AS points
        FROM t_ledger JOIN t_players USING (player_id) WHERE points > 0 GROUP BY 1, 2""", "points"),
    "stream_month_points": _sql("""SELECT team, strftime(ts, '%Y-%m') AS month, sum(points) AS points FROM t_ledger
        JOIN t_players USING (player_id) WHERE points > 0 GROUP BY 1, 2""", "points"),
    "stream_hours_at_top": _sql(_HOURS),
    "stream_standings": _sql(_STANDINGS),
    "stream_award_once": _sql(
        _FIRST_BADGE + "('hot_streak', 'tsunami', 'unstoppable', 'phoenix', 'showtime')", "points"),
    "stream_no_weak_link": _sql(_award(f"""SELECT team, min(from_day + {S.WEAK_LINK_DAYS}) AS date_earned FROM t_strong_runs
        WHERE to_day >= from_day + {S.WEAK_LINK_DAYS} GROUP BY 1""", "no_weak_link", "team"), "points"),
    "stream_sustained": _sql(f"""SELECT player_id, from_ts, from_ts + INTERVAL {S.LEVEL_DAYS} DAY AS held_ts FROM (
        SELECT player_id, min(ts) AS from_ts, coalesce(max(next_ts) FILTER (NOT next_ok), greatest(max(ts), (
            SELECT max(ts) - INTERVAL 1 DAY FROM t_ledger))) AS to_ts FROM (
        SELECT *, total >= {S.LEVEL} AS ok, count(*) FILTER (total < {S.LEVEL}) OVER w AS run,
            lead(total) OVER (PARTITION BY player_id ORDER BY id) >= {S.LEVEL} AS next_ok,
            lead(ts) OVER (PARTITION BY player_id ORDER BY id) AS next_ts FROM t_run0
            WINDOW w AS (PARTITION BY player_id ORDER BY id ROWS UNBOUNDED PRECEDING))
        WHERE ok GROUP BY player_id, run) WHERE to_ts >= from_ts + INTERVAL {S.LEVEL_DAYS} DAY"""),
}


def _cells(sheet: str, entity: str, fields: str) -> str:
    values = ", ".join(f"('{f}', CAST({f} AS VARCHAR))" for f in fields.split())
    return f"SELECT '{sheet}' AS sheet, {entity} AS entity, field, value FROM ({ORACLE['export_' + sheet]}) s, LATERAL (VALUES {values}) AS v(field, value)"


ORACLE["export_csv"] = " UNION ALL ".join((
    _cells("players", "name", "team score sport_points academic_points current_streak max_streak badge_count"),
    _cells("teams", "team", "total_score n_players avg_score best_score worst_score"),
    _cells("team_badges", "team", "n_badges badge_points")))
