"""Undo, transfers, resets and changes with a cooldown."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text
from .ordered import CHUNK_BITS, with_chunks


# The classes a player may choose.
CLASSES = ("warrior", "archer", "mage", "assassin", "paladin", "bard")


def undo_last(ledger: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The ledger without the last entry of each player (of the players in ``keys``, if given).

    Derived state is computed anew from the result. The anti-join is on player and id, so no player is hot in it.
    """
    chosen = ledger if keys is None else ledger.join(keys.select("player_id").distinct(), "player_id", "left_semi")
    last = chosen.groupBy("player_id").agg(F.max("id").alias("id"))
    return ledger.join(last, ["player_id", "id"], "left_anti")


def undo_team_entry(direct: DataFrame, at: dt.datetime, actor: str = text.DEFAULT_ACTOR) -> DataFrame:
    """The team ledger plus one row per team that reverses its last entry not yet reversed.

    Reversing rows name the entry in ``reverses_id`` and are never reversed themselves. Their ids follow the greatest one.
    """
    if "reverses_id" not in direct.columns:
        direct = direct.withColumn("reverses_id", F.lit(None).cast("bigint"))
    undone = direct.where(F.col("reverses_id").isNotNull()).select(F.col("reverses_id").alias("id"))
    open_entries = direct.where(F.col("reverses_id").isNull()).join(undone, "id", "left_anti")
    last = open_entries.groupBy("team").agg(F.max_by(F.struct("id", "action", "points"), "id").alias("e"))
    greatest = direct.agg(F.max("id")).scalar()
    # one row per team is left here, which a single task can number
    number = F.row_number().over(Window.orderBy("team"))
    reversing = last.select(
        (greatest + number).alias("id"), cal.ntz(at).alias("ts"), "team",
        F.concat(F.lit(text.UNDO_ACTION), F.coalesce("e.action", F.lit(""))).alias("action"),
        (-F.col("e.points")).alias("points"), F.lit(actor).alias("actor"), F.col("e.id").alias("reverses_id"))
    return direct.unionByName(reversing)


def total_since_reset(direct: DataFrame, resets: DataFrame, teams: Sequence[str]) -> DataFrame:
    """Team-direct points after each team's last reset.

    The resets are reduced to one row per team of the given list, which bounds what is broadcast.
    """
    allowed = list(teams)
    last = resets.where(F.col("team").isin(allowed)).groupBy("team").agg(F.max("id").alias("_reset"))
    return direct.where(F.col("team").isin(allowed)).join(F.broadcast(last), "team", "left").groupBy("team").agg(
        F.sum(F.when(F.col("_reset").isNull() | (F.col("id") > F.col("_reset")), F.col("points")).otherwise(0))
        .alias("points_since_reset"))


def valid_transfers(requests: DataFrame, teams: Sequence[str], pool: str = "POOL") -> DataFrame:
    return requests.where(F.col("target").isin([*teams, pool]))


def apply_transfers(players: DataFrame, requests: DataFrame, teams: Sequence[str], pool: str = "POOL") -> DataFrame:
    """Players with the team of their last valid request; those in the pool are not drafted."""
    last = valid_transfers(requests, teams, pool).groupBy("player_id").agg(F.max_by("target", "id").alias("_target"))
    team = F.coalesce("_target", "team")
    return players.join(last, "player_id", "left").withColumn("team", team).withColumn(
        "is_drafted", F.col("team") != pool).drop("_target")


def transfer_origins(players: DataFrame, requests: DataFrame, teams: Sequence[str], pool: str = "POOL",
                     bits: int = CHUNK_BITS) -> DataFrame:
    """Valid requests with ``origin``: the target of the player's one before, else the team of the dimension.

    Requests are looked back at within ranges of the id; the last target of each range is carried to the next.
    """
    rows = with_chunks(valid_transfers(requests, teams, pool), bits)
    last = rows.groupBy("player_id", "_chunk").agg(F.max_by("target", "id").alias("_last"))
    carried = last.select("player_id", "_chunk", F.lag("_last").over(Window.partitionBy("player_id").orderBy("_chunk")).alias("_carried"))
    starts = carried.join(players.select("player_id", F.col("team").alias("_team")), "player_id", "left").select(
        "player_id", "_chunk", F.coalesce("_carried", "_team").alias("_start"))
    before = F.lag("target").over(Window.partitionBy("player_id", "_chunk").orderBy("id"))
    return rows.withColumn("_before", before).join(starts, ["player_id", "_chunk"]).select(
        *requests.columns, F.coalesce("_before", "_start").alias("origin"))


def transfer_audit(players: DataFrame, requests: DataFrame, teams: Sequence[str], pool: str = "POOL") -> DataFrame:
    """One zero-point system entry per valid request; sending back to the pool names the team of origin (none for a player unknown)."""
    into_pool = F.col("target") == pool
    origin = F.coalesce(F.concat(F.lit(" de "), "origin"), F.lit(""))
    sent_back = F.concat(F.lit(text.SENT_BACK), origin, F.lit(text.TO_POOL))
    return transfer_origins(players, requests, teams, pool).select(
        "id", "ts", "player_id",
        F.when(into_pool, sent_back).otherwise(F.concat(F.lit(text.DRAFTED_TO), "target")).alias("action"),
        F.when(into_pool, "undraft").otherwise("draft").alias("category"), F.lit(0).cast("bigint").alias("points"),
        F.lit(text.SYSTEM_ACTOR).alias("actor"), F.lit("system").alias("kind"))


def accepted_changes(requests: DataFrame, months: int = 3, classes: Sequence[str] | None = CLASSES) -> DataFrame:
    """Requests that pass a cooldown of calendar months since the last one that passed.

    The rule is greedy, so it is a fold per player. It only looks at months, and within a month only the first request can
    pass: the aggregate keeps one per player and month before anything is gathered. ``classes=None`` allows any class.
    """
    if months < 1:
        raise ValueError("a cooldown lasts one month at least; without one every request passes")
    if classes is not None:
        requests = requests.where(F.col("player_class").isin(list(classes)))
    first = requests.withColumn("month", cal.month_index(F.col("ts"))).groupBy("player_id", "month").agg(
        F.min_by(F.struct("ts", "id", "player_class"), F.struct("ts", "id")).alias("r"))
    history = first.groupBy("player_id").agg(F.sort_array(F.collect_list(F.struct("month", "r"))).alias("h"))

    def step(passed, request):
        since = request["month"] - F.try_element_at(passed, F.lit(-1))["month"]
        return F.when(F.coalesce(since >= months, F.lit(True)), F.array_append(passed, request)).otherwise(passed)

    passed = F.aggregate("h", F.filter("h", lambda _: F.lit(False)), step)
    return history.select("player_id", F.explode(passed).alias("p")).select("player_id", "p.r.*")


def change_eligibility(requests: DataFrame, as_of: dt.datetime, months: int = 3,
                       classes: Sequence[str] | None = CLASSES) -> DataFrame:
    """Per player the last change that passed, whether another may be made now, and if not, from when."""
    last = accepted_changes(requests.where(F.col("ts") <= cal.ntz(as_of)), months, classes).groupBy("player_id").agg(
        F.max_by("player_class", "ts").alias("player_class"), F.max("ts").alias("changed"))
    can = (as_of.year * 12 + as_of.month) - cal.month_index(F.col("changed")) >= months
    return last.withColumns({
        "can_change": can,
        "next_change": F.when(~can, cal.month_shift(F.col("changed"), months)),
    })
