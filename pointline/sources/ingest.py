"""Checks on the way in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


PLAIN_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"
MOST_POINTS = 10**16


def validate_entries(entries: DataFrame, players: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """Judge raw text entries: ``status`` is ``accepted``, or names the first failed test.

    Points are plain decimal numbers of at most ``most`` in size, so that sums of an entry's ledger cannot run over soon; they are
    rounded down exactly, in decimal arithmetic.

    ``entries.player_id`` is text; ``players.player_id`` is matched on its text form. The one shuffle is the join to the
    players, which adaptive execution splits where a player is hot.
    """
    known = players.select(F.col("player_id").cast("string").alias("_key"), F.lit(True).alias("_known"))
    checked = entries.withColumns({
        "_key": F.trim("player_id"),
        "_points": F.when(F.trim("points").rlike(PLAIN_NUMBER), F.expr("try_cast(trim(points) AS decimal(38,10))")),
    }).join(known, "_key", "left")
    status = (
        F.when(text.is_blank(F.col("player_id")), "blank player")
        .when(F.col("_points").isNull() | (F.abs("_points") > most), "bad points")
        .when(text.is_blank(F.col("action")), "blank action")
        .when(F.col("_known").isNull(), "unknown player")
        .otherwise("accepted")
    )
    return checked.select(
        "id", "ts", F.col("_key").alias("player_id"), "action", F.when(F.abs("_points") <= most, F.floor("_points")).cast("bigint").alias("points"),
        F.coalesce("actor", F.lit(text.DEFAULT_ACTOR)).alias("actor"), status.alias("status"),
    )


def split_accepted(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their reason."""
    accepted = F.col("status") == "accepted"
    return judged.where(accepted).drop("status"), judged.where(~accepted).withColumnRenamed("status", "reason")


def accept_team_entries(entries: DataFrame, teams: Sequence[str]) -> DataFrame:
    """Team-direct entries of the allowed teams, with the default action text filled in."""
    return entries.where(F.col("team").isin(list(teams))).withColumn(
        "action", F.coalesce("action", text.signed_label(F.col("points"))))


def validate_players(requests: DataFrame, existing: DataFrame, teams: Sequence[str], pool: str = "POOL") -> DataFrame:
    """Judge requests ``(id, name, team)`` for new players.

    Names are trimmed; of several requests for one name only the first may pass.
    """
    allowed = [*teams, pool]
    taken = existing.select("name", F.lit(True).alias("_taken"))
    clean = requests.withColumn("name", F.trim("name"))
    valid = ~text.is_blank(F.col("name")) & F.coalesce(F.col("team").isin(allowed), F.lit(False))
    first = clean.where(valid).groupBy("name").agg(F.min("id").alias("_first"))
    status = (
        F.when(text.is_blank(F.col("name")), "blank name")
        .when(F.col("team").isNull() | ~F.col("team").isin(allowed), "bad team")
        .when(F.col("_taken") | (F.col("id") != F.col("_first")), "duplicate name")
        .otherwise("accepted")
    )
    return clean.join(first, "name", "left").join(taken, "name", "left").select(
        "id", "name", "team", (F.col("team") != pool).alias("is_drafted"), status.alias("status"))
