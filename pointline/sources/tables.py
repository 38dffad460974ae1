"""Ledger, dimension and text views over the given Parquet tables.

A *ledger* has ``id`` (unique, in order of arrival), ``ts`` (TIMESTAMP_NTZ, never falling with ``id``),
``player_id``, ``action``, ``category``, ``points`` (BIGINT), ``actor`` and ``kind`` (``action`` for entries made by a
person, ``system`` for rows the engine adds). The one made from orders is sorted by neither; it only feeds operators
that do not depend on order of arrival.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

LEDGER_COLUMNS = ("id", "ts", "player_id", "action", "category", "points", "actor", "kind")

# Category rules for the event types; "purchase" is in both lists, so the first match decides.
EVENT_RULES = (("sport", ("purchase", "click")), ("academic", ("purchase", "view", "signup")))
ORDER_RULES = (("sport", ("urgent", "high")), ("academic", ("medium", "specified")))
# Word parts that occur in the generated documents.
DOCUMENT_RULES = (("sport", ("heit", "tionoi", "ÉAU")), ("academic", ("tion", "üch", "été")))


# Schemas of the given tables; stating them spares a pass over file footers.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(os.path.join(folder, f"{name}.parquet"))


def stored_ledger(spark: SparkSession, folder: str, first: dt.date | None = None,
                  last: dt.date | None = None) -> DataFrame:
    """A ledger stored by ``sinks.write_ledger``; only the folders of the days asked for are read."""
    ledger = spark.read.parquet(folder)
    if first is not None:
        ledger = ledger.where(F.col("day") >= F.lit(first))
    if last is not None:
        ledger = ledger.where(F.col("day") <= F.lit(last))
    return ledger


def as_ledger(entries: DataFrame, rules: text.CategoryRules) -> DataFrame:
    """Classify raw ``id, ts, player_id, action, points`` entries and fill the ledger's other columns."""
    return entries.select(
        "id", "ts", "player_id", "action",
        text.classify(F.col("action"), rules).alias("category"),
        "points",
        F.lit(text.DEFAULT_ACTOR).alias("actor"),
        F.lit("action").alias("kind"),
    )


def event_points():
    """Whole points of an event; errors count against the player."""
    return F.when(F.col("event_type") == "error", -1).otherwise(1) * F.floor("value").cast("bigint")


def event_ledger(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("player_id"),
        F.col("event_type").alias("action"), event_points().alias("points"),
    )
    return as_ledger(events, EVENT_RULES)


def order_ledger(spark: SparkSession, folder: str) -> DataFrame:
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    orders = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("player_id"),
        F.col("o_orderpriority").alias("action"),
        (sign * F.floor(F.col("o_totalprice") / 10000).cast("bigint")).alias("points"),
    )
    return as_ledger(orders, ORDER_RULES)


def players(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").select(
        F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("team"),
    )


def active_players(spark: SparkSession, folder: str) -> DataFrame:
    """Players with at least one event."""
    ids = read(spark, folder, "events").select(F.col("user_id").alias("player_id")).distinct()
    return players(spark, folder).join(ids, "player_id", "left_semi")


def team_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that score for a team directly: sign-ups, with an action text only above ten points."""
    entries = (
        read(spark, folder, "events").where(F.col("event_type") == "signup")
        .select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("player_id"),
                event_points().alias("points"), F.col("event_type").alias("action"))
    )
    return entries.join(players(spark, folder), "player_id").select(
        "id", "ts", "team", F.when(F.col("points") > 10, F.col("action")).alias("action"), "points",
        F.lit(text.DEFAULT_ACTOR).alias("actor"),
    )


def team_resets(spark: SparkSession, folder: str) -> DataFrame:
    """Reset markers of team totals: zero-point errors of a member."""
    marks = read(spark, folder, "events").where((F.col("event_type") == "error") & (F.floor("value") == 0)).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("player_id"))
    return marks.join(players(spark, folder), "player_id").select("id", "team")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", "text")


def raw_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Unchecked entries as text, with blank actions, non-numeric points and missing actors among them."""
    value = F.col("value")
    return read(spark, folder, "events").select(
        F.col("event_id").alias("id"), "ts",
        F.when(value < 80, F.col("user_id").cast("string")).otherwise(" ").alias("player_id"),
        F.when(F.floor(value) == 0, "  ").otherwise(F.col("event_type")).alias("action"),
        F.when((value >= 50) & (value < 60), "n/a").otherwise(event_points().cast("string")).alias("points"),
        F.when(value >= 3, "staff").alias("actor"),
    )


def transfer_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests to move a player, some of them to the pool, some to a team that does not exist."""
    value = F.floor("value")
    target = (
        F.when(value < 2, "POOL").when(value < 4, "AUTOMOBILE").when(value < 8, "BUILDING")
        .when(value < 14, "FURNITURE").when(value < 22, "HOUSEHOLD").when(value < 40, "MACHINERY").otherwise("NOWHERE")
    )
    return read(spark, folder, "events").where(F.col("event_type") == "view").select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("player_id"), target.alias("target"))


def class_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Requests to change class: every order, with the priority as the class asked for."""
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("player_id"),
        F.col("o_orderpriority").alias("player_class"))
