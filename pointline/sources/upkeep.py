"""Keeping stored tables right: upsert, insert if absent, evolve, delete, re-key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.ordered import ranked


def upsert_latest(existing: DataFrame, updates: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key; rows of ``updates`` replace those of ``existing``.

    Of several updates of a key the last in ``order`` counts, a column of ``updates`` that is not stored; ties, and all of them without
    ``order``, go to the greatest row, so the choice never hangs on the order of input. It is an aggregate, so
    equal keys are reduced before the shuffle.
    """
    rest = [c for c in existing.columns if c not in keys]
    place = F.col(order) if order else F.lit(0)
    new = updates.withColumns({"_version": F.lit(1), "_place": place})
    if order and order not in existing.columns:
        new = new.drop(order)
    both = existing.withColumns({"_version": F.lit(0), "_place": F.lit(None)}).unionByName(new)
    latest = both.groupBy(*keys).agg(F.max(F.struct("_version", "_place", *rest)).alias("_row"))
    return latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def insert_if_absent(existing: DataFrame, candidates: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """``existing`` plus the candidates whose key it lacks; of several the first in ``order``, a column that is not stored, ties
    going to the smallest row."""
    rest = [c for c in existing.columns if c not in keys]
    place = F.col(order) if order else F.lit(0)
    first = candidates.groupBy(*keys).agg(F.min(F.struct(place.alias("_place"), *rest)).alias("_row"))
    new = first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(new)


def evolve(old: DataFrame, new: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Old and new generations of a table together; columns the old one lacks get their default."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def delete_entities(table: DataFrame, gone: DataFrame, key: str = "player_id") -> DataFrame:
    """The table without the rows of the listed entities; apply to every table that has the key."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def checked_renames(mapping: DataFrame, existing: DataFrame) -> DataFrame:
    """Renames ``(old_id, new_id)`` that can be made: the old key exists, the new one is free, neither occurs twice."""
    ids = existing.select(F.col("player_id").alias("_id"))
    once_old = mapping.groupBy("old_id").agg(F.count(F.lit(1)).alias("_n"), F.min("new_id").alias("new_id"))
    once_new = once_old.where("_n = 1").groupBy("new_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("old_id").alias("old_id"))
    return (
        once_new.where("_n = 1").select("old_id", "new_id")
        .join(ids, F.col("new_id") == F.col("_id"), "left_anti")
        .join(ids, F.col("old_id") == F.col("_id"), "left_semi")
    )


def rekey(table: DataFrame, renames: DataFrame, key: str = "player_id") -> DataFrame:
    """The table under new keys; apply to every table that has the key."""
    names = renames.withColumnRenamed("old_id", key)
    return table.join(names, key, "left").withColumn(key, F.coalesce("new_id", key)).drop("new_id").select(
        *table.columns)


def delete_everywhere(store, gone: DataFrame, key: str = "player_id") -> dict[str, list[str]]:
    """Removes the listed entities from all tables of a store at once; names the partitions that were written anew."""
    return store.change_rows(key, gone, lambda rows: delete_entities(rows, gone, key))


def rename_everywhere(store, renames: DataFrame, at, dimension: str = "players", ledger: str = "ledger") -> dict[str, list[str]]:
    """Applies renames ``(old_id, new_id)`` to all tables of a store at once, with a system entry for each.

    All are judged against the same snapshot: a new id that is anybody's present one is refused, so neither chains nor cycles nor
    merged entities come about. Entries get the next free ids, in the order of the new ids.
    """
    asked = checked_renames(renames, store.read(dimension)).persist()
    last = F.lit(store.read(ledger).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    audit = ranked(rename_audit(asked, at), "points", "player_id", name="_n").withColumn("id", last + F.col("_n")).drop("_n")
    schema = store.read(ledger).schema
    extra = [c for c in schema.names if c not in audit.columns]  # such as the day a ledger is stored by
    audit = audit.withColumns({c: (F.to_date("ts") if c == "day" else F.lit(None)).cast(schema[c].dataType) for c in extra}).select(*schema.names)
    touched = store.change_rows("player_id", asked.select(F.col("old_id").alias("player_id")), lambda rows: rekey(rows, asked), {ledger: audit})
    asked.unpersist()
    return touched


def rename_audit(renames: DataFrame, at) -> DataFrame:
    """One zero-point system row per rename; a ``NULL`` id is given out by whoever appends the rows."""
    label = text.renamed(F.col("old_id").cast("string"), F.col("new_id").cast("string"))
    return renames.select(
        F.lit(None).cast("bigint").alias("id"), at.alias("ts"), F.col("new_id").alias("player_id"),
        label.alias("action"), F.lit("unknown").alias("category"), F.lit(0).cast("bigint").alias("points"),
        F.lit(text.SYSTEM_ACTOR).alias("actor"), F.lit("system").alias("kind"))
