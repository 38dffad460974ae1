"""Ordered computations that no single key can overload.

A window over ``partitionBy(player).orderBy(id)`` puts all rows of a player into one task. Here every player's rows are cut into
chunks of the id range. Ids are unique, so a chunk never holds more than ``2**CHUNK_BITS`` rows; windows run inside
chunks, and a summary with one row per player and chunk carries the totals from chunk to chunk. The plan is the same for every
player and size: rows are shuffled once, by player and chunk, and the join with the summary reuses that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 20


def with_chunks(ledger: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Adds ``_chunk``, the id range of the row."""
    return ledger.withColumn("_chunk", F.shiftright("id", bits))


def _before(key: str) -> Window:
    return Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _so_far(key: str) -> Window:
    return Window.partitionBy(key, "_chunk").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)


def running_total(ledger: DataFrame, key: str = "player_id", bits: int = CHUNK_BITS) -> DataFrame:
    """Adds ``total`` (the key's total after each entry) and ``prev_total`` (before it)."""
    rows = with_chunks(ledger, bits)
    sums = rows.groupBy(key, "_chunk").agg(F.sum("points").alias("_s"))
    opening = sums.select(key, "_chunk", F.coalesce(F.sum("_s").over(_before(key)), F.lit(0)).alias("_open"))
    inside = rows.withColumn("_sum", F.sum("points").over(_so_far(key)))
    total = F.col("_sum") + F.coalesce("_open", F.lit(0))
    return inside.join(opening, [key, "_chunk"], "left").select(
        *ledger.columns, total.alias("total"), (total - F.col("points")).alias("prev_total"))


def running_state(ledger: DataFrame, counters: dict[str, Column] | None = None, bits: int = CHUNK_BITS) -> DataFrame:
    """Adds each player's state after every entry.

    ``total``, ``lowest`` (least total so far, at most 0), ``streak`` (positive entries since the last entry of zero or
    less) and, for every name in ``counters``, how often its condition has held.

    The streak is the number of positive entries so far less that number at the last reset, so it needs only running sums
    and a running maximum, which carry over chunk borders. System entries count towards the total only.
    """
    key = "player_id"
    counters = counters or {}
    action = F.col("kind") == "action" if "kind" in ledger.columns else F.lit(True)
    reset = action & (F.col("points") <= 0)
    tests = {"pos": action & (F.col("points") > 0), **{name: action & test for name, test in counters.items()}}
    sums = {"total": F.col("points"), **{name: F.when(test, 1).otherwise(0) for name, test in tests.items()}}
    rows = with_chunks(ledger, bits)
    inside = rows.withColumns({f"_{n}": F.sum(e).over(_so_far(key)) for n, e in sums.items()})

    per_chunk = inside.groupBy(key, "_chunk").agg(
        *[F.max_by(f"_{n}", "id").alias(f"s_{n}") for n in sums],
        F.min(F.when(action, F.col("_total"))).alias("low"), F.max(F.when(reset, F.col("_pos"))).alias("at_reset"),
    )
    carried = per_chunk.withColumns(
        {f"o_{n}": F.coalesce(F.sum(f"s_{n}").over(_before(key)), F.lit(0)) for n in sums}
    ).select(
        key, "_chunk", *[f"o_{n}" for n in sums],
        F.min(F.col("o_total") + F.col("low")).over(_before(key)).alias("o_low"),
        F.max(F.col("o_pos") + F.col("at_reset")).over(_before(key)).alias("o_reset"),
    )

    zero = F.lit(0)
    local = inside.withColumns({
        "_low": F.min(F.when(action, F.col("_total"))).over(_so_far(key)),
        "_reset": F.max(F.when(reset, F.col("_pos"))).over(_so_far(key)),
    })
    final = {n: F.col(f"_{n}") + F.coalesce(f"o_{n}", zero) for n in sums}
    at_reset = F.greatest(zero, "o_reset", F.coalesce("o_pos", zero) + F.col("_reset"))
    return local.join(carried, [key, "_chunk"], "left").select(
        *ledger.columns,
        final["total"].alias("total"),
        F.least(zero, "o_low", F.coalesce("o_total", zero) + F.col("_low")).alias("lowest"),
        (final["pos"] - at_reset).alias("streak"),
        *[final[n].alias(n) for n in counters],
    )


def staircase(ledger: DataFrame, key: str = "player_id", bits: int = CHUNK_BITS) -> DataFrame:
    """``id, key, ts, total, prev_total`` of the entries that lift the key's total above all it had before within their chunk.

    An entry that is no step of its own key's chunk cannot be a record of the whole ledger, nor the first to reach a milestone. The
    ledger is read and shuffled once; sums, steps and openings all come from that exchange.
    """
    rows = with_chunks(ledger, bits).select("id", key, "ts", "points", "_chunk").repartition(key, "_chunk")
    before = Window.partitionBy(key, "_chunk").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_sum", F.sum("points").over(_so_far(key))).withColumn("_high", F.max("_sum").over(before))
    steps = inside.where(F.col("_high").isNull() | (F.col("_sum") > F.col("_high")))
    opening = rows.groupBy(key, "_chunk").agg(F.sum("points").alias("_s")).select(
        key, "_chunk", F.coalesce(F.sum("_s").over(_before(key)), F.lit(0)).alias("_open"))
    total = F.col("_sum") + F.col("_open")
    return steps.join(opening, [key, "_chunk"]).select("id", key, "ts", total.alias("total"), (total - F.col("points")).alias("prev_total"))


def running_record(totals: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Rows of ``totals`` whose ``total`` beats every earlier one in the whole ledger, with ``is_current``.

    The order is global, so the id range is cut for everyone. The summary has one row per chunk (a millionth of the ledger) and gives
    what a chunk's rows have to beat; only those that do are shuffled. ``totals`` is read twice and should be a stored table, of the
    steps of ``staircase`` or of all entries.
    """
    chunk = F.shiftright("id", bits)
    best = totals.groupBy(chunk.alias("_chunk")).agg(F.max("total").alias("_best"))
    order = Window.orderBy("_chunk")
    best = best.select("_chunk", F.max("_best").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev_best"),
                       F.max("_best").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_top"))
    # NULL: nothing came before, so the first entry is a record whatever its size
    rows = totals.withColumn("_chunk", chunk).join(best, "_chunk").where(
        F.col("_prev_best").isNull() | (F.col("total") > F.col("_prev_best")))
    before = Window.partitionBy("_chunk").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_beaten", F.max("total").over(before)).where(
        F.col("_beaten").isNull() | (F.col("total") > F.col("_beaten"))
    ).select(*totals.columns, (F.col("total") == F.col("_top")).alias("is_current"))


def ranked(rows: DataFrame, score: str, tiebreak: str, groups: Sequence[str] = (), name: str = "rank",
           buckets: int = 256, sample: int = 1024, bits: int = CHUNK_BITS) -> DataFrame:
    """Adds the rank by ``score`` descending, then by the unique BIGINT ``tiebreak`` ascending, within ``groups``.

    A group can be a third of all rows, so it is cut: at score quantiles, with a bucket of its own for a score that is itself a
    quantile, cut further by ``tiebreak``. Rank = rows in better buckets + row number in the bucket. The quantiles come
    from one row in ``sample`` chosen by hash and are approximate, in bounded memory; they only steer the balance, the ranks are exact with any of them.
    """
    groups = list(groups)
    points = [i / buckets for i in range(1, buckets)]
    cuts = rows.where(F.pmod(F.xxhash64(tiebreak), F.lit(sample)) == 0).agg(
        F.array_distinct(F.percentile_approx(score, points, 4096)).alias("c")).scalar()
    cut = rows.withColumn("_cuts", cuts)
    below = F.size(F.filter("_cuts", lambda c: c < F.col(score)))
    at_cut = F.exists("_cuts", lambda c: c == F.col(score))
    cut = cut.withColumns({
        "_bucket": F.when(F.col("_cuts").isNull(), 0).otherwise(2 * below + F.when(at_cut, 1).otherwise(0)),
        "_part": F.when(F.coalesce(at_cut, F.lit(False)), F.shiftright(tiebreak, bits)).otherwise(0),
    }).drop("_cuts")
    place = [*groups, "_bucket", "_part"]
    better = Window.partitionBy(*groups).orderBy(F.desc("_bucket"), "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).select(
        *place, F.coalesce(F.sum("_n").over(better), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*place).orderBy(F.desc(score), F.asc(tiebreak))
    return cut.withColumn("_row", F.row_number().over(inside)).join(offsets, place).select(
        *rows.columns, (F.col("_row") + F.col("_offset")).alias(name))


def top_per_group(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
                  name: str = "position") -> DataFrame:
    """The first ``k`` rows of every group, numbered.

    The plan has a WindowGroupLimit before the shuffle: each task passes on at most ``k`` rows of a group.
    """
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(
        F.col(name) <= k)
