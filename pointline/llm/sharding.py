"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard has ``nodes`` points on a ring; a row stands on the ring by the hash of its id. An arc is what lies before a point, and
belongs to the point's shard. A shard takes rows up to its capacity; what finds it full goes on clockwise to the next point of a
shard with room. Arcs are cut at sums of loads, so the whole course follows from one sum per arc: these (shards x nodes numbers,
whatever the input) are the only rows that the driver sees. Sums before a row are taken in two steps, over cells of an arc and
within a cell, so no task sorts more than a cell; the number of cells grows with the rows.

Law ``rows``: a row's load is 1 and the capacities add up to the number of rows, so counts are at most one apart, always. Law
``bytes``: the load is the size and the capacity ``1 + slack`` times the even share; sizes are near equal, but for one row per
cut. Copies of a text spread like other rows, as a third of all rows may be copies.

Defined results: a null text has size 8 and the CRC of no bytes; rows without id are placed by their text. Rows alike in everything
may change places with each other. An empty table gives an empty result. ``slot`` numbers the rows of a shard from 0 without
gaps, in ring order. ``grown_shard`` is null, as the law is not ``key``.
"""

from __future__ import annotations

import hashlib
import itertools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

RING = 1 << 62


def points(shards: int, nodes: int) -> list[tuple[int, int]]:
    """Places of the virtual nodes in ring order with their shards. The points of a shard don't depend on how many shards there are."""
    place = {int.from_bytes(hashlib.blake2b(f"{s}:{n}".encode(), digest_size=8).digest(), "big") % RING: s for s in range(shards) for n in range(nodes)}
    return sorted(place.items())


def course(loads: list[int], owner: list[int], shards: int, slack: float) -> list[tuple[int, int, int]]:
    """Cuts (arc, begin, shard): what an arc holds from that load on to its next cut goes to the shard.

    Points are served clockwise, first each its own arc, then what is still waiting, point after point, until nothing waits.
    """
    total = sum(loads)
    room = [(total + shards - 1 - s) // shards + math.ceil(total / shards * slack) for s in range(shards)]
    cuts, waiting, n = [], [(a, 0, x) for a, x in enumerate(loads) if x], len(loads)
    step = 0
    while waiting:
        later = []
        for arc, begin, left in waiting:
            shard = owner[(arc + step) % n]
            taken = int(min(left, room[shard]))
            if taken:
                cuts.append((arc, begin, shard))
                room[shard] -= taken
            if left > taken:
                later.append((arc, begin + taken, left - taken))
        waiting, step = later, step + 1
    return sorted(cuts)


def arc_table(spark: SparkSession, ring: list[tuple[int, int]], slices: int) -> DataFrame:
    """The arcs that meet each of ``slices`` equal parts of the ring. Its size depends on the ring alone."""
    lows = [0] + [p + 1 for p, _ in ring]
    arcs = [(a, lows[a], p) for a, (p, _) in enumerate(ring)] + [(0, lows[-1], RING - 1)]
    width = RING // slices
    frame = spark.createDataFrame(arcs, "_arc int, _low long, _high long")
    return frame.withColumn("_slice", F.explode(F.expr(f"sequence(_low div {width}, _high div {width})")))


def sharded(docs: DataFrame, shards: int = 24, nodes: int = 64, law: str = "rows", slack: float = 0.0, per_cell: int = 20_000, slices: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text)."""
    spark, ring = docs.sparkSession, points(shards, nodes)
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
                       F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.lit("text"), "text_crc32", "size"))
    rows = rows.withColumn("_place", F.pmod(F.xxhash64(name), F.lit(RING))).withColumn("_slice", F.expr(f"_place div {RING // slices}"))
    rows = rows.join(F.broadcast(arc_table(spark, ring, slices)), "_slice").where("_place between _low and _high")
    rows = stored(rows.select("doc_id", "size", "text_crc32", "_place", "_arc"), "ring")
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    load = F.lit(1).cast("long") if law == "rows" else F.col("size")

    sums = rows.groupBy("_arc").agg(F.sum(load).alias("load"), F.count("*").alias("n")).collect()  # a row per point of the ring
    loads = [0] * len(ring)
    for r in sums:
        loads[r._arc] = r.load
    cells = 1 + sum(r.n for r in sums) // per_cell
    cuts = [(a, [(b, s) for _, b, s in group]) for a, group in itertools.groupby(course(loads, [s for _, s in ring], shards, slack), lambda c: c[0])]
    cuts = spark.createDataFrame(cuts, "_arc int, _cuts array<struct<begin:long,shard:int>>")

    rows = rows.withColumn("_cell", F.expr(f"_place div {RING // cells + 1}"))
    before = Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_arc", "_cell").agg(F.sum(load).alias("_load")).select("_arc", "_cell", F.coalesce(F.sum("_load").over(before), F.lit(0)).alias("_offset"))
    order = ("_place", "doc_id", "text_crc32", "size")
    within = Window.partitionBy("_arc", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(offsets, ["_arc", "_cell"]).withColumn("_begin", F.col("_offset") + F.sum(load).over(within) - load)
    rows = rows.join(F.broadcast(cuts), "_arc")  # a row per point of the ring
    rows = rows.withColumn("shard", F.expr("element_at(filter(_cuts, c -> c.begin <= _begin), -1).shard"))
    rows = stored(rows.select("doc_id", "size", "text_crc32", "_place", "_arc", "_cell", "shard"), "shards")

    earlier = Window.partitionBy("shard").orderBy("_arc", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_arc", "_cell").agg(F.count("*").alias("_n")).select("shard", "_arc", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("shard", "_arc", "_cell").orderBy(*order)) - 1
    return rows.join(starts, ["shard", "_arc", "_cell"]).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("_start") + nth).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
