"""Near-duplicates: MinHash bands find candidates, odd sketches thin them out, full shingle sets decide.

A document's set are its distinct shingles of five words (A-Z lower-cased). Two documents are linked if the intersection has at least 75
hundredths of the union. Classes are what links reach.

1. Equal sets become one node, named by a hash of the set. Each node has 320 MinHash samples: 64 bands of 5, and an odd sketch, a bitmap of 1024 parities
   over the samples (a pair at the bound shares no band with probability 3e-8).
2. In each bucket of a band the node that shares most buckets in all is the hub; every other node makes a pair with it only. The share of
   differing samples follows from the odd sketches' XOR population count; pairs that it puts far below the bound (six standard
   deviations) are dropped, the others confirmed on full sets. Links give classes.
3. Buckets whose nodes are in different classes are left. A node can be linked across classes only through shingles that another
   class has too; where even all of these would not reach the bound, the node is settled. What remains is compared
   pairwise, in blocks of a bounded number of nodes and shingles, on full sets. So no link between different texts is lost, and a large group of copies costs
   one pair per node and bucket.

Defined results: a text with fewer than five words has its whole sequence as the one shingle; an empty or null one has an empty set, is linked
with nothing and kept. Rows that share an id are one document, linked with whatever one of them is linked with. A row without id is a
class of its own: its ``component_id`` is null and it is kept. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix, pieces, removed, shingle_hashes, ship, stored, word_hashes, words_of

ship(__name__)

WIDTH, PERCENT = 5, 75
BANDS, ROWS, BITS = 64, 5, 1024
SAMPLES = BANDS * ROWS
BLOCK, BLOCK_SHINGLES = 192, 1 << 20


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. ``texts`` is a slice that ``pieces`` gave."""
    words = words_of(texts, lower=True)
    hashes = word_hashes(words)
    shingles, at = shingle_hashes(hashes, words.firsts, width)
    cuts = np.searchsorted(at, words.firsts)
    out = []
    for t, n in enumerate(words.counts.tolist()):
        if n >= width:
            out.append(np.unique(shingles[cuts[t]:cuts[t + 1]]))
        elif n:
            mine = hashes[words.firsts[t]:words.firsts[t + 1]]
            out.append(mix(np.array([mine @ np.arange(3, 2 * n + 3, 2, dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _families() -> tuple[np.ndarray, np.ndarray]:
    h = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
    return (h[:SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (h[SAMPLES:] >> np.uint64(32)).astype(np.uint32)


def samples(shingles: np.ndarray, factor: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(out, ((x[k:k + 512, None] ^ mask) * factor).min(0), out=out)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """One key per band; equal keys mean the same band with equal samples."""
    rows = sample.reshape(BANDS, ROWS).astype(np.uint64)
    factor = mix(np.arange(11, 11 + ROWS, dtype=np.uint64)) | np.uint64(1)
    return mix(mix((rows * factor).sum(1, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parities of the samples' places, as 64-bit words."""
    place = mix(sample.astype(np.uint64) | np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(32)) % np.uint64(BITS)
    odd = (np.bincount(place.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def named(shingles: np.ndarray) -> int:
    """A number for a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big", signed=True)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, bands, sketch of every row; the last three are null for empty sets. ``node`` names the set."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, mask = _families()
        for batch in batches:
            for first, piece in pieces(batch.column("text")):
                sizes, names, bands, sketches = [], [], [], []
                for s in shingle_sets(piece):
                    sizes.append(len(s))
                    if len(s):
                        sample = samples(s, factor, mask)
                        names.append(named(s))
                        bands.append(band_keys(sample))
                        sketches.append(odd_sketch(sample))
                    else:
                        for column in (names, bands, sketches):
                            column.append(None)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(piece)), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "node", "bands", "sketch"])
        give_back()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_shingles bigint, node bigint, bands array<bigint>, sketch array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """node and sorted set of every row that has a set."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, piece in pieces(batch.column("text")):
                sets = [s for s in shingle_sets(piece) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(map(named, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "set"])
        give_back()
    return docs.select("text").mapInArrow(rows, "node bigint, set array<bigint>")


def sets_of(docs: DataFrame, full: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and set, once, of each of ``nodes`` (node, doc_id: one of the documents that have it). ``full`` has a row per document with a set.

    Nearly all ids stand in one row; of the others all rows are looked at.
    """
    often = full.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    chosen = nodes.select("node", "doc_id")
    once = full_sets(docs.join(chosen.join(often, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi"))
    shared = chosen.join(often, "doc_id", "left_semi")
    more = full_sets(docs.join(shared.select("doc_id").distinct(), "doc_id", "left_semi")).join(shared.select("node"), "node", "left_semi")
    return once.union(more.groupBy("node").agg(F.first("set").alias("set")))


def likeness(a: str, b: str) -> Column:
    """Similarity that two odd sketches show: from n parities of which z differ, -n/2 ln(1 - 2z/n) places were hit by one side's samples."""
    differ = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    hit = -F.lit(BITS / 2) * F.log(F.greatest(F.lit(1e-3), 1 - F.lit(2 / BITS) * differ))
    return 1 - hit / (2 * SAMPLES)


def shared_size(a: str, b: str) -> Column:
    """Size of the intersection of two sets."""
    def batches(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in columns:
            yield pa.array([len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), True)) for x, y in zip(left, right)], pa.int64())
        give_back()
    batches.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "bigint").asNondeterministic()(F.col(a), F.col(b))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that can be reached from each node of ``links`` (a, b) but from those that are the smallest themselves.

    A node that has a smaller neighbour points to the least one; pointers are followed to their ends, links are drawn between
    these ends anew, and what is then a link of an end with itself is gone. Every step is a written table, and links get fewer with each.
    """
    spark = links.sparkSession

    def drawn(rows: DataFrame) -> DataFrame:
        return stored(rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    edges, names = drawn(links), stored(spark.createDataFrame([], "node bigint, label bigint"), "names")
    while not edges.isEmpty():
        label = stored(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "labels")
        while True:
            up = label.select(F.col("node").alias("_at"), F.col("label").alias("_up"))
            last, label = label, stored(label.select("node", "label").join(up, F.col("label") == F.col("_at"), "left").select(
                "node", F.coalesce("_up", "label").alias("label"), F.col("_up").isNotNull().alias("_moved")), "labels")
            removed(spark, last)
            if label.where("_moved").isEmpty():
                break
        ends, last, before = label.select("node", "label"), edges, names
        left = edges
        for side, other in (("a", "b"), ("b", "a")):
            end = ends.select(F.col("node").alias(side), F.col("label").alias("_end"))
            left = left.join(end, side, "left").select(F.coalesce("_end", side).alias(side), other)
        edges = drawn(left)
        end = ends.select(F.col("node").alias("label"), F.col("label").alias("_end"))
        names = stored(names.join(end, "label", "left").select("node", F.coalesce("_end", "label").alias("label")).union(ends), "names")
        for done in (label, last, before):
            removed(spark, done)
    removed(spark, edges)
    return names


def linked_in_block(percent: int):
    """Links between different labels among the nodes of one block, or of two."""
    def links(group: pa.Table) -> pa.Table:
        node, label, side = group["node"].to_pylist(), group["label"].to_pylist(), group["side"].to_pylist()
        sets = [s.values.to_numpy() for s in group["set"].combine_chunks()]
        parts: dict = {}
        for i, c in enumerate(group["cluster"].to_pylist()):
            parts.setdefault(c, []).append(i)
        a, b = [], []
        for mine in parts.values():
            flat, owner = np.concatenate([sets[i] for i in mine]), np.repeat(np.arange(len(mine)), [len(sets[i]) for i in mine])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            _, column = np.unique(flat, return_inverse=True)
            often = np.bincount(column)[column] > 1
            column, owner = np.unique(column[often], return_inverse=True)[1], owner[often]
            shared = np.zeros((len(mine), len(mine)), np.float32)
            for k in range(0, int(column.max()) + 1 if len(column) else 0, 8192):
                here = (column >= k) & (column < k + 8192)
                table = np.zeros((len(mine), 8192), np.float32)
                table[owner[here], column[here] - k] = 1
                shared += table @ table.T
            size = np.array([len(sets[i]) for i in mine])
            fits = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
            for i, j in zip(*np.nonzero(np.triu(fits, 1))):
                i, j = mine[i], mine[j]
                if label[i] != label[j] and (side[i] == 2 or side[i] != side[j]):
                    a.append(node[i])
                    b.append(node[j])
        del sets
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return links


def rest(shared: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links between nodes of different classes that a bucket brings together. ``shared`` has node, key and size."""
    spark = shared.sparkSession
    known = shared.join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))

    def mixed(rows: DataFrame, *more) -> DataFrame:
        keys = rows.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), *more).where("_low < _high").drop("_low", "_high")
        return rows.join(keys, "key")
    open_rows = stored(mixed(known, F.min("size").alias("least")), "open")
    nodes = open_rows.select("node", "label").distinct()
    words = nodes.join(sets, "node").select("node", "label", F.explode("set").alias("shingle"))
    common = words.groupBy("shingle").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("shingle")
    reach = words.join(common, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("reach"))
    # with r shingles that another class has too, and a partner of n words at least: r / (size + n - r) is the most there can be
    partner = F.greatest("least", F.ceil(F.col("size") * percent / 100))
    able = (100 + percent) * F.col("reach") >= percent * (F.col("size") + partner)
    left = stored(mixed(open_rows.join(reach, "node").where(able).select("key", "node", "label", "size")), "left")
    removed(spark, open_rows)

    stars = left.join(left.groupBy("key").agg(F.min("node").alias("b")), "key").select(F.col("node").alias("a"), "b").distinct()
    clusters = components(stars).withColumnRenamed("label", "cluster")
    nodes = left.select("node", "label", "size").distinct().join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    # a block has BLOCK nodes and BLOCK_SHINGLES shingles on average, or a single larger set
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    sizes = nodes.groupBy("cluster").agg(blocks.alias("blocks"))
    nodes = stored(nodes.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "blocks")
    removed(spark, left)
    small = nodes.where("blocks = 1").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    packs = 1 + max(small.n // BLOCK, small["size"] // BLOCK_SHINGLES)
    # every pair of blocks is a group; small clusters share groups
    nodes = nodes.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    nodes = nodes.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    nodes = nodes.withColumn("side", F.when(F.col("low") == F.col("high"), 2).otherwise((F.col("block") == F.col("high")).cast("int")))
    nodes = nodes.withColumn("pack", F.when(F.col("blocks") > 1, F.col("cluster").cast("string")).otherwise(F.concat(F.lit("p"), F.pmod(F.xxhash64("cluster"), F.lit(packs)).cast("string"))))
    rows = nodes.join(sets, "node").select("pack", "low", "high", "cluster", "side", "node", "label", "set")
    return rows.groupBy("pack", "low", "high").applyInArrow(linked_in_block(percent), "a bigint, b bigint")


def classes(docs: DataFrame, percent: int = PERCENT, margin: float = 0.17) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    signs = stored(signed(docs), "signs")
    full = signs.where("n_shingles > 0 and doc_id is not null")
    nodes = stored(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"),
                                            F.first("sketch").alias("sketch")), "nodes")
    buckets = nodes.select("node", "size", F.explode("bands").alias("key"))
    filled = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(buckets.join(filled, "key"), "shared")
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", F.col("node").alias("hub"))).alias("_hub"))
    pairs = shared.join(hubs.select("key", "_hub.hub"), "key").where("node <> hub").select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    met = nodes.join(weight.select("node"), "node", "left_semi")
    for side in ("a", "b"):
        pairs = pairs.join(met.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    pairs = pairs.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    pairs = stored(pairs.where(likeness("sketch_a", "sketch_b") >= percent / 100 - margin).select("a", "b", "size_a", "size_b"), "pairs")

    sets = stored(sets_of(docs, full, met), "sets")
    both = pairs
    for side in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")), side)
    both = both.withColumn("shared", shared_size("set_a", "set_b")).select("a", "b", "size_a", "size_b", "shared")
    links = stored(both.where(100 * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b") - F.col("shared"))).select("a", "b"), "links")
    label = components(links)
    more = stored(rest(shared, sets, label, percent), "rest")
    for done in (pairs, shared, sets, label):
        removed(spark, done)
    # rows of one id are one document, whatever sets they have
    ids = full.select("doc_id", "node").distinct()
    several = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_high")).where("a < _high").select("doc_id", "a")
    same = ids.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a < b")
    label = components(links.union(more).union(same))
    for done in (links, more):
        removed(spark, done)

    classed = ids.join(label, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    first = classed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    own = classed.distinct().join(first, "label").select("doc_id", "component_id")
    out = signs.select("doc_id", "n_shingles").join(own, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
