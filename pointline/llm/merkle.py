"""A Merkle manifest of a table: one tree of SHA-256 digests per group, and one over the groups' roots.

Every ``FANOUT`` consecutive nodes (the last run may be shorter) have a parent, the digest of their digests as text. A parent keeps
a copy of its hash state before each child slot; a changed child is folded upwards by resuming the state of its slot with the new
digest and the siblings to its right, so what stands to its left is never hashed again.

Nodes are numbered within their tree by ranges of the order, written once, and worked off in chunks of ``FANOUT ** DEEP``: one
chunk is a row, whose top is a node of the next pass. On the way down each chunk gives its nodes the siblings above them. A pass
shuffles one row per chunk of the pass before; no task sees more of a tree than a chunk, however large a group is.

Defined results: a null field is ``-``, an empty text ``0:``; rows without key come first in their group, rows without group form
the first tree; rows with the same key stand by their leaf, rows alike in all fields each have a leaf of their own. An empty table
gives no rows. Columns that are not among the fields play no part.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import removed, ship, stored

ship(__name__)

FANOUT = 8
DEEP = 3
CHUNK = FANOUT**DEEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = "leaf string, subroot string, root string, proof string, folded_root string"


def digest(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each with its length before it."""
    said = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def depth(n: int) -> int:
    """Levels above ``n`` nodes."""
    return next(k for k in itertools.count() if FANOUT**k >= n)


class Chunk:
    """A subtree over some nodes: its rows of digests and, for each parent, the hash states before its slots."""

    def __init__(self, nodes: list[str], of: int):
        self.rows, self.states = [nodes], []
        for _ in range(min(DEEP, depth(of))):
            row, parents, states = self.rows[-1], [], []
            for at in range(0, len(row), FANOUT):
                state, before = hashlib.sha256(), []
                for child in row[at:at + FANOUT]:
                    before.append(state.copy())
                    state.update(child.encode())
                parents.append(state.hexdigest())
                states.append(before)
            self.rows.append(parents)
            self.states.append(states)

    @property
    def top(self) -> str:
        return self.rows[-1][0]

    def siblings(self, at: int) -> tuple[list[str], list[str]]:
        """What stands left and right of a node and of each node above it, from the lowest level up."""
        lefts, rights = [], []
        for row in self.rows[:-1]:
            run = at // FANOUT * FANOUT
            lefts.append("".join(row[run:at]))
            rights.append("".join(row[at + 1:run + FANOUT]))
            at //= FANOUT
        return lefts, rights

    def folded(self, at: int, digest: str, rights: list[str]) -> str:
        """The top if the node at that place had that digest."""
        for states, right in zip(self.states, rights):
            state = states[at // FANOUT][at % FANOUT].copy()
            state.update(digest.encode() + right.encode())
            digest, at = state.hexdigest(), at // FANOUT
        return digest


def top() -> Column:
    """The top of a chunk of ``nodes``, of a tree with ``n`` nodes on that level."""
    def tops(nodes: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([Chunk(x, k).top for x, k in zip(nodes.to_pylist(), n.to_pylist())], pa.string())
    tops.__annotations__ = {"nodes": pa.Array, "n": pa.Array, "return": pa.Array}
    return F.arrow_udf(tops, "string")("nodes", "n")


def paths_below() -> Column:
    """For each node of a chunk all that stands beside its way to the root: in the chunk, then above it."""
    kind = pa.list_(pa.struct([("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))]))

    def paths(nodes: pa.Array, n: pa.Array, lefts: pa.Array, rights: pa.Array) -> pa.Array:
        out = []
        for x, k, left, right in zip(nodes.to_pylist(), n.to_pylist(), lefts.to_pylist(), rights.to_pylist()):
            chunk = Chunk(x, k)
            found = map(chunk.siblings, range(len(x)))
            out.append([{"lefts": a + left, "rights": b + right} for a, b in found])
        return pa.array(out, kind)
    paths.__annotations__ = {"nodes": pa.Array, "n": pa.Array, "lefts": pa.Array, "rights": pa.Array, "return": pa.Array}
    return F.arrow_udf(paths, "array<struct<lefts:array<string>,rights:array<string>>>")("nodes", "n", "lefts", "rights")


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per leaf: its siblings up to the root, and the root that its claimed leaf gives. One chunk is in hand at a time."""
    for batch in batches:
        for k in range(len(batch)):
            row = {name: batch.column(name)[k].as_py() for name in ("nodes", "claims", "n", "lefts", "rights", "subroot", "root")}
            chunk = Chunk(row["nodes"], row["n"])
            above = list(zip([hashlib.sha256(x.encode()) for x in row["lefts"]], [x.encode() for x in row["rights"]]))
            beside = "".join(a + b for a, b in zip(row["lefts"], row["rights"]))
            proofs, roots, known = [], [], {}
            for at, leaf in enumerate(row["nodes"]):
                lefts, rights = chunk.siblings(at)
                proofs.append("".join(a + b for a, b in zip(lefts, rights)) + beside)
                digest = folded = chunk.folded(at, row["claims"][at] or leaf, rights)
                if digest not in known:
                    for left, right in above:
                        state = left.copy()
                        state.update(folded.encode() + right)
                        folded = state.hexdigest()
                    known[digest] = folded
                roots.append(known[digest])
            size = len(proofs)
            keys = batch.column("keys")[k].values
            yield pa.RecordBatch.from_arrays(
                [keys, *(pa.array(x, pa.string()) for x in (row["nodes"], [row["subroot"]] * size, [row["root"]] * size, proofs, roots))],
                ["key", "leaf", "subroot", "root", "proof", "folded_root"])


def numbered(rows: DataFrame, order: list[str], per_part: int) -> DataFrame:
    """The place ``pos`` of each row in its ``tree`` and the tree's size ``n``. ``rows`` comes from ``stored`` and is deleted: the place
    in a file tells rows apart that are alike, so even those are dealt out over tasks."""
    parts = 1 + rows.count() // per_part
    ends = ["tree", *order, "_row"]
    placed = rows.withColumn("_row", F.struct("_metadata.file_name", "_metadata.row_index")).repartitionByRange(parts, *ends).sortWithinPartitions(*ends)
    placed = stored(placed.drop("_row").withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.expr("_id >> 33")), "merkle-order")
    runs = placed.groupBy("tree", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_size"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(tree).alias("n"))
    removed(rows.sparkSession, rows)
    return placed.join(runs, ["tree", "_part"]).withColumn("pos", F.expr("_before + _id - _first")).drop("_id", "_part", "_first", "_before")


def climbed(nodes: DataFrame, **more: Column) -> tuple[list[DataFrame], DataFrame | None]:
    """The chunks of each pass (tree, pos, n, nodes, top), lowest first, and the root of each tree with the pass that made it. ``more`` are
    values of the lowest nodes that their chunk keeps, in the same order."""
    passes, roots = [], None
    while True:
        held = F.struct("pos", F.col("digest").alias("nodes"), *(c.alias(name) for name, c in more.items()))
        chunks = nodes.groupBy("tree", F.expr(f"pos div {CHUNK}").alias("chunk"), "n").agg(F.sort_array(F.collect_list(held)).alias("_held"))  # at most CHUNK rows
        chunks = chunks.select("tree", F.col("chunk").alias("pos"), "n", *(F.col(f"_held.{name}").alias(name) for name in ("nodes", *more)))
        passes.append(stored(chunks.withColumn("top", top()), "merkle-chunks"))
        done = passes[-1].where(F.col("n") <= CHUNK).select("tree", F.col("top").alias("digest"), F.lit(len(passes) - 1).alias("at"))
        roots = done if roots is None else roots.union(done)
        more = {}
        left = passes[-1].where(F.col("n") > CHUNK)
        if left.isEmpty():
            return passes, roots
        nodes = left.select("tree", "pos", F.expr(f"(n + {CHUNK - 1}) div {CHUNK}").alias("n"), F.col("top").alias("digest"))


def descended(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths (tree, pos, lefts, rights and what else the rows have) of the nodes in the chunks whose own paths are given."""
    below = chunks.drop("top").join(paths, ["tree", "pos"]).withColumn("_paths", paths_below())
    rest = [c for c in paths.columns if c not in ("tree", "pos", "lefts", "rights")]
    below = below.select("tree", "pos", *rest, F.posexplode("_paths").alias("_at", "_path"))
    return below.select("tree", F.expr(f"pos * {CHUNK} + _at").alias("pos"), "_path.lefts", "_path.rights", *rest)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", claimed: dict[str, Column] | None = None,
             per_part: int = 1 << 17) -> DataFrame:
    """key, leaf, subroot, root, ``proof`` (all siblings on the way to the root, as one text), folded_root and verified for each row.

    ``claimed`` gives other values of some fields, whose leaf is folded with the original siblings; a null value of a ``when`` without
    ``otherwise`` would be a null field, so such expressions name the original too. ``verified`` tells whether the result is the root.
    """
    claimed = claimed or {}
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"),
                       digest([F.col(f) for f in fields]).alias("digest"), digest([claimed.get(f, F.col(f)) for f in fields]).alias("claim"))
    rows = stored(rows.withColumn("claim", F.expr("nullif(claim, digest)")), "merkle-leaves")
    leaves = numbered(rows, ["key", "digest", "claim"], per_part)
    low, subroots = climbed(leaves, claims=F.col("claim"), keys=F.col("key"))
    removed(docs.sparkSession, leaves)
    high_nodes = stored(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest", "at"), "merkle-roots")
    high_nodes = numbered(high_nodes, ["group"], per_part)
    high, root = climbed(high_nodes)

    none = F.expr("cast(array() as array<string>)")
    start = root.select("tree", F.lit(0).cast("long").alias("pos"), F.col("digest").alias("root"), "at", none.alias("lefts"), none.alias("rights"))
    paths = start
    for chunks in reversed(high):  # one tree
        paths = descended(chunks, paths)
    groups = high_nodes.join(paths.drop("at"), ["tree", "pos"])
    groups = stored(groups.select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("pos"), "at", F.col("digest").alias("subroot"), "root", "lefts", "rights"), "merkle-paths")
    paths = groups.where(F.col("at") == len(low) - 1)
    for at in reversed(range(1, len(low))):
        paths = descended(low[at], paths).unionByName(groups.where(F.col("at") == at - 1))
    kind = docs.schema[key].dataType.simpleString()
    out = low[0].drop("top").join(paths.drop("at"), ["tree", "pos"]).mapInArrow(fold, f"key {kind}, {FOLDED}")
    return out.withColumnRenamed("key", key).withColumn("verified", F.col("folded_root") == F.col("root"))
