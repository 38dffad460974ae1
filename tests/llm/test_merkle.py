"""The manifest against a plain tree, over several passes and groups."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pointline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos string, tree string, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def beside(rows, at):
    for row in rows[:-1]:
        run = at // 8 * 8
        yield "".join(row[run:at]), "".join(row[at + 1:run + 8])
        at //= 8


def by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    root, out = top[-1][0], []
    for k, g in enumerate(names):
        for at, (_, _, own, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = [*beside(trees[g], at), *beside(top, k)]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            folded = leaf((*row[:4], lower(row[4]))) if changed else own
            for left, right in way:
                folded = sha(left + folded + right)
            out.append((row[0], own, trees[g][-1][0], root, sha("".join(a + b for a, b in way)), folded, folded == root))
    return sorted(out, key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA)
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))
    out = merkle.manifest(docs, claimed={"text": claimed}, **more).withColumn("proof", F.sha2("proof", 256))
    return sorted((tuple(r) for r in out.collect()), key=str)


ODD = [(1, None, None, None, None), (2, "", "", 0, ""), (None, "s", "en", 5, "No Id"), (None, None, None, None, None), (3, "é", "日本", 2, "ÀB"), (3, "é", "日本", 2, "ÀB"),
       (3, "é", "日本", 2, "other"), (2**62, "s", "en", 3, "x" * 100_000 + "Y"), (-5, "s", "-", 1, "Q")]


def test_odd_rows(spark):
    assert run(spark, ODD) == by_hand(ODD)
    assert run(spark, ODD[:1]) == by_hand(ODD[:1])  # one leaf is subroot and root


@pytest.mark.parametrize("size", [8, 9, 64, 65, 513, 4097])
def test_sizes(spark, size):
    rows = [(i * 7 % size, f"s{i % 3}", "en" if i % 9 else ["de", None][i % 2], i, f"Text {i}") for i in range(size)] + ODD
    assert run(spark, rows, per_part=200) == by_hand(rows)


def test_many_groups_and_alike_rows(spark):
    """More groups than a chunk holds; a third of the rows are alike."""
    rows = [(i, "s", f"g{i % 700}", i, "T") for i in range(1400)] + [(5, "s", "g5", 1, "Copy")] * 700
    got = run(spark, rows, per_part=100)
    assert got == by_hand(rows)


def test_what_is_claimed_decides(spark):
    rows = spark.createDataFrame([(i, "s", "en", 1, f"T{i}") for i in range(30)], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(rows).where(~F.col("verified")).count() == 0
    claimed = F.when(F.col("doc_id") == 4, F.lit("forged")).otherwise(F.col("text"))
    assert [r.doc_id for r in merkle.manifest(rows, claimed={"text": claimed}).where(~F.col("verified")).collect()] == [4]


def test_chunk_keeps_states():
    chunk = merkle.Chunk([sha(str(i)) for i in range(100)], 100)
    assert [len(s) for s in chunk.states[0]] == [8] * 12 + [4]
    lefts, rights = chunk.siblings(57)
    assert chunk.folded(57, sha("57"), rights) == chunk.top != chunk.folded(57, sha("58"), rights)
