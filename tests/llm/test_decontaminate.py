"""Decontamination: long repetitive texts, passages at every place of a window, an exhaustive alignment, text ids, clashing names."""

import resource
import time

import numpy as np
import pyarrow as pa
import pytest

from pointline.llm import decontaminate
from tests.llm.test_queries import ITEM, prose


def looked(items, texts, **more):
    index = decontaminate.index_of(items, 60, 4, 10)
    table = np.zeros(1 << decontaminate.TABLE_BITS, bool)
    table[(index.codes >> np.uint64(64 - decontaminate.TABLE_BITS)).astype(np.int64)] = True
    return decontaminate.leaks_of(index, pa.array(texts, pa.large_string()), table)


@pytest.mark.parametrize("unit", ["=", "ab", "- * "])
def test_separator_lines_cost_no_memory(unit):
    item = "answer: " + unit * (400 // len(unit))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.monotonic()
    found = looked([(1, item), (2, ITEM)], ["line\n" + unit * (200_000 // len(unit)) + " end", unit * (30 // len(unit)), "clean " + prose(3, 200)])
    assert [[r["item_id"] for r in f] for f in found] == [[1], [], []]
    assert found[0][0]["start"] <= 10 and found[0][0]["end"] >= 200_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600 << 10 and time.monotonic() - began < 10


def test_every_place_of_a_window():
    """A verbatim part of 60 bytes is found wherever windows are cut."""
    part = ITEM[7:67]
    places = [*range(decontaminate.WINDOW - decontaminate.OVERLAP - 70, decontaminate.WINDOW - decontaminate.OVERLAP + 10), *range(decontaminate.WINDOW - 70, decontaminate.WINDOW + 10)]
    filler = prose(8, 1500)
    texts = [filler[:k] + "|" + part + "|" + filler[k:] for k in places]
    for k, found in zip(places, looked([(1, ITEM)], texts)):
        assert found and found[0]["start"] <= k + 1 and found[0]["end"] >= k + 1 + len(part) - 4, k


def distance(segment: bytes, text: bytes) -> int:
    """Least edit distance of a segment to any part of a text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(segment, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_against_exhaustive_alignment():
    """Whole segments within the edit budget, by aligning each with each text, are found and nothing else that has no short ones."""
    draw = np.random.default_rng(5)
    index = decontaminate.index_of([(1, ITEM)], 60, 4, 10)
    whole = [bytes(index.bytes[s][:index.sizes[s]]) for s in range(len(index.sizes)) if index.sizes[s] == 60]
    texts = []
    for k in range(60):
        letters = list(ITEM[k % 30:k % 30 + 75])
        for _ in range(k % 9):
            at = int(draw.integers(len(letters)))
            letters[at:at + 1] = [["x", "xy", ""][int(draw.integers(3))]]
        texts.append(prose(k, 15) + " " + "".join(letters) + " " + prose(k + 99, 15))
    for text, found in zip(texts, looked([(1, ITEM)], texts)):
        data = np.frombuffer(text.encode(), np.uint8)
        data = bytes(decontaminate.folded(data, np.array([0, len(data)]))[0])
        if any(distance(s, data) <= 4 for s in whole):
            assert found
        elif found:  # joined short segments: each is within its own budget
            assert min(distance(bytes(index.bytes[s][:index.sizes[s]]), data) for s in range(len(index.sizes)) if index.sizes[s] < 60) <= 2


def test_text_ids_blocks_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM, "a", "b"), (1, prose(3, 90), "a", "b"), (None, None, "c", None), (2, "", None, None), (3, ITEM.upper() * 3, "d", "e")],
                                 "doc_id long, text string, _leaks0 string, _text string")
    bench = spark.createDataFrame([("q1", ITEM), (None, ITEM), ("q2", None), ("q3", prose(77, 200))], "item_id string, text string")
    for block in (1 << 20, 800):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs, bench, block).collect()} == {(1, "q1"), (3, "q1")}
        kept = decontaminate.clean(docs, bench, block)
        assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.where("text is null or text not like '%enchmark%' and text not like '%BENCHMARK%'").collect()))
    assert decontaminate.clean(docs, bench.limit(0)).count() == 5 and decontaminate.contaminations(docs.limit(0), bench).count() == 0
