"""Ranked search against plain Python over all documents."""

import collections
import math
import re

import numpy as np
import pytest

from pointline.llm import search
from tests.llm.test_queries import documents, prose

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return collections.Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def by_hand(docs, items, k=10):
    posted = [(d, terms(t)) for d, t in docs]
    posted = [(d, c) for d, c in posted if c]
    n, length = len(posted), sum(sum(c.values()) for _, c in posted)
    df = collections.Counter(t for _, c in posted for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in posted:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, times in terms(text).items() if t in c)
            if score > 0:
                found.append((-score, d is None, d, score))
        out += [(item, rank, d, score) for rank, (_, _, d, score) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(0, prose(1, 300)[:200]), (1, None), (2, ""), (3, "same"), (4, "nowhere at all zzz"), (5, prose(999, 60)), (6, "Jörg É日本 4111 jörg"), (6, "line LINE a"),
         (None, prose(5, 20)), (7, "### *** |||"), (8, "lorem0 " * 50)]


def run(spark, docs, items, **more):
    a = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, query string, n int")
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, rank string")
    return sorted((tuple(r) for r in search.search(a, b, **more).collect()), key=str)


def test_against_plain_python(spark):
    docs = documents()
    assert run(spark, docs, ITEMS) == by_hand(docs, ITEMS)
    assert run(spark, docs, ITEMS, k=1) == by_hand(docs, ITEMS, 1)


def test_copies_ties_and_rows_of_one_id(spark):
    docs = [(i, prose(i % 3, 40)) for i in range(400)] + [(7, prose(1, 40))] * 30 + [(None, prose(1, 40))] * 3
    items = [(0, prose(1, 40)), (1, prose(2, 10)), (2, prose(0, 40) + " " + prose(7, 30))]
    assert run(spark, docs, items) == by_hand(docs, items)


@pytest.mark.parametrize("crowded", [False, True])
def test_blocks_collisions_and_plain_join(spark, monkeypatch, crowded):
    """Many blocks give what one gives; terms that share coordinates and candidates that are not broadcast change nothing."""
    monkeypatch.setattr(search, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    if crowded:  # all terms in a few coordinates: bounds are loose, the result is the same
        monkeypatch.setattr(search, "coordinate", lambda hashes: (hashes >> np.uint64(62)).astype(np.int64))
    docs = documents()
    assert run(spark, docs, ITEMS) == by_hand(docs, ITEMS)


def test_bounds_hold():
    docs = [t for _, t in documents() if t]
    import pyarrow as pa

    texts = pa.array(docs, pa.large_string())
    hashes, firsts = search.terms_of(texts)
    text, found, tf = search.counted(hashes, firsts)
    sketches = search.sketched(text, found, tf, len(texts))
    queries = [(k, collections.Counter(search.terms_of(pa.array([prose(k, 30)], pa.large_string()))[0].tolist())) for k in range(20)]
    block = search.Block(queries, collections.Counter(found.tolist()), len(docs), len(hashes))
    bounds = block.bounds(np.diff(firsts), sketches, block.lookup())
    scores = np.array(block.scores(texts, [np.arange(20)] * len(docs)))
    assert (bounds >= scores).all() and (bounds <= scores * 1.01 + 1)[:, :].mean() > 0.9


def test_empty(spark):
    docs, items = documents(), ITEMS
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None), (2, "...")], items) == []
