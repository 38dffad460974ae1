"""What is learned from labelled rows: the sample, held-out quality, and secrets of every alphabet against ordinary identifiers."""

import os
import random
import warnings
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointline.llm import common, quality_net, quality_rules, secrets
from pointline.llm.queries import QUERIES
from tests.llm.test_queries import prose

TABLES = "/root/testdata/sf0.01"


def sizes(texts: pa.Array) -> list[bytes]:
    return [str(len(t)).encode() for t in texts.to_pylist()]


def test_sample(spark):
    """The first ids by hash that have a text, however long; one text of an id with hundreds of rows; two equal rows count once."""
    rows = [(k, prose(k, 20) + "x" * k) for k in range(390)] + [(390, "y" * 5_000_000), (391, "z" * 5_000_001)]
    docs = spark.createDataFrame([*rows, *[(2, f"{rows[2][1]} {k}") for k in range(300)], rows[3], (5, None), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 4 // 2) for k in range(500)] + [(7, 1), (8, None), (None, 1)], "doc_id long, quality int")
    order = [r.doc_id for r in labels.where("doc_id < 392").where(common.learnable()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    got = common.labelled_features(docs, labels, 60, sizes)
    assert len(got) == 60 and all(int(n) == len(rows[d][1]) and y == max(d % 4 // 2, d == 7) for d, (n, y) in zip(order, got) if d != 2)
    got = common.labelled_features(docs, labels, 1000, sizes)
    assert len(got) == len(order) and {b"5000000", b"5000001"} & {n for n, _ in got} == {str(len(rows[d][1])).encode() for d in (390, 391) if d in order}
    assert common.labelled_features(docs, labels.limit(0), 10, sizes) == [] == common.labelled_features(docs.limit(0), labels, 10, sizes)


@pytest.mark.parametrize("module", [quality_rules, quality_net, secrets])
def test_long_labelled_texts(spark, module):
    """Texts of megabytes are neither refused nor passed over."""
    texts = [" ".join(prose(k, 40).split() * 4000) if k % 2 else "### *** " * 100_000 + prose(k, 5) for k in range(26)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(26)], "doc_id long, quality int")
    chosen = common.labelled_rows(docs, labels, 100)
    assert chosen.count() >= 20 and module.trained(docs, labels) is not None


def test_no_model_is_reported(spark):
    docs = spark.createDataFrame([(k, prose(k, 40)) for k in range(60)], "doc_id long, text string")
    with pytest.warns(RuntimeWarning, match="no model"):
        assert quality_rules.trained(docs, spark.createDataFrame([(k, 1) for k in range(60)], "doc_id long, quality int")) is None


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables not present")
@pytest.mark.parametrize("name, column", [("op5_quality_net", "score"), ("op9_quality_rules", "probability")])
def test_held_out(spark, name, column):
    """Area under the curve on rows that were not learned from."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    held = {r.doc_id: r[column] for r in QUERIES[name](spark, TABLES).collect() if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    good, bad = (np.array([s for d, s in held.items() if labels[d] == y]) for y in (1, 0))
    assert len(good) > 40 and len(bad) > 5 and ((good[:, None] > bad) + 0.5 * (good[:, None] == bad)).mean() > 0.97


def test_context_vectors_are_sums_over_all_documents(spark):
    """Against plain sums; a word in the same surroundings has a like vector, whatever its letters."""
    texts = [f"{a} {b} {c}" for a in ("north", "south") for b in ("qqxyzzy", "mnopqrs") for c in ("wind", "rain", "snow")] * 3 + ["qqxyzzy alone", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    vocabulary = quality_net.frequent_words(docs, 100)
    vectors = quality_net.contexts(docs, vocabulary)

    def word(w):
        return common.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]
    assert set(vocabulary) == {word(w) for w in "north south qqxyzzy mnopqrs wind rain snow alone".split()}
    for w in ("wind", "qqxyzzy"):
        total = np.zeros(quality_net.WIDTH)
        for t in filter(None, texts):
            said = t.split()
            for i, a in enumerate(said):
                if a == w:
                    around = [said[j] for j in range(max(0, i - 2), min(len(said), i + 3)) if j != i]
                    total += quality_net.index_vectors(np.array([word(x) for x in around], np.uint64)).sum(0)
        own = quality_net.index_vectors(np.array([word(w)], np.uint64))[0]
        assert np.allclose(vectors[np.searchsorted(vocabulary, word(w))], (own + total / np.linalg.norm(total) * 2) / 2, atol=1e-4)
    assert set(quality_net.frequent_words(docs, 1)) == {word("qqxyzzy")} and len(quality_net.frequent_words(docs.limit(0), 5)) == 0


ORDINARY = ["/usr/local/lib/python3", "13/site-packages/numpy", "2024-01-05_build-1234_release-notes-final", "org/a/b/c/12345/photo_2021_03_04_large",
            "my-first-blog-post-about-cats", "InternationalizationConfiguration", "src/main/java/com/example/app/Handler", "550e8400-e29b-41d4-a716-446655440000",
            "getElementsByClassName", "node_modules/react-dom/cjs/react-dom", "1234567890123456", "================", "2024/03/15/weekly-report-summary",
            "v2-14-alpha3-linux-x86", "assets/images/header-large-2x", "user_profile_settings_page", "jan-2021-monthly-newsletter"]


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{name}.parquet") for name in ("documents", "labels"))
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        return secrets.trained(docs.select("doc_id", "text"), labels)


def found(model, text):
    return [text[s["start"]:s["end"]] for s in secrets.spans_of(text, True, model, 16, 9.0, 0.4) if s["kind"] == "model"]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables not present")
def test_drawn_keys_and_identifiers(model):
    letters, draw = secrets.LETTERS, random.Random(4)
    for alphabet in ("0123456789abcdef", "0123456789ABCDEF", letters[:62], letters[:64], letters[:26] + "234567", letters[:62] + "_-", letters[26:62],
                     letters[:52], letters[26:52], letters[:26]):
        for size in (16, 20, 23):
            keys = ["".join(draw.choice(alphabet) for _ in range(size)) for _ in range(300)]
            assert sum(bool(found(model, f"key {k} z")) for k in keys) >= (0.87 if len(alphabet) == 16 and size == 16 else 0.9) * 300, (alphabet, size)
    assert [t for t in ORDINARY if found(model, t)] == []
    assert found(model, "see /etc/app/9f8Gh2Kq0ZxP7vLm3TnB and url=Zx8Kq2mVt9LrB4nQw7Yp") == ["/etc/app/9f8Gh2Kq0ZxP7vLm3TnB", "url=Zx8Kq2mVt9LrB4nQw7Yp"] or found(
        model, "see /etc/app/9f8Gh2Kq0ZxP7vLm3TnB and url=Zx8Kq2mVt9LrB4nQw7Yp") == ["9f8Gh2Kq0ZxP7vLm3TnB", "Zx8Kq2mVt9LrB4nQw7Yp"]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables not present")
def test_query_finds_what_no_pattern_does(spark, tmp_path):
    """The query itself, over documents with keys that only the model can know."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{name}.parquet") for name in ("documents", "labels"))
    key = "Zx8Kq2mVt9LrB4nQw7Yp"
    more = spark.createDataFrame([(10**6, f"é the key is {key}.", "en", "s", 5), (10**6 + 1, None, None, None, None)], docs.schema)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        got = {r.doc_id: r for r in QUERIES["op3_secrets"](spark, str(tmp_path)).where("doc_id >= 1000000").collect()}
    assert got[10**6].spans == f"model:13:{13 + len(key)}" and got[10**6].n_assign == 0 and got[10**6 + 1].spans == ""
