"""SentencePiece against the library: hand-made, random and whole texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pointline.llm import sentence_pieces
from pointline.llm.queries import QUERIES, model
from tests.llm.test_queries import documents, write

ALPHABETS = ["abcde", "etaoin shrdlu  ", "▁ ▁▁a", "=-*#/ ", "日本語かな é½²\x85́😀", "\t\n\r\x00 ab", "the and ing ion", " "]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model())


@pytest.fixture(scope="module")
def own():
    return sentence_pieces.Pieces(model())


def texts():
    draw = random.Random(7)
    yield from ["", " ", "a", "  ", "▁", "x" * 3000, " " * 5000, "=" * 5000, "aab" * 777, "<s>hi</s> <0x41>", "\x00", "a" * 15 + " " * 40 + "b"]
    yield "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))  # beyond the rounds: goes on by heap
    for _ in range(1500):
        letters = "".join(draw.choice(ALPHABETS) for _ in range(draw.randint(1, 3)))
        yield "".join(draw.choice(letters) for _ in range(draw.choice([3, 10, 60, 300])))


def test_encode_and_decode(own, library):
    every = list(texts())
    for text, ids in zip(every, own.encode(every)):
        assert ids.tolist() == library.encode(text), text[:50]
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())


def test_decode_any_ids(own, library):
    draw = random.Random(3)
    for _ in range(5000):
        ids = [draw.choice([0, 1, 2, draw.randint(3, 258), draw.randint(3, 258), 259, 264, draw.randint(259, own.size - 1)]) for _ in range(draw.randint(1, 7))]
        assert own.decode(ids) == library.decode(ids), ids
    assert own.decode([-1, 10**6, 264]) == own.decode([264])


def test_words_are_remembered_up_to_a_bound(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED_BYTES", 500)
    own = sentence_pieces.Pieces(model())
    for k in range(30):
        text = f"number {k} of some words {k * k} " + "y" * 100
        assert own.encode([text, text])[1].tolist() == library.encode(text)
    assert len(own.known) < 30


def test_query(spark, tmp_path, library):
    rows = documents()
    got = sorted((tuple(r) for r in QUERIES["op12_pieces"](spark, write(tmp_path, rows, [], [], [])).collect()), key=str)

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()
    expected = [(d, ids) for d, t in rows for ids in [library.encode(t or "")]]
    assert got == sorted(((d, len(i), digest(",".join(map(str, i))), digest(library.decode(i))) for d, i in expected), key=str)


def test_columns(spark):
    frame = spark.createDataFrame([(None, None), ("a b", [28705, None, 264])], "text string, ids array<int>")
    got = frame.select(sentence_pieces.encode(model()).alias("e"), sentence_pieces.decode(model()).alias("d")).collect()
    assert [(list(r.e), r.d) for r in got] == [([], ""), ([264, 287], got[1].d)] and got[1].d == " a"
    assert frame.select(F.size(sentence_pieces.encode(model()))).count() == 2
