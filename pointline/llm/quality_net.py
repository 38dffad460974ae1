"""Quality of a text: random-indexing word vectors, pooled, and a small network with a calibrated temperature.

Random indexing: each word has a sparse index vector, drawn from the word's 64-bit hash. The ``words`` most frequent words of the corpus also have a
context vector: the sum of the index vectors of all words within two places of them, over all documents, scaled to one length. A
word's vector is its index vector plus its context vector. Rarer words fall back on the two vectors, made in the same way, of the rarer words that begin with their
first three bytes and of those that end with their last three and have their length class. A document is the mean of its
words' vectors, the mean product of neighbouring words' vectors, and the logarithm of its number of words. Two layers (tanh, then
one logit) are trained on a bounded sample (``rows`` ids) of the labelled rows that may be learned from; a temperature is fitted on a part
of the sample that training has not seen.

Word counts and context sums are added up in each task first, then by Spark over all tasks. The driver holds what the parameters bound: ``words`` and
8192 vectors of 32 numbers, and 65 numbers per sampled row.

Defined results: a null text or one without words is scored like any other, with zero vectors. Without usable labels
every score is 0.5. Rows are judged each on its own; labels, language, source and id are no inputs of a score. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, give_back, labelled_features, mix, pieces, ship, span_hashes, stored, warn_without_model, word_hashes, words_of

ship(__name__)

WIDTH, SIGNS, REACH = 32, 4, 2
WORDS = 1 << 14
COUNTED = 1 << 20
BITS, AFFIX = 12, 3
SALTS = 16


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Sparse vectors of +1 and -1."""
    out = np.zeros((len(hashes), WIDTH), np.float32)
    at = np.arange(len(hashes))
    for k in range(SIGNS):
        h = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 2**64 - 1))
        out[at, (h % np.uint64(WIDTH)).astype(np.int64)] += np.where(h >> np.uint64(63), np.float32(1), np.float32(-1))
    return out


def affixes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word's beginning and of its end with its length class."""
    mask = np.uint64((1 << BITS) - 1)
    size = words.ends - words.starts
    short = np.minimum(size, AFFIX)
    head = span_hashes(words.data, words.starts, words.starts + short)
    tail = mix(span_hashes(words.data, words.ends - short, words.ends) + np.minimum(size // 3, 4).astype(np.uint64))
    return (head & mask).astype(np.int64), (tail & mask).astype(np.int64) + (1 << BITS)


def found_at(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each hash in the sorted vocabulary, and whether it is there."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return place, vocabulary[place] == hashes


def frequent_words(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of the words that stand most often in all texts, sorted; of equally frequent ones those of least hash."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> pa.RecordBatch:
            hashes, back = np.unique(np.concatenate([h for h, _ in seen]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([c for _, c in seen]), len(hashes)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["word", "n"])
        seen, size = [], 0
        for batch in batches:
            for _, piece in pieces(batch.column("text")):
                seen.append(np.unique(word_hashes(words_of(piece)), return_counts=True))
                size += len(seen[-1][0])
                if size > COUNTED:
                    yield given()
                    seen, size = [], 0
        if size:
            yield given()
        give_back()
    most = docs.where("text is not null").select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # each task gives on ``words`` at most, which meet in ``SALTS`` groups; so the driver sees ``SALTS * words`` rows at most, whatever the number of tasks
    some = Window.partitionBy("_salt").orderBy(F.desc("n"), "word")
    most = most.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).withColumn("_rank", F.row_number().over(some)).where(F.col("_rank") <= words)
    most = most.select("word", "n").orderBy(F.desc("n"), "word").limit(words).collect()
    return np.sort(np.array([r.word for r in most], np.int64).view(np.uint64))


def add_contexts(sums: np.ndarray, words: Words, hashes: np.ndarray, vocabulary: np.ndarray) -> None:
    """Adds the index vectors around each word to the row of its vocabulary place or, after these rows, to those of its two affixes."""
    if len(hashes) < 2:
        return
    index, owner = index_vectors(hashes), np.repeat(np.arange(len(words.counts)), words.counts)
    around = np.zeros_like(index)
    for gap in range(1, REACH + 1):
        same = (owner[gap:] == owner[:-gap])[:, None]
        around[:-gap] += index[gap:] * same
        around[gap:] += index[:-gap] * same
    slot, known = found_at(vocabulary, hashes)
    known, rare = np.flatnonzero(known), np.flatnonzero(~known)
    head, tail = affixes(words)
    for rows, values in ((slot[known], around[known]), (head[rare] + len(vocabulary), around[rare]), (tail[rare] + len(vocabulary), around[rare])):
        order = np.argsort(rows, kind="stable")
        keys, first = np.unique(rows[order], return_index=True)
        if len(keys):
            sums[keys] += np.add.reduceat(values[order], first, axis=0)


def contexts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """A row per word of the vocabulary, and then per affix: index vector plus context vector over all documents."""
    names, rows = [f"v{k}" for k in range(WIDTH)], len(vocabulary) + (2 << BITS)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((rows, WIDTH))
        for batch in batches:
            for _, piece in pieces(batch.column("text")):
                words = words_of(piece)
                add_contexts(sums, words, word_hashes(words), vocabulary)
        some = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(sums[some, k].astype(np.int64)) for k in range(WIDTH))], ["slot", *names])
        give_back()
    parts = docs.where("text is not null").select("text").mapInArrow(add_up, "slot int, " + ", ".join(f"{n} bigint" for n in names))
    table = stored(parts.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]), "contexts").toPandas()  # ``rows`` at most
    sums = np.zeros((rows, WIDTH))
    sums[table["slot"].to_numpy()] = table[names].to_numpy()
    own = index_vectors(np.concatenate([vocabulary, mix(np.arange(2 << BITS, dtype=np.uint64))]))
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return (own + sums / np.maximum(length, 1e-9) * np.sqrt(SIGNS)).astype(np.float32) / 2


def pooled(texts: pa.Array, vocabulary: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row per text: mean vector, mean product of neighbours, log of the number of words. ``texts`` is a slice that ``pieces`` gave."""
    words = words_of(texts)
    hashes, n = word_hashes(words), words.counts
    out = np.zeros((len(texts), 2 * WIDTH + 1), np.float32)
    out[:, -1] = np.log1p(n)
    if not len(hashes):
        return out
    slot, known = found_at(vocabulary, hashes)
    each = np.empty((len(hashes), WIDTH), np.float32)
    each[known] = vectors[slot[known]]
    head, tail = affixes(words)
    each[~known] = vectors[head[~known] + len(vocabulary)] + vectors[tail[~known] + len(vocabulary)]
    owner = np.repeat(np.arange(len(texts)), n)
    full = np.flatnonzero(n)
    out[full, :WIDTH] = np.add.reduceat(each, words.firsts[:-1][full], axis=0) / n[full, None]
    product = np.zeros_like(each)
    product[:-1] = each[1:] * each[:-1] * (owner[1:] == owner[:-1])[:, None]
    out[full, WIDTH:-1] = np.add.reduceat(product, words.firsts[:-1][full], axis=0) / np.maximum(1, n[full] - 1)[:, None]
    return out


@dataclass
class Model:
    """Frequent words and their vectors, scale of the inputs, weights of both layers, temperature."""

    vocabulary: np.ndarray
    vectors: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.center) / self.spread @ a + b) @ c + d

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = self.logits(pooled(texts, self.vocabulary, self.vectors)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(sample: list[tuple[bytes, int]], vocabulary: np.ndarray, vectors: np.ndarray, hidden: int = 24, rounds: int = 100, held: int = 5, seed: int = 5) -> Model | None:
    """Adam on the whole sample (of ``pooled`` texts) but every ``held``-th, whose likelihood then decides the temperature."""
    labels = np.array([y for _, y in sample], np.float64)
    if len(sample) < 20 or not 0 < labels.sum() < len(labels):
        return None
    x = np.array([np.frombuffer(f, np.float32) for f, _ in sample], np.float64)
    train = np.arange(len(labels)) % held != 0
    if not 0 < labels[train].sum() < train.sum() or not 0 < labels[~train].sum() < (~train).sum():
        train[:] = True
    center, spread = x[train].mean(0), x[train].std(0) + 1e-3
    model = Model(vocabulary, vectors, center, spread, [])
    draw = np.random.default_rng(seed)
    model.layers = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    inputs, y = (x[train] - center) / spread, labels[train]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    mean, square = [np.zeros_like(p) for p in model.layers], [np.zeros_like(p) for p in model.layers]
    for step in range(1, rounds + 1):
        a, b, c, d = model.layers
        inner = np.tanh(inputs @ a + b)
        error = weight * (1 / (1 + np.exp(-np.clip(inner @ c + d, -30, 30))) - y)
        back = np.outer(error, c) * (1 - inner * inner)
        slopes = [inputs.T @ back + 1e-3 * a, back.sum(0), inner.T @ error + 1e-3 * c, np.array([error.sum()])]
        for k, g in enumerate(slopes):
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            model.layers[k] = model.layers[k] - 0.02 * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
    check = ~train if not train.all() else train
    z, y = model.logits(x[check]), labels[check]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    model.temperature = float(min(grid, key=lambda t: np.logaddexp(0, -(2 * y - 1) * z / t).mean()))
    return model


def score(model: Model | None, column="text") -> Column:
    """Probability of label 1."""
    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = [model.scores(p) if model else np.full(len(p), 0.5) for _, p in pieces(batch)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
        give_back()
    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "double").asNondeterministic()(F.col(column))


def trained(docs: DataFrame, labels: DataFrame, rows: int = 1500, words: int = WORDS) -> Model | None:
    if labels.isEmpty():
        return None
    vocabulary = frequent_words(docs, words)
    vectors = contexts(docs, vocabulary)
    sample = labelled_features(docs, labels, rows, lambda texts: [x.tobytes() for x in pooled(texts, vocabulary, vectors)])
    return warn_without_model(__name__, fit(sample, vocabulary, vectors), len(sample))
