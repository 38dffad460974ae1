"""Quality rules: exact text statistics and a hashed n-gram logistic regression with fixed thresholds.

Features of a text are words and pairs of neighbouring words (a word that follows itself counts as one common pair) and
character trigrams, hashed into ``2^bits`` places; each kind has weight 1 in all, whatever the length. The regression is fitted
on a bounded sample of labelled rows (``rows`` ids; of a text with more than ``KEPT`` different features those of greatest weight), its probability is calibrated by Platt's
method on a part of the sample that the weights have not seen. Scoring runs in Arrow batches on whole texts.

Defined results: a null text counts as an empty one; a text without words fails the base rules. Without usable labels (none,
or all alike) the probability is 1 for every text, so that only the base rules decide. Repeated rows and ties are judged each
on its own; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, labelled_features, mix, per_text, pieces, shingle_hashes, ship, span_hashes, warn_without_model, word_hashes, words_of

ship(__name__)

SYMBOLS = b"#*$%&|<>"
BITS = 16
KINDS = 3
KEPT = 1 << 13
RESULT = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
          "base_failed:boolean,probability:double,kept:boolean>")


@dataclass
class Model:
    """Weights per hashed feature, and the line from their sum to a calibrated log-odds."""

    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -30, 30)))


def features(words, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind the hashed places of all features, and where each text's begin (with the end)."""
    mask, texts = np.uint64((1 << BITS) - 1), len(words.edges) - 1
    pair, at = shingle_hashes(hashes, words.firsts, 2)
    if len(at):
        pair = np.where(hashes[at] == hashes[at + 1], np.uint64(1), pair)
    # no pair is lost at the end of a text: the i-th word of a text has a pair unless it is the last
    pairs = np.searchsorted(at, words.firsts)
    wide = words.data.astype(np.uint32)
    if len(wide) >= 3:
        gram = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
        gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        inner = np.ones(len(gram), bool)
        for back in (1, 2):
            cut = words.edges[1:-1] - back
            inner[cut[(cut >= 0) & (cut < len(gram))]] = False
        place = np.flatnonzero(inner)
        grams, gram = np.searchsorted(place, words.edges), gram[place]
    else:
        grams, gram = np.zeros(texts + 1, np.int64), np.zeros(0, np.uint32)
    return [((hashes & mask).astype(np.int64), words.firsts), ((pair & mask).astype(np.int64) + (1 << BITS), pairs),
            (gram.astype(np.int64) + (2 << BITS), grams)]


def logits(kinds, weights: np.ndarray) -> np.ndarray:
    out = weights[-1]
    for places, edges in kinds:
        out = out + per_text(weights[places], edges) / np.maximum(1, np.diff(edges))
    return out


def weighed(texts: pa.Array) -> list[bytes]:
    """Of each text its features (four bytes each) and their weights (four bytes each): the ``KEPT`` of greatest weight."""
    words, out = words_of(texts), []
    kinds = features(words, word_hashes(words))
    for t in range(len(texts)):
        places, weights = [], []
        for found, edges in kinds:
            mine, counts = np.unique(found[edges[t]:edges[t + 1]], return_counts=True)
            places.append(mine)
            weights.append(counts / max(1, edges[t + 1] - edges[t]))
        places, weights = np.concatenate(places), np.concatenate(weights)
        most = np.sort(np.argsort(-weights, kind="stable")[:KEPT])
        out.append(places[most].astype("<u4").tobytes() + weights[most].astype("<f4").tobytes())
    return out


def fit(sample: list[tuple[bytes, int]], rounds: int = 60, held: int = 5) -> Model | None:
    """Adam on the whole sample (of ``weighed`` texts) but every ``held``-th, then Platt calibration on those. None if a class is missing."""
    labels = np.array([y for _, y in sample], np.float64)
    if len(sample) < 20 or not 0 < labels.sum() < len(labels):
        return None
    sizes = np.array([len(f) // 8 for f, _ in sample])
    doc = np.repeat(np.arange(len(sample)), sizes)
    place = np.concatenate([np.frombuffer(f, "<u4", n) for (f, _), n in zip(sample, sizes.tolist())]).astype(np.int64)
    value = np.concatenate([np.frombuffer(f, "<f4", n, 4 * n) for (f, _), n in zip(sample, sizes.tolist())]).astype(np.float64)
    train = np.arange(len(labels)) % held != 0
    if not 0 < labels[train].sum() < train.sum() or not 0 < labels[~train].sum() < (~train).sum():
        train[:] = True
    size = KINDS << BITS
    weights, mean, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    balance = np.where(labels > 0, 0.5 / labels[train].mean(), 0.5 / (1 - labels[train].mean())) * train
    for step in range(1, rounds + 1):
        z = weights[-1] + np.bincount(doc, value * weights[place], len(labels))
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / train.sum()
        slope = np.append(np.bincount(place, value * error[doc], size), error.sum()) + 1e-6 * weights
        mean += 0.1 * (slope - mean)
        square += 0.01 * (slope * slope - square)
        weights -= 1.0 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-6)
    z = weights[-1] + np.bincount(doc, value * weights[place], len(labels))
    check = ~train if not train.all() else train
    return Model(weights.astype(np.float32), *platt(z[check], labels[check]))


def platt(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Newton steps for the slope and offset that give the labels the highest likelihood, with Platt's smoothed targets."""
    ups, downs = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (ups + 1) / (ups + 2), 1 / (downs + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        a, b, c = (w * z * z).sum() + 1e-3, (w * z).sum(), w.sum() + 1e-3
        g, h = ((p - target) * z).sum(), (p - target).sum()
        slope, offset = slope - (c * g - b * h) / (a * c - b * b), offset - (a * h - b * g) / (a * c - b * b)
        slope = min(max(slope, 0.05), 20.0)
    return float(slope), float(offset)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def statistics(words, hashes: np.ndarray, width: int = 5) -> dict[str, np.ndarray]:
    """The counts that the base rules use, for each text."""
    texts, data = len(words.edges) - 1, words.data
    inside = (data != 32) & ((data < 9) | (data > 13))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    windows, at = shingle_hashes(hashes, words.firsts, width)
    owner = np.searchsorted(words.firsts, at, "right").astype(np.uint64)
    found = at[repeated(mix(windows ^ mix(owner)))] if len(at) else at
    change = np.zeros(len(hashes) + 1, np.int64)
    change[found] += 1
    np.add.at(change, found + width, -1)
    covered = np.cumsum(change[:-1]) > 0
    feeds = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([words.edges[:-1], feeds + 1]))
    stop = np.searchsorted(feeds, begin)
    stop = np.minimum(np.append(feeds, len(data))[stop], words.edges[np.minimum(np.searchsorted(words.edges, begin, "right"), texts)])
    full = np.searchsorted(words.starts, stop) > np.searchsorted(words.starts, begin)
    begin, stop = begin[full], stop[full]
    line_of = np.searchsorted(words.edges, begin, "right") - 1
    _, one = np.unique(mix(span_hashes(data, begin, stop) ^ mix(line_of.astype(np.uint64) + np.uint64(1))), return_index=True)
    return {
        "n_words": words.counts, "word_chars": per_text(inside & ((data & 0xC0) != 0x80), words.edges),
        "n_symbols": per_text(symbol[data], words.edges),
        "n_dup_lines": np.bincount(line_of, minlength=texts) - np.bincount(line_of[one], minlength=texts),
        "n_repeat_words": per_text(covered, words.firsts),
    }


def judged(texts: pa.Array, model: Model | None, least_words: int, repeat_percent: int, least: float) -> pa.StructArray:
    parts = []
    for _, piece in pieces(texts):
        words = words_of(piece)
        hashes = word_hashes(words)
        out = statistics(words, hashes)
        failed = (out["n_words"] < least_words) | (100 * out["n_repeat_words"] > repeat_percent * out["n_words"])
        p = model.probability(logits(features(words, hashes), model.weights)) if model else np.ones(len(piece))
        out |= {"base_failed": failed, "probability": p, "kept": ~failed & (p >= least)}
        parts.append(pa.StructArray.from_arrays([pa.array(x) for x in out.values()], list(out)))
    if not parts:
        none = [pa.array([], pa.int64())] * 5 + [pa.array([], pa.bool_()), pa.array([], pa.float64()), pa.array([], pa.bool_())]
        return pa.StructArray.from_arrays(none, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"])
    return pa.concat_arrays(parts)


def judge(model: Model | None, least_words: int = 10, repeat_percent: int = 20, least: float = 0.2) -> Column:
    """The verdict on column ``text``: statistics, ``base_failed``, ``probability`` and ``kept``."""
    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield judged(batch, model, least_words, repeat_percent, least)
        give_back()
    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, RESULT).asNondeterministic()(F.col("text"))


def trained(docs: DataFrame, labels: DataFrame, rows: int = 1500) -> Model | None:
    sample = labelled_features(docs, labels, rows, weighed)
    return warn_without_model(__name__, fit(sample), len(sample))
