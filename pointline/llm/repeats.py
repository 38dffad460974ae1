"""Repeated passages: seeds on winnowed anchors, extended both ways, kept where they reach the threshold.

A window is ``length`` consecutive words. Of its ``grams``-word shingles the one of least hash is its anchor, so equal windows have equal
anchors at equal places. (1) Seeds: anchors of all documents are counted; those that occur once cannot lie in a repeat. (2) Extension:
around each seed that occurs again the windows that chose it are extended to the left and right, up to ``length`` words, and
hashed in 96 bits. (3) The first document of each window content is found by a grouped minimum of the ids; in it the smallest start is
first. (4) In each document the windows that are not first merge to maximal repeats. No pair of documents is ever formed, so a passage that a third of all
documents share costs as many rows as it has occurrences, summed up before they are shuffled.

Defined results: a null or short text (under ``length`` words) has no windows. Rows without id are left as they are and count for nothing. Rows
that share an id are judged each on its own against those of other ids. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, pieces, removed, shingle_hashes, ship, stored, word_hashes, words_of

ship(__name__)

LENGTH, GRAMS = 20, 10


def anchored(hashes: np.ndarray, firsts: np.ndarray, length: int, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, place of its anchor, hashes of shingles by place of their first word)."""
    n = len(hashes)
    shingle, at = shingle_hashes(hashes, firsts, grams)
    by_place = np.zeros(n, np.uint64)
    by_place[at] = shingle
    starts = np.flatnonzero(np.arange(n) + length <= np.repeat(firsts[1:], np.diff(firsts))) if n >= length else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, by_place
    # the least of each run of shingles by doubling: the leftmost of equal ones
    reach, best = 1, np.arange(n)
    span = length - grams + 1
    while 2 * reach <= span:
        other = best[np.minimum(np.arange(n) + reach, n - 1)]
        best = np.where(by_place[other] < by_place[best], other, best)
        reach *= 2
    other = best[np.minimum(starts + span - reach, n - 1)]
    return starts, np.where(by_place[other] < by_place[best[starts]], other, best[starts]), by_place


def anchors(docs: DataFrame, length: int = LENGTH, grams: int = GRAMS) -> DataFrame:
    """(doc_id, place, anchor): a row for each anchor that a window of a document chose."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, piece in pieces(batch.column("text")):
                words = words_of(piece)
                _, chosen, shingles = anchored(word_hashes(words), words.firsts, length, grams)
                chosen = np.unique(chosen)
                owner = np.searchsorted(words.firsts, chosen, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(owner + first)), pa.array((chosen - words.firsts[owner]).astype(np.int32)),
                    pa.array(shingles[chosen].view(np.int64))], ["doc_id", "place", "anchor"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(rows, f"doc_id {kind}, place int, anchor bigint")


def chosen_windows(words: Words, seeds: list, length: int, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the windows whose anchors are among its seeds: (number of the first word, hashes of words, text)."""
    hashes = word_hashes(words)
    starts, chosen, _ = anchored(hashes, words.firsts, length, grams)
    wanted = np.zeros(len(hashes), bool)
    for t, places in enumerate(seeds):
        places = np.asarray(places, np.int64)
        wanted[words.firsts[t] + places[places < words.firsts[t + 1] - words.firsts[t]]] = True
    starts = starts[wanted[chosen]]
    return starts, hashes, np.searchsorted(words.firsts, starts, "right") - 1


def windows(seeded: DataFrame, length: int = LENGTH, grams: int = GRAMS) -> DataFrame:
    """(doc_id, w1, w2): the extended windows of documents with ``seeds``, each content once; w1 and w2 are two hashes of the words."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column("seeds")
            for first, piece in pieces(batch.column("text")):
                words = words_of(piece)
                starts, hashes, owner = chosen_windows(words, [s.values.to_numpy() for s in seeds.slice(first, len(piece))], length, grams)
                one, at = shingle_hashes(hashes, words.firsts, length)
                two, _ = shingle_hashes(mix(hashes ^ np.uint64(0x5DEECE66D)), words.firsts, length)
                mine = np.searchsorted(at, starts)
                one, two = one[mine], two[mine]
                once = np.flatnonzero(earliest(one, owner))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(owner[once] + first)), pa.array(one[once].view(np.int64)),
                    pa.array((two[once] >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["doc_id", "w1", "w2"])
    kind = seeded.schema["doc_id"].dataType.simpleString()
    return seeded.select("doc_id", "text", "seeds").mapInArrow(rows, f"doc_id {kind}, w1 bigint, w2 int")


def earliest(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a window is the first of its content in its text."""
    order = np.lexsort((hashes, owner))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return ~again


def maximal(seeded: DataFrame, length: int = LENGTH, grams: int = GRAMS) -> Column:
    """Spans of words, as (start, end), that windows other than first ones cover, for rows with text, seeds and the w1 of
    the windows of which this document is the first (``firsts``)."""
    def batches(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for texts, seeds, firsts in columns:
            out = []
            for first, piece in pieces(texts):
                words = words_of(piece)
                starts, hashes, owner = chosen_windows(words, [s.values.to_numpy() for s in seeds.slice(first, len(piece))], length, grams)
                content, at = shingle_hashes(hashes, words.firsts, length)
                content = content[np.searchsorted(at, starts)]
                early, content = earliest(content, owner), content.view(np.int64)
                for t in range(len(piece)):
                    own = slice(np.searchsorted(owner, t), np.searchsorted(owner, t, "right"))
                    kept = firsts[first + t]
                    mine = starts[own] - words.firsts[t]
                    if kept.is_valid:
                        mine = mine[~(early[own] & np.isin(content[own], kept.values.to_numpy()))]
                    cut = np.flatnonzero(np.diff(mine) > length)
                    begin, end = mine[np.append(0, cut + 1)] if len(mine) else mine, mine[np.append(cut, len(mine) - 1)] + length if len(mine) else mine
                    out.append([{"start": int(b), "end": int(e)} for b, e in zip(begin, end)])
            yield pa.array(out, kind)
    batches.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "array<struct<start:int,end:int>>").asNondeterministic()(F.col("text"), F.col("seeds"), F.col("firsts"))


def repeats(docs: DataFrame, length: int = LENGTH, grams: int = GRAMS) -> DataFrame:
    """Documents that hold a seed which occurs again: doc_id, text, and their maximal repeats as spans of words (maybe none)."""
    found = stored(anchors(docs, length, grams), "anchors")
    again = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "again")
    # a frequent anchor is one row of this table; adaptive execution splits its occurrences on the other side
    seeds = found.join(again, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list("place").alias("seeds"))  # within one document
    seeded = stored(docs.select("doc_id", "text").join(seeds, "doc_id"), "seeded")
    for done in (found, again):
        removed(docs.sparkSession, done)
    firsts = windows(seeded, length, grams).groupBy("w1", "w2").agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.groupBy("doc_id").agg(F.collect_list("w1").alias("firsts"))  # within one document
    full = seeded.join(firsts, "doc_id", "left")
    return full.select("doc_id", "text", maximal(full, length, grams).alias("repeats"))


def kept_words(spans: Column | None = None) -> Column:
    """Of ``text``: n_words, n_removed, and the words outside ``spans`` joined by one space."""
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def made(text: str | None, cuts: list[dict]) -> dict:
        words = (text or "").encode().split()
        kept, done = [], 0
        for s in cuts or []:
            kept += words[done:s["start"]]
            done = s["end"]
        kept += words[done:]
        return {"n_words": len(words), "n_removed": len(words) - len(kept), "text": b" ".join(kept).decode()}

    result = "struct<n_words:bigint,n_removed:bigint,text:string>"
    if spans is None:
        def plain(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in texts:
                yield pa.array([made(t.as_py(), []) for t in batch], kind)
        plain.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(plain, result).asNondeterministic()(F.col("text"))

    def cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in columns:
            yield pa.array([made(t.as_py(), s.as_py()) for t, s in zip(texts, lists)], kind)
    cut.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(cut, result).asNondeterministic()(F.col("text"), spans)
