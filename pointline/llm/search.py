"""Ranked lexical search through hashed max-sketches.

A document's sketch has one coordinate for each value of a hash of its terms, and in it the greatest number of occurrences of the
terms that share it; all other coordinates are 0 and not kept. The impact of a term grows with its occurrences, so a lookup of a
query's terms, each weighed by its own weight, bounds the document's score from above. ``index`` reads the texts once and keeps
the sketches, the document frequencies of all terms and what they add up to.

``search`` takes the queries in blocks. Sketches are looked up for a whole block at once; the documents of highest bound of each query
are scored exactly, which gives the query's threshold (its k-th best score so far). Whatever has a bound of at least the threshold is
scored in the second step, so the result is exact: no document outside can reach it. Equal texts have equal scores, so of each
text only the ``k`` documents of least id go on; groups of copies of any size shrink before anything is joined.

Terms are told apart by 64-bit hashes. Defined results: a null text has no terms; a document or query without terms is in no result;
rows of the same id are documents of their own, and so are queries; equal scores go by ascending id, null ids last. Without documents
or queries the result is empty. Extra columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder
from .common import Words, pieces, removed, ship, span_hashes, stored, words_of

ship(__name__)

COORDINATES = 1 << 16
KEPT_TERMS = 1 << 20
BLOCK_TERMS, BLOCK_QUERIES = 1 << 13, 1 << 9
LOOKED_UP = 256
SALTS = 64
BROADCAST_ROWS = 1 << 17
SLACK = 1.001  # bounds are sums in single precision
SKETCHES = "doc_id {kind}, text_hash bigint, n bigint, sketch binary, term bigint, df bigint"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a slice of texts, and the number of the first of each text (with the total at the end)."""
    words = words_of(texts, lower=True)
    data = words.data
    inside = (data >= 128) | (data >= 97) & (data <= 122) | (data >= 48) & (data <= 57)
    border = np.zeros(len(data) + 1, bool)
    border[words.edges] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:-1]
    ends[:-1] &= ~inside[1:] | border[1:-1]
    starts = np.flatnonzero(begins)
    found = Words(data, words.edges, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, words.edges))
    return span_hashes(found.data, found.starts, found.ends), found.firsts


def counted(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and occurrences, in the order of text and term."""
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(text)))


def coordinate(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def sketched(text: np.ndarray, hashes: np.ndarray, tf: np.ndarray, texts: int) -> list[bytes]:
    """Of each text its coordinates (two bytes each) and then their maxima (four bytes each)."""
    place = text << 16 | coordinate(hashes)  # in order already: a coordinate is the head of the hash
    at = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(tf, at) if len(at) else tf
    where, most = (place[at] & 0xFFFF).astype("<u2"), np.minimum(most, 2**32 - 1).astype("<u4")
    edges = np.searchsorted(place[at] >> 16, np.arange(texts + 1)).tolist()
    return [where[a:b].tobytes() + most[a:b].tobytes() for a, b in zip(edges, edges[1:])]


class Frequencies:
    """Document frequencies of the terms met so far, given out when there are many."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.parts.append(np.unique(hashes, return_counts=True))
        self.size += len(self.parts[-1][0])

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        terms = np.concatenate([t for t, _ in self.parts] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([c for _, c in self.parts] or [np.zeros(0, np.int64)])
        self.parts, self.size = [], 0
        terms, back = np.unique(terms, return_inverse=True)
        return terms, np.bincount(back, counts, len(terms)).astype(np.int64)


@dataclass
class Index:
    sketches: DataFrame  # doc_id, text_hash, n, sketch
    frequencies: DataFrame  # term, df
    documents: int  # with a term
    length: int  # terms of all of them
    files: DataFrame

    def delete(self) -> None:
        removed(self.files.sparkSession, self.files)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def index(docs: DataFrame) -> Index:
    """One pass over the texts. Sketches and frequencies are written to one table, a row per document with a term and per part of a
    task's vocabulary and term."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, schema = Frequencies(), None

        def rows(doc_id=None, text_hash=None, n=None, sketch=None, term=None, df=None) -> pa.RecordBatch:
            given = [doc_id, text_hash, n, sketch, term, df]
            size = next(len(x) for x in given if x is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(size, t) if x is None else pa.array(x, t) for x, t in zip(given, schema.types)], schema=schema)

        def frequencies() -> pa.RecordBatch:
            terms, df = seen.flush()
            return rows(term=terms.view(np.int64), df=df)
        for batch in batches:
            if schema is None:
                schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("text_hash", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()),
                                    ("term", pa.int64()), ("df", pa.int64())])
            for at, texts in pieces(batch.column("text")):
                hashes, firsts = terms_of(texts)
                text, terms, tf = counted(hashes, firsts)
                seen.add(terms)
                n = np.diff(firsts)
                has = np.flatnonzero(n)
                sketches = sketched(text, terms, tf, len(texts))
                part = batch.slice(at, len(texts)).take(pa.array(has))
                yield rows(part.column("doc_id"), part.column("text_hash"), n[has], [sketches[i] for i in has.tolist()])
                if seen.size > KEPT_TERMS:
                    yield frequencies()
        if seen.size:
            yield frequencies()
    found = stored(keyed(docs).where("text is not null").mapInArrow(scan, SKETCHES.format(kind=kind)), "search-index")
    sketches = found.where("term is null").select("doc_id", "text_hash", "n", "sketch")
    total = sketches.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    frequencies = found.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    return Index(sketches, frequencies, total.documents, total.length, found)


class Block:
    """Some queries: their terms, how often each query has them, and what an occurrence weighs."""

    def __init__(self, queries: list[tuple[int, Counter]], df: dict[int, int], documents: int, length: int):
        self.documents, self.length = documents, length
        self.numbers = np.array([q for q, _ in queries], np.int64)
        self.terms = np.array(sorted(set().union(*(c for _, c in queries))), np.uint64)
        place = {t: i for i, t in enumerate(self.terms.tolist())}
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in self.terms.tolist()], np.int64)
        self.query = np.array([k for k, (_, c) in enumerate(queries) for _ in c], np.int64)
        self.term = np.array([place[t] for _, c in queries for t in c], np.int64)
        self.times = np.array([n for _, c in queries for n in c.values()], np.int64)

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """The column of each coordinate that a query looks up (else -1), and what each column counts for each query."""
        used, spot = np.unique(coordinate(self.terms), return_inverse=True)
        column = np.full(COORDINATES, -1, np.int64)
        column[used] = np.arange(len(used))
        worth = np.zeros((len(used), len(self.numbers)), np.float32)
        np.add.at(worth, (spot[self.term], self.query), (self.weight[self.term] * self.times).astype(np.float32))
        return column, worth

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of a term that occurs ``tf`` times in a document of ``n`` terms, before its weight."""
        most = int(n.max()) if len(n) else 0
        if 75 * most * self.documents < 1 << 62:
            m = 25 + 75 * n * self.documents // self.length
        else:  # beyond 64 bits on the way
            m = np.array([25 + 75 * x * self.documents // self.length for x in n.tolist()], np.int64)
        return 10**9 * tf // (1000 * tf + 8 * m)

    def bounds(self, n: np.ndarray, sketches: list[bytes], lookup: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Upper bounds of the scores, a row per document and a column per query."""
        sizes = np.array([len(s) // 6 for s in sketches], np.int64)
        where = np.frombuffer(b"".join(s[:2 * k] for s, k in zip(sketches, sizes.tolist())), "<u2")
        most = np.frombuffer(b"".join(s[2 * k:] for s, k in zip(sketches, sizes.tolist())), "<u4")
        column, row = lookup[0][where], np.repeat(np.arange(len(sizes)), sizes)
        hit = np.flatnonzero(column >= 0)
        held = np.zeros((len(sizes), len(lookup[1])), np.float32)
        held[row[hit], column[hit]] = self.impact(most[hit].astype(np.int64), n[row[hit]])
        return held @ lookup[1] * np.float32(SLACK)

    def scores(self, texts: pa.Array, asked: list[np.ndarray]) -> list[np.ndarray]:
        """Exact scores of each text for the queries that are asked of it (places in the block)."""
        hashes, firsts = terms_of(texts)
        text, terms, tf = counted(hashes, firsts)
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[place] == terms)
        text, place = text[hit], place[hit]
        worth = self.impact(tf[hit], np.diff(firsts)[text]) * self.weight[place]
        edges, out = np.searchsorted(text, np.arange(len(texts) + 1)), []
        first = np.searchsorted(self.query, np.arange(len(self.numbers) + 1))
        value = np.zeros(len(self.terms), np.int64)
        for k, queries in enumerate(asked):
            inside = slice(edges[k], edges[k + 1])
            value[place[inside]] = worth[inside]
            out.append(np.array([int((value[self.term[first[q]:first[q + 1]]] * self.times[first[q]:first[q + 1]]).sum()) for q in queries.tolist()], np.int64))
            value[place[inside]] = 0
        return out


def bounded(sketches: DataFrame, block: Block, least: np.ndarray | None, most: int) -> DataFrame:
    """query (its place in the block), doc_id, text_hash, bound: all with a bound of at least ``least`` of the query; without it those
    that are among the ``most`` of highest bound of the query when their task meets them."""
    kind = sketches.schema["doc_id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = block.lookup()
        held = np.zeros((most, len(block.numbers)), np.float32)  # the highest bounds met
        for batch in batches:
            for at in range(0, len(batch), LOOKED_UP):
                part = batch.slice(at, LOOKED_UP)
                bounds = block.bounds(part.column("n").to_numpy(), part.column("sketch").to_pylist(), lookup)
                if least is None:
                    both = np.concatenate([held, bounds])
                    held = -np.partition(-both, most - 1, axis=0)[:most]
                    row, query = np.nonzero((bounds >= held.min(axis=0)) & (bounds > 0))
                else:
                    row, query = np.nonzero((bounds >= least) & (bounds > 0))
                part = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), part.column("doc_id"), part.column("text_hash"), pa.array(bounds[row, query])],
                                                 ["query", "doc_id", "text_hash", "bound"])
    return sketches.mapInArrow(look, f"query int, doc_id {kind}, text_hash bigint, bound float")


def first_of(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key. Each task gives on ``k`` at most; those meet in ``SALTS`` groups before they meet as one."""
    for keys in ([*by, "_salt"], by):
        rows = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))) if "_salt" in keys else rows.drop("_salt", "_rank")
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k)
    return rows


def scored(docs: DataFrame, candidates: DataFrame, block: Block) -> DataFrame:
    """query, doc_id, score of candidates (query, doc_id, text_hash); ``candidates`` comes from ``stored``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column("text")):
                asked = [np.array(q, np.int64) for q in batch.column("queries").slice(at, len(texts)).to_pylist()]
                scores = block.scores(texts, asked)
                row = np.repeat(np.arange(at, at + len(texts)), [len(q) for q in asked])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(asked).astype(np.int32)), batch.column("doc_id").take(pa.array(row)), pa.array(np.concatenate(scores))],
                                                 ["query", "doc_id", "score"])
    wanted = candidates.groupBy("doc_id", "text_hash").agg(F.collect_set("query").alias("queries"))  # at most the queries of a block
    if candidates.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = keyed(docs).alias("t").join(wanted.alias("w"), F.expr("t.text_hash = w.text_hash and t.doc_id <=> w.doc_id"))
    return texts.select("t.doc_id", "t.text", "w.queries").mapInArrow(score, f"query int, doc_id {kind}, score bigint").where("score > 0")


def best(scores: DataFrame, k: int) -> DataFrame:
    return first_of(scores, ["query"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, found: Index | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) of each query (item_id, text).

    The driver holds the queries of one block, cut at ``BLOCK_QUERIES`` queries and ``BLOCK_TERMS`` terms. Each block looks up all sketches,
    but not the texts again; these are read once for a block's candidates of highest bound and once for the others.
    """
    spark, own = docs.sparkSession, found is None
    found = found or index(docs)
    kinds = f"item_id {queries.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint"
    path = shared_folder(spark, "search-results")
    spark.createDataFrame([], kinds).write.parquet(path)
    for items, block in blocks(spark, queries, found):
        names = spark.createDataFrame(list(enumerate(items)), f"query int, {kinds.split(',')[0]}")
        out, used = answered(docs, found, block, k)
        out.join(F.broadcast(names), "query").select("item_id", F.col("_rank").cast("int").alias("rank"), "doc_id", "score").write.mode("append").parquet(path)
        removed(spark, used)
    if own:
        found.delete()
    return spark.read.schema(kinds).parquet(path)


def blocks(spark: SparkSession, queries: DataFrame, found: Index) -> Iterator[tuple[list, Block]]:
    """Blocks of queries with the ids of the items they stand for."""
    def made(held: list[tuple]) -> tuple[list, Block]:
        asked = set().union(*(c for _, c in held))
        wanted = spark.createDataFrame([(int(t),) for t in np.array(sorted(asked), np.uint64).view(np.int64)], "term bigint")
        df = {r.term & 2**64 - 1: r.df for r in found.frequencies.join(F.broadcast(wanted), "term").collect()}  # at most the terms of a block
        return [i for i, _ in held], Block([(k, c) for k, (_, c) in enumerate(held)], df, found.documents, found.length)
    held, size = [], 0
    for row in queries.select("item_id", "text").where("text is not null").toLocalIterator():
        hashes, _ = terms_of(pa.array([row.text], pa.large_string()))
        terms = Counter(hashes.tolist())
        if not terms or not found.documents:
            continue
        if held and (len(held) == BLOCK_QUERIES or size + len(terms) > BLOCK_TERMS):
            yield made(held)
            held, size = [], 0
        held.append((row.item_id, terms))
        size += len(terms)
    if held:
        yield made(held)


def answered(docs: DataFrame, found: Index, block: Block, k: int) -> tuple[DataFrame, DataFrame]:
    """query, _rank, doc_id, score; and the table to be removed when they have been written."""
    order = [F.desc("bound"), F.asc_nulls_last("doc_id"), "text_hash"]
    likely = first_of(bounded(found.sketches, block, None, k), ["query"], order, k)
    likely = stored(likely.select("query", "doc_id", "text_hash"), "search-likely")
    reached = best(scored(docs, likely, block), k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score")).collect()  # a row per query of the block
    removed(docs.sparkSession, likely)
    least = np.zeros(len(block.numbers), np.float32)
    for r in reached:
        least[r["query"]] = np.nextafter(np.float32(r.score), np.float32(0)) if r.n == k else 0
    rest = first_of(bounded(found.sketches, block, least, k), ["query", "text_hash"], [F.asc_nulls_last("doc_id")], k)
    rest = stored(rest.select("query", "doc_id", "text_hash"), "search-rest")
    return best(scored(docs, rest, block), k), rest
