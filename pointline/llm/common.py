"""Words and hashes of Arrow text batches, table access, shared folders.

A word is a maximal run of bytes other than space and 0x09-0x0D. All functions treat a null text as an empty one and work on
whole texts; ``pieces`` only bounds how many texts are in memory at once.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

PIECE_BYTES = 1 << 19
BATCH_BYTES = 8 << 20
#: Settings while a table is stored: batches for Python workers hold ``BATCH_BYTES`` at most, as both sides keep a copy of each, and the
#: shuffles that led to the table are deleted once it is written, as nothing reads them again.
WHILE_STORING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
SPACES = b" \t\n\x0b\x0c\r"


def ship(module: str) -> None:
    """The module's functions travel with a query, so executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def kept_in_worker(name: str, make):
    """A value made once per Python process, also when the function that asks for it is unpickled for each task."""
    held = sys.__dict__.setdefault("_pointline_llm", {})
    if name not in held:
        held[name] = make()
    return held[name]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Writes to a new folder below ``spark.checkpoint.dir`` and reads it again: cuts lineage, survives lost executors. ``WHILE_STORING`` holds
    meanwhile."""
    spark, path = frame.sparkSession, shared_folder(frame.sparkSession, purpose)
    before = {name: spark.conf.get(name) for name in WHILE_STORING}
    for name, value in WHILE_STORING.items():
        spark.conf.set(name, value)
    try:
        frame.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(frame.schema).parquet(path)


def give_back() -> None:
    """Returns to the system what a worker has freed, before it waits for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def removed(spark: SparkSession, frame: DataFrame) -> None:
    """Deletes the files of a frame that ``stored`` returned and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of at most ``limit`` bytes, or of a single text, with the place of their first row."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


@dataclass
class Words:
    """The words of some texts: bytes, edges of the texts in them, first and past-the-end byte of each word, and the number
    of the first word of each text (with the total at the end)."""

    data: np.ndarray
    edges: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """``texts`` is a slice that ``pieces`` gave. ``lower`` maps A-Z only."""
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edges[0]:edges[-1]] if raw is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    border = np.zeros(len(data) + 1, bool)
    border[edges] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:-1]
    ends[:-1] &= ~inside[1:] | border[1:-1]
    starts = np.flatnonzero(begins)
    return Words(data, edges, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, edges))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15

    def grown(factor: int) -> np.ndarray:
        out = np.full(size, factor, np.uint64)
        out[0] = 1
        return np.cumprod(out)
    return grown(base), grown(pow(base, -1, 1 << 64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(20, int(len(data)).bit_length())
    held = sys.__dict__.setdefault("_pointline_llm", {})
    if len(held.get("powers", [[]])[0]) < size:
        held["powers"] = _powers(size)
    power, inverse = held["powers"]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    if size > 1 << 23:
        del held["powers"]  # one very long text; the next call makes the usual table again
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.starts, words.ends)


def shingle_hashes(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words that lie within one text, and the number of their first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k:k + n] * np.uint64((0xA24BAED4963EE407 * (2 * k + 1) ^ (k << 40)) & (2**64 - 1) | 1)
    last = np.repeat(firsts[1:], np.diff(firsts))[:n]
    at = np.flatnonzero(np.arange(n) + width <= last)
    return mix(total[at]), at


def per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of consecutive values between the edges."""
    sums = np.concatenate([np.zeros(1, np.int64 if values.dtype.kind in "bui" else np.float64), np.cumsum(values, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)])
    return sums[edges[1:]] - sums[edges[:-1]]


def learnable(column="doc_id"):
    """Rows from which labels may be learned: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 != 0


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame | None:
    """doc_id, quality, _place and _hash of the first ``rows`` ids, in the order of a hash of the id, that may be learned from and have a text; of
    an id's texts the one of least hash. ``rows`` is a parameter of the classifiers that learn from them. None without any.

    Rows without id, label or text are passed over; an id with several labels has the greatest. No text is too long.
    """
    ids = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(learnable()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("_hash"))
    found = texts.join(ids, "doc_id").groupBy("doc_id").agg(F.min("_hash").alias("_hash"), F.max("quality").alias("quality")).withColumn("_place", F.xxhash64("doc_id"))
    head = found.orderBy("_place", "doc_id").limit(rows).collect()  # at most ``rows`` ids
    return docs.sparkSession.createDataFrame(head, found.schema) if head else None


def labelled_features(docs: DataFrame, labels: DataFrame, rows: int, features) -> list[tuple[bytes, int]]:
    """What ``features`` makes of the labelled texts, made where the texts are, with their labels. ``features`` takes a slice of texts that ``pieces``
    gave and returns a few bytes for each."""
    chosen = labelled_rows(docs, labels, rows)
    if chosen is None:
        return []

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in pieces(batch.column("text")):
                part = batch.slice(at, len(piece)).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(features(piece), pa.binary())], [*part.schema.names, "features"])
        give_back()
    texts = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("_hash")).join(F.broadcast(chosen), ["doc_id", "_hash"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.select("doc_id", "_place", "quality", "text").mapInArrow(made, f"doc_id {kind}, _place bigint, quality int, features binary")
    once = found.groupBy("_place", "doc_id", "quality").agg(F.first("features").alias("features")).collect()  # at most ``rows`` ids
    return [(bytes(r.features), r.quality) for r in sorted(once, key=lambda r: (r._place, r.doc_id))]


def warn_without_model(module: str, model, labelled: int):
    """The model; a warning if there were labels and none came of them."""
    if model is None and labelled:
        warnings.warn(f"{module}: no model could be fitted from {labelled} labelled texts", RuntimeWarning, stacklevel=3)
    return model
