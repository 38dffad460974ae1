"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared as bytes after folding case (ASCII and the Latin letters of U+00C0-U+00DE) and making each run of white space one
space. Items are cut into overlapping segments of ``length`` bytes, and into short ones of two thirds of that from each word's start (and every ``STRIDE`` bytes
within long words) with a budget in proportion. A whole segment is a passage by itself; short ones are first lengthened as far as the bytes are equal and
joined where they follow each other in item and document, at most ``length`` bytes apart on diagonals at most half of that apart. Together they must
hold ``length`` bytes of the item. So each verbatim run of ``length`` bytes is found wherever it starts, and a passage with single words replaced if runs of
short segments are left between these. A segment with at most k edits in a document keeps at least ``length - q + 1 - k * q`` of its q-grams, and all on neighbouring diagonals (document
place less segment place), k apart at most. So hits of an index of the segments' q-grams are counted in diagonal bands of
2(k+1) that overlap by half; bands that reach the bound are verified by alignment within the band, and a segment counts if its edit distance
to some part of the region is at most k.

Equal segments are searched for once. Documents are looked at in windows of ``WINDOW`` bytes that overlap by ``OVERLAP``, which is more than any
two joined segments take; equal windows are searched once, and hits are counted in pieces of a bounded number. So memory does not grow with a document
or with how often it repeats what an item repeats, such as separator lines.

The benchmark is indexed in blocks of about half of ``block`` bytes. Each meets all documents in one scan without a shuffle, and its findings are written
before the next is collected, so the driver holds one block at a time; a single block stays in the caller's plan. A document is in one task only, whole.

Defined results: null and empty texts hold and are nothing; items of under ``q`` bytes after folding are not searched for, items shorter
than a segment are one segment with a proportionally smaller k. Equal items are found each. Spans are code points of the text given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, pieces, ship, span_hashes, stored

ship(__name__)

LEAKS = "array<struct<item_id:{},n_found:int,n_segments:int,start:int,end:int>>"
TABLE_BITS = 22
STRIDE = 10
WINDOW, OVERLAP = 4096, 512
HITS = 1 << 20
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def folded(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with case and white space folded, the edges of the texts in them, and where each byte stood."""
    upper = (data >= 65) & (data <= 90)
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = data + (upper.astype(np.uint8) << 5)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[edges[:-1][edges[:-1] < len(data)]] = True
    data[space] = 32
    place = np.flatnonzero(keep)
    return data[place], np.searchsorted(place, edges), place


def gram_codes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code for each window of q bytes, 8 <= q <= 16."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", raw, strides=(1,))
    return eight[:n] * K1 ^ eight[q - 8:q - 8 + n] * K2


@dataclass
class Index:
    """Different segments of benchmark items (bytes to offsets), where each q-gram stands in them, ordered by code, and the places that a
    segment has in items, ordered by segment."""

    q: int
    step: int
    length: int
    items: list
    item_bytes: list[np.ndarray]
    place_item: np.ndarray
    place_start: np.ndarray
    whole: np.ndarray
    places: np.ndarray
    bytes: np.ndarray
    sizes: np.ndarray
    budgets: np.ndarray
    bounds: np.ndarray
    codes: np.ndarray
    begins: np.ndarray
    segments: np.ndarray
    offsets: np.ndarray


def short_starts(data: np.ndarray, size: int) -> list[int]:
    """Starts of words, and others so that they are at most ``STRIDE`` apart, up to the last segment of ``size`` bytes."""
    last = len(data) - size
    words = np.flatnonzero((data[1:] != 32) & (data[:-1] == 32)) + 1
    out = [0]
    for s in [*words[words < last].tolist(), last]:
        out += range(out[-1] + STRIDE, s, STRIDE)
        out.append(s)
    return out


def index_of(rows: list[tuple], length: int, edits: int, q: int) -> Index | None:
    number, segment, owner, starts_at, whole, folds = {}, [], [], [], [], []
    short = length * 2 // 3
    for at, (_, text) in enumerate(rows):
        raw = np.frombuffer((text or "").strip().encode(), np.uint8)
        data = folded(raw, np.array([0, len(raw)]))[0]
        folds.append(data)
        if len(data) < q:
            continue
        starts = list(range(0, max(1, len(data) - length + 1), length // 2))
        if len(data) > length and starts[-1] != len(data) - length:
            starts.append(len(data) - length)
        cuts = [(s, length) for s in starts]
        if len(data) > length and short >= q:
            cuts += [(s, short) for s in short_starts(data, short)]
        for s, size in cuts:
            segment.append(number.setdefault(data[s:s + size].tobytes(), len(number)))
            owner.append(at)
            starts_at.append(s)
            whole.append(size == length)
    if not number:
        return None
    sizes = np.array([len(s) for s in number])
    budgets = np.minimum(sizes * edits // length, np.maximum(0, (sizes - q) // q))
    padded = np.zeros((len(number), length), np.uint8)
    codes, where, offsets = [], [], []
    for s, i in number.items():
        padded[i, :len(s)] = np.frombuffer(s, np.uint8)
        c = gram_codes(padded[i, :len(s)], q)
        codes.append(c)
        where.append(np.full(len(c), i, np.int32))
        offsets.append(np.arange(len(c), dtype=np.int32))
    codes, where, offsets = map(np.concatenate, (codes, where, offsets))
    order = np.argsort(codes, kind="stable")
    unique, first = np.unique(codes[order], return_index=True)
    placed = np.argsort(segment, kind="stable")
    return Index(q, edits + 1, length, [i for i, _ in rows], folds, np.array(owner)[placed], np.array(starts_at)[placed], np.array(whole)[placed],
                 np.searchsorted(np.array(segment)[placed], np.arange(len(number) + 1)), padded, sizes, budgets, sizes - q + 1 - budgets * q,
                 unique, np.append(first, len(order)), where[order], offsets[order])


def aligned(index: Index, segments: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edit distance of each segment to a part of its region, with the part's edges; only diagonals 0 to width - 1."""
    n, width = len(segments), regions.shape[1] - index.length + 1
    far = 1 << 20
    cost = np.zeros((n, width), np.int32)
    begin = np.broadcast_to(np.arange(width), (n, width)).copy()
    ramp = np.arange(width)
    best, best_begin, best_end = np.full(n, far), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(index.length + 1):
        done = np.flatnonzero(index.sizes[segments] == j)
        if len(done):
            w = cost[done].argmin(1)
            best[done], best_begin[done], best_end[done] = cost[done, w], begin[done, w], w + j
        if j == index.length:
            break
        match = cost + (index.bytes[segments, j][:, None] != regions[:, j:j + width])
        skip = np.concatenate([cost[:, 1:] + 1, np.full((n, 1), far)], 1)
        new = np.minimum(match, skip)
        origin = np.where(match <= skip, begin, np.concatenate([begin[:, 1:], begin[:, -1:]], 1))
        # bytes of the region that the segment lacks: the least of all cells to the left plus the way from there
        slant = (new - ramp) * width + ramp
        source = np.minimum.accumulate(slant, 1) % width
        cost = np.take_along_axis(new, source, 1) + (ramp - source)
        begin = np.take_along_axis(origin, source, 1)
    return best, best_begin, best_end


def found_in(index: Index, data: np.ndarray, edges: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, segment, begin, end) of each verified segment in folded bytes."""
    none = (np.zeros(0, np.int64),) * 4
    codes = gram_codes(data, index.q)
    at = np.flatnonzero(table[(codes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
    slot = np.minimum(np.searchsorted(index.codes, codes[at]), len(index.codes) - 1)
    same = index.codes[slot] == codes[at]
    at, slot = at[same], slot[same]
    text = np.searchsorted(edges, at, "right") - 1
    inside = at + index.q <= edges[text + 1]
    at, slot, text = at[inside], slot[inside], text[inside]
    if not len(at):
        return none
    bands = (np.diff(edges).max() + index.length) // index.step + 2
    times = index.begins[slot + 1] - index.begins[slot]
    stop = np.cumsum(times)
    held, cut = [], 0
    while cut < len(at):  # a bounded number of hits at a time; one place at least
        end = max(cut + 1, int(np.searchsorted(stop, (stop[cut - 1] if cut else 0) + HITS, "right")))
        n, base = times[cut:end], stop[cut - 1] if cut else 0
        hit = np.arange(stop[end - 1] - base) + np.repeat(index.begins[slot[cut:end]] - (stop[cut:end] - n - base), n)
        owner = np.repeat(text[cut:end], n)
        diagonal = np.repeat(at[cut:end], n) - edges[owner] - index.offsets[hit] + index.length  # 0 or more
        key = (owner * len(index.sizes) + index.segments[hit]) * bands + diagonal // index.step + 1
        held.append(np.unique(np.concatenate([key, key - 1]), return_counts=True))
        cut = end
    keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    counts = np.bincount(back, np.concatenate([c for _, c in held]), len(keys))
    segment = keys // bands % len(index.sizes)
    good = counts >= index.bounds[segment]
    keys, segment = keys[good], segment[good]
    if not len(keys):
        return none
    text = keys // bands // len(index.sizes)
    slack = index.step
    low = edges[text] + (keys % bands - 1) * index.step - index.length - slack
    out = []
    for k in range(0, len(keys), 4096):
        part = slice(k, k + 4096)
        place = low[part, None] + np.arange(index.length + 2 * index.step + 2 * slack)
        outside = (place < edges[text[part], None]) | (place >= edges[text[part] + 1, None])
        region = np.where(outside, 0, data[np.clip(place, 0, len(data) - 1)])
        cost, begin, end = aligned(index, segment[part], region)
        fits = cost <= index.budgets[segment[part]]
        out.append((text[part][fits], segment[part][fits], (low[part] + begin)[fits], (low[part] + end)[fits]))
    text, segment, begin, end = map(np.concatenate, zip(*out))
    return text, segment, np.maximum(begin, edges[text]), np.minimum(end, edges[text + 1])


def equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading bytes of both are equal."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def passage(index: Index, data: np.ndarray, item: np.ndarray, places: np.ndarray, sizes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[set[int], int, int] | None:
    """Which of an item's verified segments in a text (``data``) are part of a passage, by their places in the index, and the first and last
    byte of these; None without any."""
    chains, open_ones, reach = [], [], {}
    for k in np.lexsort((places, begins)).tolist():
        segment, begin, end = int(places[k]), int(begins[k]), int(ends[k])
        low = int(index.place_start[segment])
        high = low + int(sizes[k])
        if end <= reach.get((begin - low, end - high), (0, None))[0]:  # within what an earlier one was lengthened to
            chain = reach[begin - low, end - high][1]
        else:
            before = equal_run(item[:low][::-1], data[max(0, begin - low):begin][::-1])
            after = equal_run(item[high:], data[end:end + len(item) - high])
            low, high, begin, end = low - before, high + after, begin - before, end + after
            open_ones = [c for c in open_ones if begin - c["end"] <= index.length]
            near = [c for c in open_ones if low - c["high"] <= index.length and abs(begin - low - c["diagonal"]) <= index.length // 2]
            if near:
                chain = min(near, key=lambda c: abs(begin - low - c["diagonal"]))
            else:
                chain = {"begin": begin, "end": end, "high": low, "covered": 0, "whole": False, "segments": set()}
                chains.append(chain)
                open_ones.append(chain)
            chain["covered"] += max(0, high - max(low, chain["high"]))
            chain["high"], chain["end"], chain["diagonal"] = max(high, chain["high"]), max(end, chain["end"]), end - high
            chain["begin"] = min(begin, chain["begin"])
            reach[begin - low, end - high] = end, chain
        chain["whole"] |= bool(index.whole[segment])
        chain["segments"].add(segment)
    good = [c for c in chains if c["whole"] or c["covered"] >= index.length]
    return (set().union(*(c["segments"] for c in good)), min(c["begin"] for c in good), max(c["end"] for c in good)) if good else None


def windows(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the windows of some texts, and the text of each."""
    n = 1 + np.maximum(0, np.diff(cuts) - OVERLAP - 1) // (WINDOW - OVERLAP)
    text = np.repeat(np.arange(len(n)), n)
    begin = cuts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * (WINDOW - OVERLAP)
    return begin, np.minimum(begin + WINDOW, cuts[text + 1]), text


def passages_in(index: Index, data: np.ndarray, edges: np.ndarray, table: np.ndarray) -> dict[int, list[tuple[int, set[int], int, int]]]:
    """By window (item, places of its segments, begin, end in the window) of what is found in it."""
    text, segment, begin, end = found_in(index, data, edges, table)
    out: dict[int, list[tuple[int, set[int], int, int]]] = {}
    if not len(text):
        return out
    times = index.places[segment + 1] - index.places[segment]
    row = np.repeat(np.arange(len(text)), times)
    place = np.arange(len(row)) + np.repeat(index.places[segment] - (np.cumsum(times) - times), times)
    pairs, back = np.unique(text[row] * len(index.items) + index.place_item[place], return_inverse=True)
    order = np.argsort(back, kind="stable")
    stops = np.searchsorted(back[order], np.arange(len(pairs) + 1))
    for p, pair in enumerate(pairs.tolist()):
        mine, (t, item) = order[stops[p]:stops[p + 1]], divmod(pair, len(index.items))
        r = row[mine]
        held = passage(index, data[edges[t]:edges[t + 1]], index.item_bytes[item], place[mine], index.sizes[segment[r]], begin[r] - edges[t], end[r] - edges[t])
        if held:
            out.setdefault(t, []).append((item, *held))
    return out


def leaks_of(index: Index, texts: pa.Array, table: np.ndarray) -> list[list[dict]]:
    """Per text a row for each item with a passage. ``texts`` is a slice that ``pieces`` gave."""
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[edges[0]:edges[-1]] if raw is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    data, cuts, place = folded(raw, edges)
    low, high, text = windows(data, cuts)
    _, first, like = np.unique(span_hashes(data, low, high), return_index=True, return_inverse=True)
    inside = np.arange((high[first] - low[first]).sum())
    sizes = high[first] - low[first]
    ends = np.cumsum(sizes)
    found = passages_in(index, data[inside + np.repeat(low[first] - (ends - sizes), sizes)], np.append(0, ends), table)
    if not found:
        return out
    merged: dict[tuple[int, int], list] = {}
    for w in np.flatnonzero(np.isin(like, list(found))).tolist():
        for item, segments, begin, end in found[int(like[w])]:
            begin, end = begin + int(low[w]), end + int(low[w])
            held = merged.setdefault((int(text[w]), item), [set(), begin, end])
            held[0] |= segments
            held[1], held[2] = min(held[1], begin), max(held[2], end)
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    total = np.bincount(index.place_item, minlength=len(index.items))
    for (t, item), (segments, begin, end) in sorted(merged.items(), key=lambda m: m[0]):
        out[t].append({"item_id": index.items[item], "n_found": len(segments), "n_segments": int(total[item]),
                       "start": int(point[place[begin]] - point[edges[t]]), "end": int(point[place[end - 1] + 1] - point[edges[t]])})
    return out


def leaks(index: Index, kind: str = "bigint", column="text") -> Column:
    """The items with at least one passage in a text: how many of its segments, and the first and last place of these."""
    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = pa.list_(pa.struct([("item_id", pa.string() if kind == "string" else pa.int64()), ("n_found", pa.int32()), ("n_segments", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        table = np.zeros(1 << TABLE_BITS, bool)
        table[(index.codes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        for batch in texts:
            yield pa.array([x for _, p in pieces(batch) for x in leaks_of(index, p, table)], rows)
        give_back()
    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, LEAKS.format(kind)).asNondeterministic()(F.col(column))


def blocks_of(benchmark: DataFrame, block: int) -> tuple[DataFrame, int]:
    """The items that can be searched for, and in how many blocks."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return items, 1 + size * 2 // block


def indexes(items: DataFrame, blocks: int, length: int, edits: int, q: int) -> Iterator[Index]:
    """One index per block of items, collected when it is asked for."""
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if found := index_of(sorted((r.item_id, r.text) for r in mine), length, edits, q):
            yield found


def kind_of(benchmark: DataFrame) -> str:
    """Item ids are whole numbers or text."""
    return "string" if benchmark.schema["item_id"].dataType.simpleString() == "string" else "bigint"


def contaminations(docs: DataFrame, benchmark: DataFrame, block: int = 1 << 20, length: int = 60, edits: int = 4, q: int = 10) -> DataFrame:
    """A row for each document and item of which it holds a passage: doc_id, item_id, n_found, n_segments, start, end."""
    kind = kind_of(benchmark)
    out = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind}, n_found int, n_segments int, start int, end int")
    items, blocks = blocks_of(benchmark, block)
    for index in indexes(items, blocks, length, edits, q):
        found = docs.select("doc_id", F.explode(leaks(index, kind)).alias("_leak")).select("doc_id", "_leak.*")
        out = out.union(found if blocks == 1 else stored(found, "leaks"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, block: int = 1 << 20, length: int = 60, edits: int = 4, q: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns.

    One block is a filter of the same scan. With more, each block's findings are written as the digests of the texts that hold something.
    """
    items, blocks = blocks_of(benchmark, block)
    names, gone = docs.columns, None
    mark = next(n for n in (f"_leaks{i}" for i in range(len(names) + 1)) if n not in names)
    for index in indexes(items, blocks, length, edits, q):
        held = leaks(index, kind_of(benchmark))
        if blocks == 1:
            return docs.withColumn(mark, held).where(F.size(mark) == 0).drop(mark)
        found = docs.select(F.sha2("text", 256).alias(mark), held.alias("held")).where(F.size("held") > 0).select(mark)
        found = stored(found, "leaks")
        gone = found if gone is None else gone.union(found)
    if gone is None:
        return docs
    return docs.withColumn(mark, F.sha2("text", 256)).join(gone.distinct(), mark, "left_anti").select(*names)
