"""SentencePiece BPE with byte fallback, in vectorised merge rounds, and decoding.

Spaces become U+2581 and one is put in front. Words that were not met before are merged together, as flat arrays of symbols and of
the rank of each neighbouring pair. A segment is a stretch of a word in which every two neighbouring characters stand together in
some piece of the model: no merge can cross its borders. A round finds the leftmost pair of least rank of every segment, merges
these pairs at once, ranks the pairs beside them anew and compacts the arrays; a segment without a pair left is done. As one merge
a segment and round is what merging one at a time does, the result is exact. A segment that is still open after ``ROUNDS`` rounds
(a very long run without spaces) goes on with a heap instead, since a round touches every open symbol.

Defined results: a null text is an empty one and has no ids; ids unknown to the model are passed over in decoding; bytes that are
not UTF-8 decode to U+FFFD. Other columns and repeated rows play no part: a row depends on its own text alone.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import kept_in_worker, pieces, ship

ship(__name__)

SPACE = "▁"
NEVER, PLACE_BITS = np.int64(1 << 24), 36  # a rank beyond all, and how many bits a place has below its rank
ROUNDS = 100
REMEMBERED_BYTES = 48 << 20
LONG_WORD = 64
#: Kinds of pieces, and what an unknown id decodes to.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SHOWN_UNKNOWN = " ⁇ "


def messages(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(data):
        field, wire = divmod(number(), 8)
        if wire == 0:
            yield field, number()
        else:
            size = number() if wire == 2 else 4 if wire == 5 else 8
            yield field, data[at:at + size]
            at += size


def segments(starts: np.ndarray, total: int) -> np.ndarray:
    """The number of the segment of each of ``total`` places."""
    out = np.zeros(total, np.int64)
    out[starts[1:]] = 1
    return np.cumsum(out)


class Pieces:
    """A model: what its ids stand for, which pairs of symbols merge, and the words met so far."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(messages(file.read()))
        found = [dict(messages(value)) for field, value in fields if field == 1]
        normal = dict(messages(next((value for field, value in fields if field == 3), b"")))
        if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
            raise ValueError("only models with spaces escaped, one put in front and no other normalisation")
        trainer = dict(messages(next((value for field, value in fields if field == 2), b"")))
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("only byte-pair models with byte fallback and spaces in front of words")
        self.names = [f[1].decode() for f in found]
        self.kinds = [f.get(3, NORMAL) for f in found]
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only models without user-defined and unused pieces")
        scores = [struct.unpack("<f", f.get(2, bytes(4)))[0] for f in found]
        self.size = len(found)
        self.id_of = {name: i for i, (name, kind) in enumerate(zip(self.names, self.kinds)) if kind == NORMAL}
        self.of_byte = np.zeros(256, np.int64)
        for name, kind, i in zip(self.names, self.kinds, range(self.size)):
            if kind == BYTE:
                self.of_byte[int(name[1:-1], 16)] = i
        self.spans_spaces = any(re.search(f"[^{SPACE}]{SPACE}", name) for name in self.id_of)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        show = {NORMAL: lambda name: name.replace(SPACE, " ").encode(), UNKNOWN: lambda _: SHOWN_UNKNOWN.encode(), CONTROL: lambda _: b"\xff",
                BYTE: lambda name: bytes([int(name[1:-1], 16)])}
        self.raw = [show[kind](name) for name, kind in zip(self.names, self.kinds)]
        self._pairs(scores)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _pairs(self, scores: list[float]) -> None:
        """Sorted pairs of symbols that merge. A character has the symbol ``size`` + its code point if no piece is that character."""
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
        for name, i in self.id_of.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        self.width = self.size + 0x110000
        order = {score: rank for rank, score in enumerate(sorted({scores[i] for i in self.id_of.values()}, reverse=True))}
        merges, beside = {}, set()

        def symbol(name: str) -> int | None:
            return int(self.symbol[ord(name)]) if len(name) == 1 else self.id_of.get(name)
        for name, i in self.id_of.items():
            beside.update(ord(a) << 21 | ord(b) for a, b in zip(name, name[1:]))
            for k in range(1, len(name)):
                a, b = symbol(name[:k]), symbol(name[k:])
                if a is not None and b is not None:
                    merges[a * self.width + b] = (order[scores[i]], i)
        self.keys = np.array(sorted(merges), np.int64)
        self.ranks = np.array([merges[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([merges[k][1] for k in self.keys.tolist()], np.int64)
        self.beside = np.array(sorted(beside), np.int64)

    def ranked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of pairs and the symbol each gives; ``NEVER`` if none."""
        key = a * self.width + b
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = self.keys[place] == key
        return np.where(fits, self.ranks[place], NEVER), self.made[place]

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of each word, four bytes each."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        key = codes[:-1] << 21 | codes[1:]
        place = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        cut = np.concatenate([[True], self.beside[place] != key])
        cut[edges[:-1]] = True
        out = np.full(len(codes), -1, np.int64)  # the symbol that begins at a character
        self._rounds(self.symbol[codes], np.flatnonzero(cut), out)
        left = np.flatnonzero(out >= 0)
        ids, ends = out[left], np.searchsorted(left, edges)
        strange = np.flatnonzero(ids >= self.size)
        if len(strange):  # characters without a piece become bytes
            raw = [chr(i - self.size).encode() for i in ids[strange].tolist()]
            sizes = np.ones(len(ids), np.int64)
            sizes[strange] = [len(r) for r in raw]
            ids = np.repeat(ids, sizes)
            ids[ids >= self.size] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
            ends = np.concatenate([[0], np.cumsum(sizes)])[ends]
        flat, ends = ids.astype("<i4").tobytes(), (4 * ends).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def _rounds(self, ids: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
        """Merges the symbols of each segment and puts what remains where it begins in ``out``."""
        at, segment = np.arange(len(ids)), segments(starts, len(ids))
        rank, made = np.full(len(ids), NEVER), np.zeros(len(ids), np.int64)  # of the pair that begins at a place
        inner = np.flatnonzero(segment[1:] == segment[:-1])
        rank[inner], made[inner] = self.ranked(ids[inner], ids[inner + 1])
        for turn in range(ROUNDS + 1):
            least = np.minimum.reduceat(rank << PLACE_BITS | np.arange(len(ids)), starts)
            open_, place = least >> PLACE_BITS < NEVER, least & (1 << PLACE_BITS) - 1
            if not open_.all():  # compaction: what is done leaves
                stays = np.repeat(open_, np.diff(np.append(starts, len(ids))))
                out[at[~stays]] = ids[~stays]
                ids, at, rank, made = ids[stays], at[stays], rank[stays], made[stays]
                if not len(ids):
                    return
                moved = np.cumsum(stays) - 1
                starts = moved[starts[open_]]
                place = moved[place[open_]]
            if turn == ROUNDS:
                break
            ids[place] = made[place]
            rank[place], rank[place + 1] = rank[place + 1], NEVER  # a right end of a segment stays one
            keeps = np.ones(len(ids), bool)
            keeps[place + 1] = False
            segment = segments(starts, len(ids))
            ids, at, rank, made, segment = ids[keeps], at[keeps], rank[keeps], made[keeps], segment[keeps]
            moved = np.cumsum(keeps) - 1
            starts, place = moved[starts], moved[place]
            last = np.append(starts[1:], len(ids)) - 1
            right = place[place < last]
            rank[right], made[right] = self.ranked(ids[right], ids[right + 1])
            left = place[place > starts] - 1
            rank[left], made[left] = self.ranked(ids[left], ids[left + 1])
        for begin, end in zip(starts, np.append(starts[1:], len(ids))):
            self._by_heap(ids[begin:end], at[begin:end], rank[begin:end], out)

    def _by_heap(self, ids: np.ndarray, at: np.ndarray, rank: np.ndarray, out: np.ndarray) -> None:
        """Goes on with one segment: always the pair of least rank, of equal ones the leftmost."""
        symbols, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(int(rank[i]), i, symbols[i], symbols[i + 1]) for i in np.flatnonzero(rank < NEVER).tolist()]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.pair(a, b)[1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (found := self.pair(symbols[left], symbols[right])):
                    heapq.heappush(queue, (found[0], left, symbols[left], symbols[right]))
        left = [i for i, s in enumerate(symbols) if s >= 0]
        out[at[left]] = [symbols[i] for i in left]

    def pair(self, a: int, b: int) -> tuple[int, int] | None:
        key = a * self.width + b
        place = int(np.searchsorted(self.keys, key))
        return (int(self.ranks[place]), int(self.made[place])) if place < len(self.keys) and self.keys[place] == key else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = []
        for text in texts:
            text = SPACE + text.replace(" ", SPACE) if text else ""
            cut.append([text] if text and self.spans_spaces else self.words.findall(text))
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        new = list(set().union(*cut).difference(self.known))
        passing = {}
        for word, ids in zip(new, self.merged(new) if new else []):
            if len(word) > LONG_WORD:
                passing[word] = ids
            else:
                self.known[word] = ids
                self.held += 150 + 2 * len(word) + len(ids)
        self.known.update(passing)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, c)), "<i4") for c in cut]
        for word in passing:
            del self.known[word]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: spaces for U+2581, without the one in front of the first piece."""
        try:
            text = b"".join(map(self.raw.__getitem__, ids)).decode()
            if not ids or min(ids) >= 0 and self.kinds[ids[0]] == NORMAL:
                return text[1:] if ids and self.names[ids[0]][0] == SPACE else text
        except (IndexError, UnicodeDecodeError):
            pass
        out, raw, first = [], bytearray(), True
        for i in ids:
            kind = self.kinds[i] if 0 <= i < self.size else None
            if kind == BYTE:
                raw.append(int(self.names[i][1:-1], 16))
                continue
            if raw:
                out.append(shown(bytes(raw)))
                raw.clear()
                first = False
            if kind == NORMAL:
                name = self.names[i]
                out.append((name[1:] if first and name[0] == SPACE else name).replace(SPACE, " "))
                first = False
            elif kind == UNKNOWN:
                out.append(SHOWN_UNKNOWN)
                first = False
        if raw:
            out.append(shown(bytes(raw)))
        return "".join(out)


def shown(raw: bytes) -> str:
    """Bytes as text, U+FFFD for each byte that belongs to no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "surrogateescape").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def encode(path: str, column="text") -> Column:
    """Ids (array<int>) of a text column."""
    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = kept_in_worker(f"pieces {path}", lambda: Pieces(path))
        for batch in texts:
            for _, piece in pieces(batch):
                yield lists(own.encode(piece.to_pylist()))
    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "array<int>").asNondeterministic()(F.col(column))


def decode(path: str, column="ids") -> Column:
    """Text of a column of ids; null ids give an empty text."""
    def batches(batch: pa.Array) -> pa.Array:
        own = kept_in_worker(f"pieces {path}", lambda: Pieces(path))
        return pa.array([own.decode([i for i in x.as_py() or () if i is not None]) for x in batch], pa.string())
    batches.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(batches, "string").asNondeterministic()(F.col(column))


def round_trip(path: str, column="text") -> Column:
    """``ids`` of a text column and the ``text`` that decoding these ids gives, in one function and one Python worker."""
    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = kept_in_worker(f"pieces {path}", lambda: Pieces(path))
        for batch in texts:
            for _, piece in pieces(batch):
                ids = own.encode(piece.to_pylist())
                back = pa.array([own.decode(i.tolist()) for i in ids], pa.string())
                yield pa.StructArray.from_arrays([lists(ids), back], ["ids", "text"])
    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "struct<ids:array<int>,text:string>").asNondeterministic()(F.col(column))


def lists(ids: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))
