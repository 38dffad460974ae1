"""Byte-level BPE by speculation and verification, and decoding.

The text is cut into pieces as the vocabulary's pre-tokeniser does; strings of special tokens are cut out first and keep their own
id. For pieces not met before, greedy longest match (an Aho-Corasick automaton over all new pieces of a batch at once) proposes
tokens. A proposal is right if every token is what merging its own bytes gives and if no neighbouring pair would have merged
across its border earlier; the second is tested for all neighbouring pairs of all new pieces in one vectorised descent along
their merge trees. Only pieces that fail are merged exactly, with a heap. Results of pieces are remembered, up to a bound.

Defined results: a null text is an empty one and has no ids; ids unknown to the vocabulary are passed over in decoding; bytes that
are not UTF-8 decode to U+FFFD. Other columns and repeated rows play no part: a row depends on its own text alone.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import kept_in_worker, pieces, ship

ship(__name__)

#: How byte-level vocabularies cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII and the Latin letters below U+0250, in the faster standard library.
LATIN = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
OTHER = r"[^\t-\r -~À-ɏ]"
GAP = "Ā"
NEVER = np.int64(1 << 40)
REMEMBERED = 150_000
PIECE_BYTES = 1 << 19
DECODED = 256


def byte_letters() -> dict[str, int]:
    """The visible letter by which such vocabularies write each byte: itself where printable, else the next from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokens:
    """The bytes of every token of a byte-level BPE file; enough to decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.read(json.load(file))

    def read(self, read: dict) -> None:
        letters, model = byte_letters(), read["model"]
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, i in model["vocab"].items():
            if token not in self.special:
                self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.size = size
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """Texts of the lists of ids between the edges."""
        known = (ids >= 0) & (ids < self.size)
        if not known.all():
            edges = np.concatenate([[0], np.cumsum(known)])[edges]
            ids = ids[known]
        sizes = self.lengths[ids]
        stop = np.cumsum(sizes)
        out = self.flat[np.repeat(self.begins[ids] - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)]
        cuts = np.concatenate([[0], stop])[edges]
        inner = cuts[cuts < len(out)]
        raw = out.tobytes()
        try:
            raw.decode()
            whole = not ((out[inner] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if not whole:
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])], pa.string())
        return pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.string())


class Vocabulary(Tokens):
    """Also the merges, and what encoding needs."""

    def read(self, read: dict) -> None:
        import ahocorasick
        import regex

        super().read(read)
        model, size = read["model"], self.size
        self.id_of = {b: i for i, b in enumerate(self.bytes) if b and i not in set(self.special.values())}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pairs = np.array([[model["vocab"][a], model["vocab"][b], model["vocab"][a + b]] for a, b in merges], np.int64)
        keys = pairs[:, 0] * size + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.coded = {(a, b): rank << 32 | c for rank, (a, b, c) in enumerate(pairs.tolist())}
        self.left, self.right, self.formed = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)
        for column, into in ((0, self.left), (1, self.right)):
            into[pairs[::-1, 2]] = pairs[::-1, column]
        self.formed[pairs[::-1, 2]] = np.arange(len(pairs))[::-1]
        self.sound = self._sound()
        self.automaton = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.cut, self.latin, self.other = regex.compile(PATTERN), re.compile(LATIN), re.compile(OTHER)
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def _sound(self) -> np.ndarray:
        """Which tokens come out when their own bytes are merged."""
        sound = np.zeros(self.size, bool)
        sound[[i for b, i in self.id_of.items() if len(b) == 1]] = True
        made = np.flatnonzero(self.formed >= 0)
        alone = np.ones(self.size, bool)
        alone[made] = self.compatible(self.left[made], self.right[made], self.formed[made])
        for i in made[np.argsort(self.formed[made])]:
            sound[i] = alone[i] and sound[self.left[i]] and sound[self.right[i]]
        return sound

    def compatible(self, a: np.ndarray, b: np.ndarray, until=NEVER) -> np.ndarray:
        """Whether no merge across the border between tokens a and b comes before rank ``until``.

        Going back in time, the token formed last is split, so that a and b are always the two pieces at the border that exist
        together. A merge of them comes first if its rank is below that of the merge which takes a, and not above that of the
        one which takes b (of equal pairs the left one goes first).
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        takes_a = np.broadcast_to(until, a.shape).astype(np.int64)
        takes_b = takes_a.copy()
        while len(at):
            key = a * self.size + b
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[place] == key, self.ranks[place], NEVER)
            bad = (rank < takes_a) & (rank <= takes_b)
            good[at[bad]] = False
            since_a, since_b = self.formed[a], self.formed[b]
            on = ~bad & ((since_a >= 0) | (since_b >= 0))
            split_a = since_a > since_b
            takes_a, takes_b = np.where(split_a, since_a, takes_a)[on], np.where(split_a, takes_b, since_b)[on]
            a, b = np.where(split_a, self.right[a], a)[on], np.where(split_a, b, self.left[b])[on]
            at = at[on]
        return good

    def merged(self, piece: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, of equal ones the leftmost."""
        if len(piece) > 48:
            return self._merged_long(piece)
        ids = [self.id_of[piece[i:i + 1]] for i in range(len(piece))]
        found, none = self.coded.get, 1 << 62
        ranks = [found(p, none) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i:i + 2] = [least & 0xFFFFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = found((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = found((ids[i], ids[i + 1]), none)
        return ids

    def _merged_long(self, piece: bytes) -> list[int]:
        ids = [self.id_of[piece[i:i + 1]] for i in range(len(piece))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.coded[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.coded]
        heapq.heapify(heap)
        while heap:
            code, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= len(ids) or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = code & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (found := self.coded.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (found, left, (ids[left], ids[right])))
        return [i for i in ids if i >= 0]

    def learn(self, new: list[str]) -> tuple[int, int]:
        """Adds the encodings of pieces to the remembered ones; returns how many there were and how many failed the test."""
        raw = [p.encode() for p in new]
        proposal = list(self.automaton.iter_long(GAP.join(r.decode("latin-1") for r in raw)))
        ends = np.fromiter((e for e, _ in proposal), np.int64, len(proposal))
        ids = np.fromiter((v[0] for _, v in proposal), np.int64, len(proposal))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        borders = np.cumsum(sizes + 1) - 1
        piece = np.searchsorted(borders, ends)
        cuts = np.searchsorted(ends, np.concatenate([[0], borders]))
        covered = np.bincount(piece, np.fromiter((v[1] for _, v in proposal), np.int64, len(proposal)), len(raw))
        fails = covered != sizes
        fails[piece[~self.sound[ids]]] = True
        same = np.flatnonzero(piece[1:] == piece[:-1])
        pairs, back = np.unique(ids[same] * self.size + ids[same + 1], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)
        fails[piece[same[~fits[back]]]] = True
        flat = ids.astype("<i4").tobytes()
        for k, (text, failed) in enumerate(zip(new, fails.tolist())):
            self.known[text] = (np.array(self.merged(raw[k]), "<i4").tobytes() if failed else flat[4 * cuts[k]:4 * cuts[k + 1]])
        return len(new), int(fails.sum())

    def cut_up(self, text: str) -> list[str | int]:
        """Pieces of a text; special tokens as their ids."""
        if self.marks is not None and any(mark in text for mark in self.special):
            parts = self.marks.split(text)
            return [x for k, part in enumerate(parts) for x in ([self.special[part]] if k % 2 else self.cut_up(part))]
        return (self.cut if self.other.search(text) else self.latin).findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut_up(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known.update({i: np.array([i], "<i4").tobytes() for i in self.special.values()})
        new = list(set().union(*cut).difference(self.known))
        if new:
            self.learn(new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, c)), "<i4") for c in cut]


def encode(path: str, column="text") -> Column:
    """Token ids (array<int>) of a text column."""
    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = kept_in_worker(f"bpe {path}", lambda: Vocabulary(path))
        for batch in texts:
            for _, piece in pieces(batch, PIECE_BYTES):
                yield _encoded(own, piece)
    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "array<int>").asNondeterministic()(F.col(column))


def decode(path: str, column="ids") -> Column:
    """Text of a column of token ids; null ids give an empty text."""
    def batches(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = kept_in_worker(f"tokens {path}", lambda: Tokens(path))
        for batch in lists:
            for k in range(0, len(batch), DECODED):
                yield _decoded(own, batch.slice(k, DECODED))
    batches.__annotations__ = {"lists": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "string").asNondeterministic()(F.col(column))


def round_trip(path: str, column="text") -> Column:
    """``ids`` of a text column and the ``text`` that decoding these ids gives. One function for both needs half as many Python
    workers at a time as ``decode`` over ``encode``."""
    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = kept_in_worker(f"bpe {path}", lambda: Vocabulary(path))
        for batch in texts:
            for _, piece in pieces(batch, PIECE_BYTES):
                ids = _encoded(own, piece)
                yield pa.StructArray.from_arrays([ids, _decoded(own, ids)], ["ids", "text"])
    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "struct<ids:array<int>,text:string>").asNondeterministic()(F.col(column))


def _encoded(own: Vocabulary, texts: pa.Array) -> pa.Array:
    ids = own.encode(texts.to_pylist())
    edges = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids).astype(np.int32)))


def _decoded(own: Tokens, lists: pa.Array) -> pa.Array:
    return own.decode(*_lists(lists))


def _lists(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and edges of an array of lists; null values are passed over, a null list is an empty one."""
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(batch).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = pc.list_flatten(batch)
    if flat.null_count:
        flat = flat.fill_null(-1)
    return flat.to_numpy(zero_copy_only=False).astype(np.int64), edges
