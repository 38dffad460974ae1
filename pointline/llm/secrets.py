"""Secrets: three fixed patterns, and random strings told from ordinary identifiers by two character Markov models.

Both models give the probability of a character after the two before it, by classes that keep every letter and digit apart. They
are trained from a bounded sample of labelled rows (``rows`` ids; of a text at most ``RUNS`` different runs). Ordinary are the runs of characters of
texts of good quality that no fixed pattern overlaps, as they stand, in capitals and joined to paths, slugs, versions, camel case and dates,
and a few words that identifiers are made of; random are what the fixed patterns hold in labelled texts, and strings drawn with a fixed seed
from the alphabets that keys use. A candidate is a run of at least ``least`` characters of A-Za-z0-9+/_=- (without what a path or assignment
puts around it, if that part is long enough); the log-likelihood ratio alone decides: at least ``ratio`` in all and ``mean`` per character. What a
fixed pattern overlaps is no candidate.

Defined results: a null text is an empty one and has no spans. Spans are code points, end exclusive, in the order of their start, then
assign, access, hex, model. Texts are judged whole and each on its own. Without labelled rows of good quality there is no ordinary model
and nothing is added to the fixed patterns.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, labelled_features, per_text, pieces, ship, warn_without_model

ship(__name__)

#: The patterns that always count, the least length of what they must hold, and the order of kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "model")

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODES = np.full(256, 0, np.int64)
CODES[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(1, len(LETTERS) + 1)
STATES = len(LETTERS) + 1
LONG = 16
RUNS = 400
#: Words that paths and identifiers are made of, beside those of the corpus.
PARTS = ("usr", "local", "lib", "bin", "etc", "var", "tmp", "opt", "home", "root", "src", "test", "tests", "main", "index", "site", "packages", "python", "java", "node",
         "modules", "build", "release", "notes", "final", "draft", "photo", "image", "large", "small", "thumb", "video", "audio", "docs", "data", "file", "files", "user",
         "users", "admin", "config", "settings", "static", "assets", "public", "private", "content", "article", "page", "pages", "blog", "post", "posts", "news", "category",
         "product", "products", "search", "query", "result", "results", "http", "https", "www", "com", "org", "net", "html", "index", "style", "script", "json", "xml",
         "version", "update", "install", "download", "upload", "server", "client", "service", "handler", "manager", "factory", "controller", "request", "response",
         "session", "token", "number", "string", "array", "object", "class", "function", "method", "value", "default", "error", "message", "report", "summary", "backup",
         "archive", "monthly", "weekly", "january", "february", "march", "april", "august", "september", "october", "november", "december", "numpy", "windows", "linux")
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", LETTERS[:62], LETTERS[:64], LETTERS[:26] + "234567", LETTERS[:62] + "_-", LETTERS[26:62])


@dataclass
class Model:
    """Log-likelihood ratio of random to ordinary for each character after the two before it."""

    ratio: np.ndarray

    def score(self, token: str) -> float:
        c = np.concatenate([[0, 0], CODES[np.frombuffer(token.encode(), np.uint8)]])
        return float(self.ratio[(c[:-2] * STATES + c[1:-1]) * STATES + c[2:]].sum())


def counted(tokens: list[str]) -> np.ndarray:
    """Log-probabilities, smoothed by those after one character only, and these by an even share."""
    data = np.frombuffer("\n\n".join(["", *tokens]).encode("ascii", "replace"), np.uint8)
    c = CODES[data]
    at = np.flatnonzero(c[2:] > 0) + 2
    three = np.bincount((c[at - 2] * STATES + c[at - 1]) * STATES + c[at], minlength=STATES ** 3).reshape(-1, STATES).astype(float)
    two = three.reshape(STATES, STATES, STATES).sum(0)
    even = np.full(STATES, 1 / (STATES - 1))
    back = (two + 5 * even) / (two.sum(1, keepdims=True) + 5)
    back = np.tile(back, (STATES, 1))
    return np.log((three + 10 * back) / (three.sum(1, keepdims=True) + 10)).ravel()


def runs_of(texts: pa.Array) -> list[bytes]:
    """Of each text its different runs of characters (``o`` before each) and what fixed patterns hold (``r``): those of least hash, if there are many."""
    out = []
    for text in texts.to_pylist():
        base = fixed(text, True, True)
        edges = sorted((s, e) for s, _, e in base)
        held = {f"r{re.split('[=:]', text[s:e], maxsplit=1)[-1].strip(chr(34) + chr(39) + ' ') if k == 0 else text[s:e]}" for s, k, e in base}
        ordinary, at = set(), 0
        for m in re.finditer("[A-Za-z0-9+/_=-]{3,64}", text):
            while at < len(edges) and edges[at][1] <= m.start():
                at += 1
            if at == len(edges) or edges[at][0] >= m.end():
                ordinary.add("o" + m[0])
        chosen = [sorted(x, key=lambda w: zlib.crc32(w.encode()))[:RUNS] for x in (held, ordinary)]
        out.append("\n".join(chosen[0] + chosen[1]).encode())
    return out


def likely(found: list[str], draw: random.Random) -> list[str]:
    """Ordinary identifiers made of words as they occur: paths, slugs, versions, dates, camel case, numbers."""
    words = [w for w in found if w.isalpha()]
    words += list(PARTS) * max(1, len(words) // (2 * len(PARTS)))

    def word() -> str:
        return draw.choice(words)

    def number() -> str:
        return str(draw.randrange(10 ** draw.randint(1, 6)))

    def day(sign: str) -> str:
        return f"{draw.randint(1990, 2030)}{sign}{draw.randint(1, 12):02}{sign}{draw.randint(1, 28):02}"
    out = found + [w.upper() for w in found[::5]] + list(PARTS) * 20
    for sign in "-_/+":
        for _ in range(2500):
            out.append(sign.join(word() for _ in range(draw.randint(2, 6))))
            out.append(sign.join(draw.choice((word, word, number, lambda: day(sign)))() for _ in range(draw.randint(2, 6))))
            out.append(sign.join(word().capitalize() for _ in range(draw.randint(2, 6))))
            out.append(sign + word() + sign + word().upper() + draw.choice(("-", "_", "")) + number())
    for _ in range(2500):
        out.append("/".join([word(), word() + draw.choice("-_") + word(), draw.choice((number(), day("/"), word() + number()))]))
        out.append("".join(word().capitalize() for _ in range(draw.randint(2, 4))))
        out.append(word() + "".join(word().capitalize() for _ in range(draw.randint(1, 3))) + draw.choice(("", number())))
        out.append("".join(word() for _ in range(draw.randint(2, 3))) + draw.choice(("", number())))
        out.append(word() + "=" + draw.choice((word(), number(), day("-"))))
        out.append(f"{draw.choice(('v', ''))}{draw.randrange(20)}-{draw.randrange(100)}-{word()}{draw.randrange(10)}")
    out += ["".join(draw.choice("0123456789") for _ in range(draw.randint(1, 20))) for _ in range(10000)]
    out += ["".join(draw.choice("0123456789abcdef") if c == "x" else c for c in "xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxxxxxx") for _ in range(300)]
    return out + [c * draw.randint(5, 60) for c in "=-_+/" for _ in range(50)]


def fit(sample: list[tuple[bytes, int]], seed: int = 7) -> Model | None:
    """From the ``runs_of`` labelled texts; the label says which texts are good."""
    draw = random.Random(seed)
    told = [(run, good) for runs, good in sample for run in runs.decode().split("\n")]
    found = sorted({run[1:] for run, good in told if good and run[:1] == "o" and not run[1:].isdigit()})
    if not found:
        return None
    hits = sorted({run[1:] for run, _ in told if run[:1] == "r"})
    strings = ["".join(draw.choice(a) for _ in range(draw.randint(16, 48))) for a in ALPHABETS for _ in range(3000)]
    return Model((counted(strings + hits) - counted(likely(found, draw))).astype(np.float32))


def fixed(text: str, keyword: bool, long: bool) -> list[tuple[int, int, int]]:
    """Spans of the fixed patterns as (start, kind, end); leftmost first and not overlapping within a kind."""
    out = []
    if keyword:
        out += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= LEAST["assign"]]
    if long:
        out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if len(m[0]) >= LEAST["access"]]
        out += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text) if len(m[0]) >= LEAST["hex"]]
    return out


def spans_of(text: str, long: bool, model: Model | None, least: int, ratio: float, mean: float) -> list[dict]:
    low = text.lower()
    base = fixed(text, any(w in low for w in WORDS), long)
    out = [(*s, 0.0) for s in base]
    if long and model:
        for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{least},}}", text):
            if any(s < m.end() and m.start() < e for s, _, e in base):
                continue
            for part in (m[0], *(p for p in re.split("[/=]", m[0]) if least <= len(p) < len(m[0]))):
                if (score := model.score(part)) >= max(ratio, mean * len(part)):
                    begin = m.start() + m[0].index(part)
                    out.append((begin, 3, begin + len(part), score))
                    break
    return [{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in sorted(out)]


def long_runs(texts: pa.Array, least: int) -> np.ndarray:
    """Which of the texts have ``least`` characters of the alphabet in a row. ``texts`` is a slice that ``pieces`` gave."""
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edges[0]:edges[-1]] if raw is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    breaks = np.concatenate([[-1], np.flatnonzero(CODES[data] == 0), [len(data)]])
    runs = np.flatnonzero(np.diff(breaks) > least)  # a run over the edge of two texts only costs a look
    hit = np.zeros(len(data) + 1, np.int64)
    np.add.at(hit, breaks[runs] + 1, 1)
    np.add.at(hit, breaks[runs + 1], -1)
    return per_text(np.cumsum(hit[:-1]), edges) > 0


def found(model: Model | None, least: int = LONG, ratio: float = 9.0, mean: float = 0.4, column="text") -> Column:
    """Spans of all secrets of a text; ``score`` is the log-likelihood ratio, 0 for the fixed patterns."""
    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in texts:
            out = []
            for _, piece in pieces(batch):
                for text, long in zip(piece.to_pylist(), long_runs(piece, min(least, LEAST["access"])).tolist()):
                    out.append(spans_of(text, long, model, least, ratio, mean))
            yield pa.array(out, kind)
        give_back()
    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, SPANS).asNondeterministic()(F.col(column))


def trained(docs: DataFrame, labels: DataFrame, rows: int = 1000) -> Model | None:
    sample = labelled_features(docs, labels, rows, runs_of)
    return warn_without_model(__name__, fit(sample), len(sample))
