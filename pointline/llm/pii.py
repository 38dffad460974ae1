"""Format-preserving pseudonyms for personal data.

Found and validated: e-mail addresses, IPv4 addresses (each part 0-255), payment card numbers (13-19 digits, Luhn), IBANs
(mod 97), US social security numbers, international and North American phone numbers, dates of 1900-2099. A value is read as a
number within its format and permuted by a keyed Feistel network; values outside the format are walked past (cycle walking), so
the map is a permutation of the valid values: equal values get equal pseudonyms in every document, different values different
ones, and the key's holder can turn them back. Case, separators and padding stay; check digits are made anew, so a pseudonym of
a card or an IBAN is valid again. Numbers that fail validation are left alone. A day that is written with another number of digits
(``5/7/1990``, ``05/07/1990``) has another pseudonym, as each is permuted among the days that can be written like it.

Not found: North American phone numbers and social security numbers with spaces or without separators, IPv6 addresses, dates with the
month's name, IBANs in lower case or with hyphens, cards with dots or several spaces, phones with no-break spaces.

At a place every length that the format allows is tried, and cards and IBANs may start and end at any group, so that an expiry, a security code, a
BIC or a number beside a value doesn't hide it. What then validates by chance with its neighbours (a tenth of such digit groups for cards) is taken too.

Defined results: a null text stays null with no spans; an empty one stays empty. Spans are code points of the input text, end
exclusive, and don't overlap. Of overlapping finds IBANs come first, then cards in a usual grouping, other cards (each the longest first, but
none within an e-mail address), then of the others the one that starts first, the one named first above, the longest; an international phone
number ends before a value that it would cut. Rows are treated each on its own; other columns are passed through. A pseudonym may by chance validate with unusual neighbours where the value did not;
``spans`` as given with the text tells where to turn back, without it they are searched anew.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

RESULT = "struct<text:string,spans:array<struct<kind:string,start:int,end:int>>>"
ROUNDS = 8
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal() - dt.date(1900, 1, 1).toordinal() + 1
KINDS = ("email", "ip", "card", "iban", "ssn", "phone", "date")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
RUN = re.compile(r"[0-9][0-9 ().\-/]{4,}[0-9]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
IBAN_CHARS = 43
PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}")
PHONE_CHARS = 34
GROUPS = re.compile("[0-9]+")
#: Sizes of the groups in which cards are written; one group of any allowed length is usual too.
USUAL = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}
NUMBERS = {
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w)(?!\.[0-9])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+])(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})(?!\w)"),
    "date": re.compile(r"(?<![\w./-])(?:[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{4})(?:(?<=-[0-9][0-9])(?=T[0-9]{2})|(?![\w-]))(?![./][0-9])"),
}
#: The values whose pseudonym can have another length.
SHAPES = {"ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")}


class Feistel:
    """Keyed permutations of ``range(size)`` for any size; ``back`` is the inverse of ``forth``."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.half = size, max(1, (max(2, size) - 1).bit_length() + 1 >> 1)
        self.key, self.tweak, self.mask = key, f"{tweak}:{size}:".encode(), (1 << self.half) - 1

    def _round(self, k: int, x: int) -> int:
        width = (self.half + 7) // 8
        out, block = b"", 0
        while len(out) < width:
            said = self.tweak + bytes([k, block & 255]) + x.to_bytes(width, "big")
            out += hashlib.blake2b(said, key=self.key, digest_size=min(64, width)).digest()
            block += 1
        return int.from_bytes(out[:width], "big") & self.mask

    def forth(self, x: int) -> int:
        if self.size < 2:
            return x
        while True:
            left, right = x >> self.half, x & self.mask
            for k in range(ROUNDS):
                left, right = right, left ^ self._round(k, right)
            x = left << self.half | right
            if x < self.size:
                return x

    def back(self, x: int) -> int:
        if self.size < 2:
            return x
        while True:
            left, right = x >> self.half, x & self.mask
            for k in reversed(range(ROUNDS)):
                left, right = right ^ self._round(k, left), left
            x = left << self.half | right
            if x < self.size:
                return x


def base_of(c: str) -> int:
    return 1 if not c.isascii() else 10 if c.isdigit() else 26 if c.isalpha() else 1


def letters_moved(value: str, tweak: str, key: bytes, step: str) -> str:
    """Permutes the ASCII letters (each within its case) and digits of a value as one number of mixed base; the rest stays."""
    number, size = 0, 1
    for c in value:
        base = base_of(c)
        number = number * base + (int(c) if base == 10 else ord(c.lower()) - 97 if base == 26 else 0)
        size *= base
    number = getattr(Feistel(key, f"{tweak}{''.join({10: '9', 26: 'a'}.get(base_of(c), c) for c in value)}", size), step)(number)
    out = []
    for c in reversed(value):
        base = base_of(c)
        number, digit = divmod(number, base)
        out.append(str(digit) if base == 10 else chr((65 if c.isupper() else 97) + digit) if base == 26 else c)
    return "".join(reversed(out))


def refilled(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    given = iter(digits)
    return "".join(next(given) if c.isdigit() else c for c in shape)


def digits_of(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def check_digit(body: str) -> str:
    """Luhn's check digit."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def is_card(value: str) -> bool:
    d = digits_of(value)
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and check_digit(d[:-1]) == d[-1]


def card(value: str, key: bytes, step: str) -> str:
    d = digits_of(value)
    network = Feistel(key, "card", 10 ** (len(d) - 1))
    number = int(d[:-1])
    while True:  # a card of a single repeated digit is no valid value
        number = getattr(network, step)(number)
        body = str(number).zfill(len(d) - 1)
        if is_card(body + check_digit(body)):
            return refilled(value, body + check_digit(body))


def iban_check(country: str, account: str) -> str:
    return str(98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97).zfill(2)


def is_iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and iban_check(v[:2], v[4:]) == v[2:4]


def iban(value: str, key: bytes, step: str) -> str:
    v = value.replace(" ", "")
    account = letters_moved(v[4:], "iban" + v[:2], key, step)
    given = iter(v[:2] + iban_check(v[:2], account) + account)
    return "".join(c if c == " " else next(given) for c in value)


def is_ip(value: str) -> bool:
    return all(int(p) < 256 and (p == "0" or p[0] != "0") for p in value.split("."))


def ip(value: str, key: bytes, step: str) -> str:
    number = int.from_bytes(bytes(map(int, value.split("."))), "big")
    return ".".join(map(str, getattr(Feistel(key, "ip", 1 << 32), step)(number).to_bytes(4, "big")))


def is_ssn(value: str) -> bool:
    d = digits_of(value)
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def ssn(value: str, key: bytes, step: str) -> str:
    network, number = Feistel(key, "ssn", 10 ** 9), int(digits_of(value))
    while True:
        number = getattr(network, step)(number)
        if is_ssn(str(number).zfill(9)):
            return refilled(value, str(number).zfill(9))


def is_phone(value: str) -> bool:
    return 8 + 2 * (value[0] != "+") <= len(digits_of(value)) <= 15


def phone(value: str, key: bytes, step: str) -> str:
    """The country's digits stay."""
    country = re.match(r"\+[0-9]{1,3}(?![0-9])", value)
    at = country.end() if country else 0
    d = digits_of(value[at:])
    moved = getattr(Feistel(key, "phone", 10 ** len(d)), step)(int(d))
    return value[:at] + refilled(value[at:], str(moved).zfill(len(d)))


def day_of(value: str) -> tuple[dt.date, str] | None:
    """The date, and the order of its fields. A leading day is taken before a leading month."""
    parts = [int(p) for p in re.findall("[0-9]+", value)]
    for order in ("ymd",) if len(re.match("[0-9]+", value)[0]) == 4 else ("dmy", "mdy"):
        field = dict(zip(order, parts))
        try:
            day = dt.date(field["y"], field["m"], field["d"])
        except ValueError:
            continue
        if 0 <= day.toordinal() - FIRST_DAY < DAYS:
            return day, order
    return None


def is_date(value: str) -> bool:
    return day_of(value) is not None


def date(value: str, key: bytes, step: str) -> str:
    """A day among those that can be written in the same order and with the same number of digits."""
    day, order = day_of(value)
    network, number = Feistel(key, "date", DAYS), day.toordinal() - FIRST_DAY
    sizes = [len(p) for p in re.findall("[0-9]+", value)]
    while True:
        number = getattr(network, step)(number)
        new = dt.date.fromordinal(number + FIRST_DAY)
        fields = {"y": new.year, "m": new.month, "d": new.day}
        parts = [str(fields[f]).zfill(n) for f, n in zip(order, sizes)]
        if [len(p) for p in parts] == sizes:
            given = iter(parts)
            said = re.sub("[0-9]+", lambda _: next(given), value)
            if day_of(said)[1] == order:  # else it would be read in the other order and not turn back
                return said


def email(value: str, key: bytes, step: str) -> str:
    """The last label of the domain stays."""
    at = value.rindex(".")
    return letters_moved(value[:at], "email", key, step) + value[at:]


VALID: dict[str, Callable[[str], bool]] = {"ip": is_ip, "card": is_card, "ssn": is_ssn, "phone": is_phone, "date": is_date}
MOVE = {"email": email, "ip": ip, "card": card, "iban": iban, "ssn": ssn, "phone": phone, "date": date}


def part_of_word(text: str, at: int) -> bool:
    return at < len(text) and (text[at].isalnum() or text[at] == "_")


def cards_in(text: str, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(rank, start, end) of the valid cards of a run of digits: from each group as many groups as a card can have; the usual groupings have rank 1."""
    groups = [m.span() for m in GROUPS.finditer(text, begin, end)]
    for i, (first, _) in enumerate(groups):
        if first and (text[first - 1] == "." or part_of_word(text, first - 1)):
            continue
        digits, signs = 0, ""
        for k in range(i, len(groups)):
            if k > i:
                sign = text[groups[k - 1][1]:groups[k][0]]
                if sign not in (" ", "-"):
                    break
                signs += sign
            digits += groups[k][1] - groups[k][0]
            if digits > 19:
                break
            if digits >= 13 and not part_of_word(text, groups[k][1]) and is_card(text[first:groups[k][1]]):
                usual = k == i or len(set(signs)) == 1 and tuple(b - a for a, b in groups[i:k + 1]) in USUAL
                yield 1 if usual else 2, first, groups[k][1]


def longer_to_shorter(pattern: re.Pattern, text: str, begin: int, most: int) -> Iterator[int]:
    """Ends of all matches of the pattern at a place that don't end within a word, the longest first."""
    for end in range(min(len(text), begin + most), begin, -1):
        if text[end - 1].isalnum() and not part_of_word(text, end) and pattern.fullmatch(text, begin, end):
            yield end


def spans_of(text: str) -> list[tuple[int, int, str]]:
    mails, checked, found = [], [], []
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin and (text[begin - 1] in LOCAL or text[begin - 1].isalpha()):
            begin -= 1
        while begin < at and text[begin] in ".-%+":
            begin += 1
        if begin < at and (m := DOMAIN.match(text, at)):
            mails.append((begin, m.end()))
            found.append((begin, 0, -m.end(), "email"))
        at = text.find("@", at + 1)
    for run in RUN.finditer(text):
        low = max(0, run.start() - 6)
        part = text[low:run.end() + 4]
        for kind, pattern in NUMBERS.items():
            for m in pattern.finditer(part):
                if m.start() + low >= run.end() or low and not m.start():
                    continue
                if VALID[kind](m[0]):
                    found.append((low + m.start(), KINDS.index(kind), -low - m.end(), kind))
        checked += [(rank, begin - end, begin, end, "card") for rank, begin, end in cards_in(text, run.start(), run.end())]
    others = sorted((begin, -end) for begin, _, end, _ in found)
    at = text.find("+")
    while at >= 0:
        if not (at and (text[at - 1] == "+" or part_of_word(text, at - 1))):
            for end in longer_to_shorter(PHONE, text, at, PHONE_CHARS):
                within = others[bisect.bisect(others, (at, 0)):bisect.bisect(others, (end - 1, len(text) + 1))]
                if is_phone(text[at:end]) and all(e <= end for _, e in within):
                    found.append((at, KINDS.index("phone"), -end, "phone"))
        at = text.find("+", at + 1)
    for m in IBAN_START.finditer(text):
        checked += [(0, m.start() - end, m.start(), end, "iban") for end in longer_to_shorter(IBAN, text, m.start(), IBAN_CHARS) if is_iban(text[m.start():end])]
    out: list[tuple[int, int, str]] = []

    def take(begin: int, end: int, kind: str) -> None:
        at = bisect.bisect(out, (begin, end, kind))
        if (not at or out[at - 1][1] <= begin) and (at == len(out) or out[at][0] >= end):
            out.insert(at, (begin, end, kind))
    for _, _, begin, end, kind in sorted(set(checked)):
        at = bisect.bisect(mails, (begin, len(text) + 1)) - 1
        if at < 0 or mails[at][1] < end:
            take(begin, end, kind)
    for begin, _, end, kind in sorted(set(found)):
        take(begin, -end, kind)
    return out


def moved_spans(text: str, spans: list[dict]) -> list[tuple[int, int, str]]:
    """Where the values of the spans of a text stand in its pseudonymised form; only IPv4 addresses change their length."""
    out, shift = [], 0
    for s in spans:
        begin, end = s["start"] + shift, s["end"] + shift
        if s["kind"] in SHAPES:
            end = SHAPES[s["kind"]].match(text, begin).end()
            shift += end - begin - (s["end"] - s["start"])
        out.append((begin, end, s["kind"]))
    return out


def moved(text: str, key: bytes, step: str = "forth", given: list[dict] | None = None) -> tuple[str, list[dict]]:
    """The text with every value replaced, and the spans of the values in the text given.

    ``given`` are the spans that came with a pseudonymised text.
    """
    spans = spans_of(text) if given is None else moved_spans(text, given)
    if not spans:
        return text, []
    parts, done = [], 0
    for begin, end, kind in spans:
        parts += [text[done:begin], MOVE[kind](text[begin:end], key, step)]
        done = end
    return "".join([*parts, text[done:]]), [{"kind": k, "start": b, "end": e} for b, e, k in spans]


def pseudonymised(key: str, column="text", step: str = "forth", spans: str | None = None) -> Column:
    """``text`` with pseudonyms, and ``spans``. ``step="back"`` turns pseudonyms back; column ``spans`` has those that came with the text."""
    secret = hashlib.sha256(key.encode()).digest()

    def result(pairs) -> pa.StructArray:
        kind = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
        out, found = [], []
        for one, given in pairs:
            one = one.as_py()
            new, spans = (None, []) if one is None else moved(one, secret, step, given)
            out.append(new)
            found.append(spans)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(found, kind[1].type)], ["text", "spans"])

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield result((one, None) for one in batch)

    def batches_back(both: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, given in both:
            yield result((one, g.as_py() or []) for one, g in zip(batch, given))
    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    batches_back.__annotations__ = {"both": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    if spans is not None:
        return F.arrow_udf(batches_back, RESULT).asNondeterministic()(F.col(column), F.col(spans))
    return F.arrow_udf(batches, RESULT).asNondeterministic()(F.col(column))
