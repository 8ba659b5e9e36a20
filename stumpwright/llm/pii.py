"""Operator 2: personal data replaced by format-preserving Feistel pseudonyms.

E-mail addresses, IPv4 addresses, payment card numbers (Luhn), IBANs (mod 97), US social security
numbers, telephone numbers and dates are found and validated; each value becomes a rank within its
format, the rank is permuted by a keyed Feistel network (with cycle walking to the format's size),
and the permuted rank is written in the value's own layout: separators, length, letter case and
check digits stay right. Equal values get equal pseudonyms in every document, distinct values
distinct ones, and no value is its own pseudonym. ``Pseudonyms.inverse`` undoes it with the key.

Dates are YYYY-MM-DD (or with / or .), MM/DD/YYYY, DD/MM/YYYY where the day can't be a month, DD.MM.YYYY
and DD-MM-YYYY, of 1900 to 2099, with days and months of one or two digits; the layout stays. Telephone
numbers are North American ones and international ones from a plus on. Not found are IPv6 addresses,
national numbers of other countries without a plus, dates in words, and secrets without a format.

The key is the caller's secret; there is no default. ``secret`` reads it from the session's setting KEY,
or draws a random one for the call, whose pseudonyms link within its output only.

Values stay in their class: a card keeps its first digit, an e-mail address its top-level domain and
the places of digits and letters, an international number its first two digits, an IBAN its country. A
number laid out as +1 (ddd) ddd-dddd is a telephone number whatever its digits; those that no
exchange has stay such.

Nulls: a null text stays null, with no finds. Texts are taken whole. Repeated rows are treated
alike; an empty table gives none; extra columns stay with ``masked`` and are ignored by ``mask``.
"""

from __future__ import annotations

import datetime
import hashlib
import logging
import re
import secrets
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stumpwright.llm.common import only

#: The session setting that holds the key, any text.
KEY = "spark.stumpwright.pii.key"
log = logging.getLogger(__name__)
KINDS = ("email", "ip", "card", "iban", "ssn", "phone", "date")
_ROUNDS = 8


def secret(spark: SparkSession) -> bytes:
    """The session's key, or a random one."""
    own = spark.conf.get(KEY, None)
    if own:
        return hashlib.blake2b(own.encode()).digest()
    log.warning("%s is not set: pseudonyms of this call link to no other's", KEY)
    return secrets.token_bytes(64)


class Feistel:
    """A keyed permutation of 0..n-1 without fixed points (n > 1)."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.low = (1 << self.half) - 1
        self.base = hashlib.blake2b(tweak.encode(), key=key[:64], digest_size=max(8, min(64, (self.half + 7) // 8 + 4)))

    def _round(self, i: int, x: int) -> int:
        h = self.base.copy()
        h.update(i.to_bytes(1, "big") + x.to_bytes((self.half + 7) // 8, "big"))
        return int.from_bytes(h.digest(), "big") & self.low

    def _forth(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.low
            for i in range(_ROUNDS):
                a, b = b, a ^ self._round(i, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def _back(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.low
            for i in reversed(range(_ROUNDS)):
                a, b = b ^ self._round(i, a), a
            x = a << self.half | b
            if x < self.n:
                return x

    def __call__(self, x: int, step: int = 1) -> int:
        """The network conjugates the shift by one, so the permutation is a single cycle."""
        return self._back((self._forth(x) + step) % self.n)


def luhn(digits: str) -> int:
    """The check digit to append to digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _put(layout: str, values: str, is_place: Callable[[str], bool] = str.isdigit) -> str:
    """layout with its places filled by values in order."""
    it = iter(values)
    return "".join(next(it) if is_place(c) else c for c in layout)


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALPHABET = {c: a for a in _ALPHABETS for c in a}


def _mixed_rank(s: str) -> tuple[int, int, str]:
    """Rank, number of values and signature of a string over its own letter and digit places."""
    rank, n, sign = 0, 1, []
    for c in s:
        a = _ALPHABET.get(c)
        if a:
            rank, n = rank * len(a) + a.index(c), n * len(a)
        sign.append(a[0] if a else c)
    return rank, n, "".join(sign)


def _mixed_value(rank: int, layout: str) -> str:
    out = []
    for c in reversed(layout):
        a = _ALPHABET.get(c)
        if a:
            rank, i = divmod(rank, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # to 2099-12-31


class Pseudonyms:
    """replace(kind, value) by the keyed permutation; inverse(kind, value) by its inverse."""

    def __init__(self, key: bytes):
        self.key = key
        self.network = lru_cache(maxsize=4096)(lambda tweak, n: Feistel(key, tweak, n))

    def replace(self, kind: str, value: str) -> str:
        return getattr(self, f"_{kind}")(value, 1)

    def inverse(self, kind: str, value: str) -> str:
        return getattr(self, f"_{kind}")(value, -1)

    def _moved(self, tweak: str, n: int, rank: int, step: int, same: Callable[[int], bool] = lambda _: True) -> int:
        if n < 2:
            return rank
        f = self.network(tweak, n)
        rank = f(rank, step)
        while not same(rank):
            rank = f(rank, step)
        return rank

    def _email(self, v: str, step: int) -> str:
        name, top = v.rsplit(".", 1)
        rank, n, sign = _mixed_rank(name)
        return f"{_mixed_value(self._moved(f'email {sign}.{top.lower()}', n, rank, step), name)}.{top}"

    def _ip(self, v: str, step: int) -> str:
        a, b, c, d = map(int, v.split("."))
        r = self._moved("ip", 1 << 32, a << 24 | b << 16 | c << 8 | d, step)
        return f"{r >> 24}.{r >> 16 & 255}.{r >> 8 & 255}.{r & 255}"

    def _card(self, v: str, step: int) -> str:
        d = re.sub(r"\D", "", v)
        middle = d[1:-1]
        r = self._moved(f"card {d[0]} {len(d)}", 10 ** len(middle), int(middle), step)
        body = d[0] + str(r).zfill(len(middle))
        return _put(v, body + str(luhn(body)))

    def _iban(self, v: str, step: int) -> str:
        d = re.sub(r"\W", "", v)
        country, account = d[:2], d[4:]
        rank, n, sign = _mixed_rank(account)
        account = _mixed_value(self._moved(f"iban {country} {sign}", n, rank, step), account)
        return _put(v, f"{country}{_iban_check(country, account):02d}{account}", str.isalnum)

    def _ssn(self, v: str, step: int) -> str:
        a, g, s = (int(x) for x in re.findall(r"\d+", v))
        r = self._moved("ssn", 898 * 99 * 9999, ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, step)
        r, s = divmod(r, 9999)
        a, g = divmod(r, 99)
        return _put(v, f"{a + 1 + (a >= 665):03d}{g + 1:02d}{s + 1:04d}")

    def _phone(self, v: str, step: int) -> str:
        d = re.sub(r"\D", "", v)
        lead, own = (d[:-10], d[-10:]) if len(d) <= 11 and not (v[0] == "+" and d[0] != "1") else (d[:2], d[2:])
        regular = lambda own: own[0] > "1" and own[3] > "1"
        if len(own) == 10 and lead in ("", "1") and not regular(own):
            r = self._moved("phone other", 10**10, int(own), step, lambda r: not regular(str(r).zfill(10)))
            return _put(v, lead + str(r).zfill(10))
        if len(own) == 10 and lead in ("", "1"):
            r = self._moved("phone", 800 * 800 * 10_000, ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:]), step)
            r, line = divmod(r, 10_000)
            area, exchange = divmod(r, 800)
            return _put(v, f"{lead}{area + 200}{exchange + 200}{line:04d}")
        r = self._moved(f"phone {lead} {len(own)}", 10 ** len(own), int(own), step)
        return _put(v, lead + str(r).zfill(len(own)))

    def _date(self, v: str, step: int) -> str:
        day = _date_of(v)
        parts, order = re.findall(r"\d+", v), _order_of(v)

        def written(rank: int) -> list[str]:
            new = datetime.date.fromordinal(_DAY0 + rank)
            values = {"y": new.year, "m": new.month, "d": new.day}
            return [str(values[k]).zfill(len(p)) for k, p in zip(order, parts)]

        def same(rank: int) -> bool:
            """Whether the date fits the layout and is read back in the same order."""
            new = written(rank)
            return all(len(a) == len(b) for a, b in zip(new, parts)) and _order_of(_put(v, "".join(new))) == order

        return _put(v, "".join(written(self._moved(f"date {order} {[len(p) for p in parts]}", _DAYS, day.toordinal() - _DAY0, step, same))))


def _order_of(v: str) -> str:
    """The order of year, month and day in a date's layout; with slashes, months go first where they can."""
    if v[:4].isdigit():
        return "ymd"
    return "mdy" if "/" in v and int(v[: v.index("/")]) <= 12 else "dmy"


def _date_of(v: str) -> datetime.date | None:
    parts = dict(zip(_order_of(v), (int(x) for x in re.findall(r"\d+", v))))
    try:
        return datetime.date(parts["y"], parts["m"], parts["d"]) if 1900 <= parts["y"] <= 2099 else None
    except ValueError:
        return None


_LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*$")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
_CARD = re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w]|[.-]\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)")
_SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?!\w|[.-]\d)")
_PHONE = re.compile(
    r"(?<![\w.+-])(?:\+1 \(\d{3}\) \d{3}-\d{4}|(?:\+?1[ .-]?)?(?:\([2-9]\d\d\)[ .-]?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}|\+[2-9]\d(?:[ .-]?\(?\d{1,4}\)?){2,5}|\+1\d{10})(?!\w|[.-]\d)"
)
_DATE = re.compile(r"(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([/.-])\d{1,2}\2\d{4})(?!\w|[./-]\d)")
_ANY = re.compile("[0-9@]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text[max(0, at - 64) : at]), _DOMAIN.match(text, at + 1, at + 256)
        if local and domain:
            yield at - len(local[0]), domain.end()
        at = text.find("@", at + 1)


def _valid(kind: str, v: str) -> bool:
    if kind == "ip":
        return all(int(x) < 256 and str(int(x)) == x for x in v.split("."))
    if kind == "card":
        d = re.sub(r"\D", "", v)
        return 13 <= len(d) <= 19 and int(d[-1]) == luhn(d[:-1])
    if kind == "iban":
        d = re.sub(r"\W", "", v)
        return 15 <= len(d) <= 34 and _iban_check(d[:2], d[4:]) == int(d[2:4])
    if kind == "ssn":
        a, g, s = (int(x) for x in v.split("-"))
        return 0 < a < 900 and a != 666 and g > 0 and s > 0
    if kind == "phone":
        return 8 <= sum(map(str.isdigit, v)) <= 15
    return _date_of(v) is not None


_PATTERNS = {"ip": _IP, "card": _CARD, "iban": _IBAN, "ssn": _SSN, "phone": _PHONE, "date": _DATE}


def find(text: str | None) -> list[tuple[int, int, str]]:
    """Validated finds (start, end, kind), in order, without overlaps; earlier kinds of KINDS go first."""
    if not text or not _ANY.search(text):
        return []
    out: list[tuple[int, int, str]] = []
    claimed: list[tuple[int, int]] = []

    def claim(start: int, end: int, kind: str) -> None:
        out.append((start, end, kind))

    for start, end in _emails(text):
        claim(start, end, "email")
    for kind, pattern in _PATTERNS.items():
        for m in pattern.finditer(text):
            if _valid(kind, m[0]):
                claim(m.start(), m.end(), kind)
    out.sort(key=lambda x: (KINDS.index(x[2]), x[0]))
    taken: list[tuple[int, int, str]] = []
    for x in out:
        if not claimed or not _overlaps(claimed, x[0], x[1]):
            taken.append(x)
            _insert(claimed, (x[0], x[1]))
    return sorted(taken)


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    from bisect import bisect_left

    i = bisect_left(spans, (start, start))
    return (i < len(spans) and spans[i][0] < end) or (i > 0 and spans[i - 1][1] > start)


def _insert(spans: list[tuple[int, int]], span: tuple[int, int]) -> None:
    from bisect import insort

    insort(spans, span)


def replaced(text: str | None, names: Pseudonyms) -> tuple[str | None, Counter]:
    found, out, at = find(text), [], 0
    for start, end, kind in found:
        out += [text[at:start], names.replace(kind, text[start:end])]
        at = end
    return ("".join(out) + text[at:] if found else text), Counter(kind for _, _, kind in found)


def mask(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, text with pseudonyms, and the number of finds of each kind."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            got = [replaced(t, names) for t in batch.column(1).to_pylist()]
            counts = [pa.array([c[k] for _, c in got], pa.int32()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in got], pa.string()), *counts], ["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    return only(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {kind}, text string, {', '.join(f'n_{k} int' for k in KINDS)}")


def masked(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with the text replaced; all other columns stay."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            new = pa.array([replaced(t, names)[0] for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
