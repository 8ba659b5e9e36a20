"""Operator 7: quality rules as a short-circuit cascade, ordered by rejection per cost.

On a sample of documents (SAMPLE_DOCS at most, rows chosen by a hash, read and timed on executors) each
measure is timed once and each rule's rejections are noted. The order is greedy: next comes the rule
that rejects most of the sample's documents that are left, per second of the measures it adds to
those already taken. A document's first failed rule ends its evaluation. The order changes the time,
never the verdict; the reason given is the first failed rule in the fixed order of RULES.

Words are runs of characters other than ASCII white space. Nulls: a null text is a text without
words, which the length rule rejects. Texts are judged whole, whatever their length. Repeated rows
are judged each; an empty table gives an empty result; extra columns stay with ``filtered`` and are
ignored by ``measure``.
"""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpwright.llm.common import only, utf8

#: Documents, at most, on which cost and selectivity are estimated.
SAMPLE_DOCS = 400
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")


class Text:
    """One text; each measure is computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return utf8(self.text)

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.raw.count, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        if len(w) < 6:
            return 0
        windows = lambda: zip(w, w[1:], w[2:], w[3:], w[4:])
        if len(set(windows())) == len(w) - 4:
            return 0
        counts, covered, end = Counter(windows()), 0, 0
        for i, window in enumerate(windows()):
            if counts[window] > 1:
                covered += i + 5 - max(i, end)
                end = i + 5
        return covered

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        return sum(map(eq, self.words, self.words[1:]))

    @cached_property
    def letters(self) -> tuple[int, int]:
        """Letters and, of them, upper-case ones; cased by comparing with the lower-case form."""
        upper = sum(1 for c in self.text if c.isupper())
        return sum(1 for c in self.text if c.isalpha()), upper


Rule = Callable[[Text], bool]
#: True: rejected. The first two are the base rules.
RULES: dict[str, Rule] = {
    "short": lambda t: t.n_words < 10,
    "repeats": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 15 * t.n_words,
    "stutters": lambda t: 5 * t.n_stutters > t.n_words,
    "dup_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "shouting": lambda t: 2 * t.letters[1] > t.letters[0],
    "few_letters": lambda t: 2 * t.letters[0] < t.word_chars,
}
BASE = ("short", "repeats")
#: The measures that a rule needs, those that others are made from first.
NEEDS: dict[str, tuple[str, ...]] = {
    "short": ("raw", "words", "n_words"),
    "repeats": ("raw", "words", "n_words", "n_repeat_words"),
    "symbols": ("raw", "words", "n_words", "n_symbols"),
    "word_length": ("raw", "words", "n_words", "word_chars"),
    "stutters": ("raw", "words", "n_words", "n_stutters"),
    "dup_lines": ("raw", "lines", "n_dup_lines"),
    "shouting": ("letters",),
    "few_letters": ("letters", "word_chars"),
}


def _sample(docs: DataFrame, text: str, most: int) -> DataFrame:
    """At most ``most`` texts of rows in the order of a hash of their number, so of all parts of the table.

    Rows are thinned by the hash first, so few texts move."""
    rows = only(docs, text=text)
    n = rows.count()
    rows = rows.withColumn("h", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)))
    if n > most:
        rows = rows.where(F.col("h") < math.ceil(min(1.0, 2 * most / n) * (1 << 30)))
    return rows.orderBy("h").limit(most).select("text")


def ordered(docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text", sample: int = SAMPLE_DOCS) -> list[str]:
    """Names of the rules in the order of greatest rejection per added cost on the sample."""
    needs = {k: NEEDS.get(k, ()) for k in rules}
    measures = list(dict.fromkeys(m for k in rules for m in needs[k]))

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in map(Text, batch.column(0).to_pylist()):
                spent = []
                for m in measures:
                    began = time.perf_counter()
                    getattr(t, m)
                    spent.append(time.perf_counter() - began)
                rows.append({"spent": spent, "failed": [bool(rule(t)) for rule in rules.values()]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("spent", pa.list_(pa.float64())), ("failed", pa.list_(pa.bool_()))]))

    rows = _sample(docs, text, sample).mapInArrow(timed, "spent array<double>, failed array<boolean>").collect()
    cost = {m: sum(r.spent[i] for r in rows) for i, m in enumerate(measures)}
    failed = {k: {j for j, r in enumerate(rows) if r.failed[i]} for i, k in enumerate(rules)}
    out: list[str] = []
    taken: set[str] = set()
    left, gone = list(rules), set()
    while left:
        rate = {k: len(failed[k] - gone) / (sum(cost[m] for m in needs[k] if m not in taken) + 1e-7 * max(len(rows), 1)) for k in left}
        best = max(left, key=lambda k: rate[k])
        left.remove(best)
        out.append(best)
        taken |= set(needs[best])
        gone |= failed[best]
    return out


def first_failed(t: Text, order: list[str], rules: dict[str, Rule] = RULES) -> str | None:
    return next((name for name in order if rules[name](t)), None)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, the five measures, base_failed and kept (no rule rejects it)."""
    order = ordered(docs, text=text)
    rest = [k for k in order if k not in BASE]
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                t = Text(text)
                base = any(RULES[k](t) for k in BASE)
                rows.append((*(getattr(t, k) for k in _MEASURES), base, not base and first_failed(t, rest) is None))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:])], ["doc_id", *_MEASURES, "base_failed", "kept"])

    return only(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} long' for k in _MEASURES)}, base_failed boolean, kept boolean")


def filtered(docs: DataFrame, text: str = "text", reasons: bool = False) -> DataFrame:
    """docs without the rejected ones, or with ``reasons`` all of them and the first failed rule in RULES' order."""
    order, at, fixed = ordered(docs, text=text), docs.columns.index(text), list(RULES)
    out = docs.schema if not reasons else docs.select("*", F.lit(None).cast("string").alias("failed_rule")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(map(Text, batch.column(at).to_pylist()))
            failed = [first_failed(t, order) for t in texts]
            if reasons:
                failed = [x and first_failed(t, fixed) for x, t in zip(failed, texts)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed, pa.string())], [*batch.schema.names, "failed_rule"])
            else:
                yield batch.filter(pa.array([x is None for x in failed], pa.bool_()))

    return docs.mapInArrow(run, out)
