"""Operator 4: benchmark decontamination by an Aho-Corasick automaton over normalised items.

Patterns are the items' windows of n consecutive normalised words (an item of fewer words is one
window). Every text is normalised once (lower-cased words joined by single spaces) and scanned
once; a hit marks the words it covers, whose offsets are mapped back to the original text.

The patterns pass through the driver and a broadcast in parts of at most PART_BYTES, by the hash
of the pattern; a benchmark beyond one part is scanned for part by part. Texts are scanned whole.

Nulls: a null or wordless text has no words and no hits; a null or wordless item has no window; an
item whose id is null marks words but is not listed. Repeated item ids are listed once, repeated
document rows are judged each. Empty tables give no hits. Extra columns are kept by ``filtered``
and ignored by ``scan``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpwright.llm.common import only, release, words_of, written

WINDOW = 10
#: Bytes of patterns that one automaton holds at most; a pattern of its own size may exceed it. Every Python
#: worker holds one, of about 47 bytes a byte (93 MB measured for 2 MB of random windows).
PART_BYTES = 4 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_automata: dict[object, object] = {}


def windows(items: DataFrame, n: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """pattern (words joined by spaces), n_words, item_id as string."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (" ".join(w.decode("utf-8", "replace") for w in words[i : i + n]), min(n, len(words)), k)
                for k, t in zip(*(c.to_pylist() for c in batch.columns))
                if (words := words_of(t))
                for i in range(max(1, len(words) - n + 1))
            ]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["pattern", "n_words", "item_id"])

    rows = only(items, k=item_id, t=text).select(F.col("k").cast("string"), "t")
    return rows.mapInArrow(cut, "pattern string, n_words int, item_id string").distinct()


def _parts(patterns: DataFrame) -> Iterator[list[tuple[str, int, list[str]]]]:
    """(pattern, n_words, item ids) in parts of about PART_BYTES, one after the other."""
    patterns = written(patterns.groupBy("pattern").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("item_id")).alias("items")))
    parts = max(1, -(-(patterns.select(F.sum(F.octet_length("pattern") + 16 * F.size("items"))).first()[0] or 0) // PART_BYTES))
    for part in range(parts):
        own = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part).orderBy("pattern")
        yield [(r.pattern, r.n_words, r["items"]) for r in own.toLocalIterator()]


def _automaton(sent):
    """The automaton of a broadcast part, built once a worker process."""
    key = sent._path if getattr(sent, "_path", None) else id(sent)
    if key not in _automata:
        import ahocorasick

        _automata.clear()
        a = ahocorasick.Automaton()
        for pattern, n_words, items in sent.value:
            a.add_word(f" {pattern} ".encode().decode("latin-1"), (n_words, items))
        if sent.value:
            a.make_automaton()
        _automata[key] = a
    return _automata[key]


def _found(automaton, words: list[bytes]) -> list[tuple[int, tuple[int, list[str]]]]:
    """Matches in the normalised text: (end character, (words, items))."""
    return list(automaton.iter(_flat(words))) if words and len(automaton) else []


def _flat(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


_STATE = "n_words long, word_spans array<struct<start:int,end:int>>, items array<string>"


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (ids with a window in it, as sorted strings)
    and spans (start and end code points of the hit stretches in the original text)."""
    sc = docs.sparkSession.sparkContext
    state = only(docs, doc_id=doc_id, text=text)
    first, ahead, before = True, _parts(windows(items, n)), None
    own = next(ahead)
    while own is not None:
        after = next(ahead, None)
        sent = sc.broadcast(own)
        state = state.mapInArrow(_scanner(sent, first, after is None), _schema(docs, doc_id, after is None))
        if after is not None:
            state = written(state)
            sent.destroy()
            if before is not None:
                release(before)
            before = state
        first, own = False, after
    return state


def _schema(docs: DataFrame, doc_id: str, last: bool) -> str:
    kind = docs.schema[doc_id].dataType.simpleString()
    if last:
        return f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
    return f"doc_id {kind}, text string, {_STATE}"


def _scanner(sent, first: bool, last: bool):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            before = [None] * len(texts) if first else list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()))
            out: dict[str, list] = defaultdict(list)
            for t, old in zip(texts, before):
                words = words_of(t)
                found = _found(automaton, words)
                items = set(old[1]) if old else set()
                hits: list[tuple[int, int]] = [(s["start"], s["end"]) for s in old[0]] if old else []
                if found:
                    spaces = np.flatnonzero(np.frombuffer(_flat(words).encode("latin-1"), np.uint8) == 32)
                    for end, (k, own) in found:
                        stop = int(np.searchsorted(spaces, end))
                        hits.append((stop - k, stop))
                        items.update(own)
                hits = _merged(hits)
                out["n_words"].append(len(words))
                out["items"].append(sorted(items))
                out["hits"].append(hits)
                out["n_hit"].append(sum(b - a for a, b in hits))
                if last:
                    out["spans"].append(_mapped(t, hits))
            dicts = lambda x: [[{"start": a, "end": b} for a, b in row] for row in x]
            n_words, items = pa.array(out["n_words"], pa.int64()), pa.array(out["items"], pa.list_(pa.string()))
            if last:
                yield pa.RecordBatch.from_arrays([ids, n_words, pa.array(out["n_hit"], pa.int64()), items, pa.array(dicts(out["spans"]), span)], ["doc_id", "n_words", "n_hit", "items", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([ids, batch.column(1), n_words, pa.array(dicts(out["hits"]), span), items], ["doc_id", "text", "n_words", "word_spans", "items"])

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _mapped(text: str | None, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not hits:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in hits]


def digest(scanned: DataFrame) -> DataFrame:
    """The result columns of the query: counts, the digest of the item list, the verdict."""
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def filtered(docs: DataFrame, items: DataFrame, n: int = WINDOW, text: str = "text") -> DataFrame:
    """docs without the documents that hold a window of an item; all columns stay, and no row is shuffled.

    Parts of the patterns are filters one after the other, with what is left written between them, so
    that a worker holds one automaton."""
    sc, at = docs.sparkSession.sparkContext, docs.columns.index(text)
    ahead = _parts(windows(items, n))
    own, before = next(ahead), None
    while own is not None:
        after = next(ahead, None)
        sent = sc.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent)
            for batch in batches:
                clean = [not _found(automaton, words_of(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if after is not None:
            docs = written(docs)
            sent.destroy()
            if before is not None:
                release(before)
            before = docs
        own = after
    return docs
