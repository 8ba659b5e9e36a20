"""Operator 9: passages that repeat across documents removed, by sliding sentence spans.

A text is cut into sentences (after . ! or ? before white space, and at line breaks; a sentence of
more than MAX_SENTENCE words is cut after the words whose hash CUT divides, so equal stretches of
long sentences are cut alike; a part without such a word is cut every MAX_PART words). From each sentence on, and back from
each, the shortest run of MIN_SENTENCES sentences and MIN_WORDS words or more is a span, hashed
over its normalised words. Spans are joined globally by hash; the first occurrence is the one of
least (doc_id, text hash, sentence), and every sentence that another occurrence covers is removed.
Forward and backward runs together cover any repeated passage of MIN_WORDS words from its first
whole sentence to its last.

Only hashes are counted first, then the spans of repeated hashes are kept; counts and first
occurrences are aggregated before they are shuffled, and the few hashes with a large share of all
spans are joined by broadcast, so a passage that a third of all documents share doesn't meet in one
task. Texts are taken whole, whatever their length.

Nulls: a null text stays null. Null ids sort first. Rows with equal id and text are one document
(none of them is the other's repeat). Texts without a repeated span come back as they are, texts
that are all repeats empty. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpwright.llm.common import WORD_TABLE, joined, only, release, utf8, written

MIN_SENTENCES = 2
MIN_WORDS = 28
MAX_SENTENCE = 16
CUT = 8
MAX_PART = 32
_END = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _ends(raw: bytes) -> list[int]:
    ends = [m.end() for m in _END.finditer(raw)]
    return ends if ends and ends[-1] == len(raw) or not raw else [*ends, len(raw)]


def _cuts(words: list[bytes]) -> list[int]:
    """Where a sentence of these words is cut: numbers of words before each further part."""
    if len(words) <= MAX_SENTENCE:
        return []
    cuts = [i for i, w in enumerate(words[:-1], 1) if zlib.crc32(w) % CUT == 0]
    if max(b - a for a, b in zip([0, *cuts], [*cuts, len(words)])) <= MAX_PART:
        return cuts
    return [k for a, b in zip([0, *cuts], [*cuts, len(words)]) for k in range(a or MAX_PART, b, MAX_PART)]


def sentences(text: str) -> list[tuple[str, list[bytes]]]:
    """(raw text with what follows up to the next, normalised words) of each sentence; the raw texts
    join to the text."""
    raw, out, at = utf8(text), [], 0
    norm = raw.translate(WORD_TABLE)
    for end in _ends(raw):
        words = norm[at:end].split()
        if cuts := _cuts(words):
            starts = [m.start() for m in _WORD.finditer(raw, at, end)]
            for i, k in zip([0, *cuts], [*cuts, len(words)]):
                stop = starts[k] if k < len(words) else end
                out.append((raw[at:stop], words[i:k]))
                at = stop
        else:
            out.append((raw[at:end], words))
        at = end
    return [(r.decode("utf-8", "surrogatepass"), w) for r, w in out]


def units(text: str) -> tuple[bytes, list[int], list[int], list[int]]:
    """The normalised words of all sentences joined by spaces; each sentence's start and end therein,
    and its number of words. The sentences are those of ``sentences``."""
    raw, groups, at = utf8(text), [], 0
    norm = raw.translate(WORD_TABLE)
    for end in _ends(raw):
        words = norm[at:end].split()
        at = end
        cuts = _cuts(words)
        groups += [words[i:k] for i, k in zip([0, *cuts], [*cuts, len(words)])] if cuts else [words]
    parts = [b" ".join(w) for w in groups]
    starts, ends, pos = [], [], 0
    for p in parts:
        starts.append(pos)
        ends.append(pos + len(p))
        pos += len(p) + 1 if p else 0
    return b" ".join(filter(None, parts)), starts, ends, [len(w) for w in groups]


def spans(sizes: list[int]) -> list[tuple[int, int]]:
    """(first, last) sentence of each forward and backward run, by the sentences' numbers of words;
    sentences without words don't count."""
    own = [i for i, n in enumerate(sizes) if n]
    if len(own) < MIN_SENTENCES:
        return []
    size = np.array([sizes[i] for i in own])
    total = np.r_[0, np.cumsum(size)]
    k = np.arange(len(own))
    ends = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS) - 1, k + MIN_SENTENCES - 1)
    starts = np.minimum(np.searchsorted(total, total[1:] - MIN_WORDS, "right") - 1, k - MIN_SENTENCES + 1)
    forth = {(own[a], own[b]) for a, b in zip(k.tolist(), ends.tolist()) if b < len(own)}
    back = {(own[a], own[b]) for a, b in zip(starts.tolist(), k.tolist()) if a >= 0}
    return sorted(forth | back)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with t, which tells texts of one id apart: 0 where ids are unique, else a hash of the text."""
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return docs.withColumn("t", F.pmod(F.xxhash64("text"), F.lit((1 << 31) - 1)).cast("int") if repeated else F.lit(0))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, t, first, last: the spans of docs (doc_id, t, text) that aren't the first of their hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h, first, last = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if not text:
                    continue
                words, starts, ends, sizes = units(text)
                for a, b in spans(sizes):
                    row.append(i)
                    h.append(xxhash.xxh3_64_intdigest(words[starts[a] : ends[b]]))
                    first.append(a)
                    last.append(b)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(h, np.uint64).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                ["h", "doc_id", "t", "first", "last"],
            )

    cut = docs.select("doc_id", "t", "text").mapInArrow(run, f"h long, doc_id {kind}, t int, first int, last int")
    cut = written(cut)
    again = written(cut.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    hits = written(joined(cut, again, ["h"], "n", cut.count()))
    release(cut, again)
    first = hits.groupBy("h").agg(F.min(F.struct("doc_id", "t", "first")).alias("f"), F.first("n").alias("k"))
    later = joined(hits, first, ["h"], "k", hits.count())
    return later.where(~F.struct("doc_id", "t", "first").eqNullSafe(F.col("f"))).select("doc_id", "t", "first", "last")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, text without repeats, n_removed (sentences)."""
    d = _keyed(only(docs, doc_id=doc_id, text=text))
    kind = d.schema["doc_id"].dataType.simpleString()
    own = repeats(d).distinct().groupBy("doc_id", "t").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    own = own.select(F.col("doc_id").alias("k"), F.col("t").alias("kt"), "gone")
    both = d.join(own.hint("merge"), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("t") == F.col("kt")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                drop = {i for g in gone or () for i in range(g["first"], g["last"] + 1)}
                texts.append("".join(raw for i, (raw, _) in enumerate(sentences(text)) if i not in drop).strip() if drop else text)
                removed.append(len(drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["doc_id", "text", "n_removed"])

    return both.select("doc_id", "text", "gone").mapInArrow(run, f"doc_id {kind}, text string, n_removed int")
