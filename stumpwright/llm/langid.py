"""Operator 5: language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed greedily into
longest matches with each automaton; phrases * log2(training size) / length is the cross-parsing
entropy, and the language with the least wins (ties: the first name). Automata are stored as full
transition tables, so a batch of texts is parsed in step with array operations.

Training is bounded: a language has TRAIN_BYTES of text at most, from TRAIN_DOCS documents at most in
order of a hash of their id; a text that goes beyond the bound is cut, the first one too. All
languages together have tables of MODEL_CELLS cells at most, so many languages get shorter training
texts each; that bounds what the driver builds and what is broadcast (4 bytes a cell). Prediction
covers whole texts, cut into stretches of STRETCH bytes that are parsed side by side (each cut ends
a phrase, for all languages alike).

Nulls: a null text or one without a letter is ``und`` with score 0; rows with null lang or text
don't train; a null id is in training. Without any training row every text is ``und``. Repeated
rows are judged each; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stumpwright.llm.common import only, utf8

TRAIN_DOCS = 64
TRAIN_BYTES = 40_000
#: Cells of all languages' tables together, at most: 128 MB.
MODEL_CELLS = 32_000_000
STRETCH = 512
_ROWS = 8192
_ASCII_OTHER = bytes(b for b in range(128) if not chr(b).isalpha())
_TO_SPACE = bytes.maketrans(_ASCII_OTHER, b" " * len(_ASCII_OTHER))
_LETTER = re.compile("[A-Za-z]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _plain(text: str) -> bytes:
    return b" ".join(utf8(text.lower()).translate(_TO_SPACE).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or any(map(str.isalpha, text)))


def training_texts(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[bytes]]:
    """Per language plain text of TRAIN_BYTES at most, and of no more than its share of MODEL_CELLS.

    Rows are thinned by the hash of their id before any is ranked, and texts cut before they move."""
    rows = only(labelled, doc_id=doc_id, text=text, lang=lang).where("lang is not null and text is not null")
    counts = [(r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not counts:
        return {}
    # an automaton of t bytes has fewer than 2 t states, each of a cell a symbol
    cells = MODEL_CELLS // len(counts)
    most = max(1, min(TRAIN_BYTES, cells // 8))
    shares = rows.sparkSession.createDataFrame([(name, min(1.0, 8 * TRAIN_DOCS / n)) for name, n in counts], "lang string, share double")
    shares = F.broadcast(shares) if len(counts) <= 100_000 else shares
    some = rows.withColumn("h", F.xxhash64("doc_id")).join(shares, "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    some = some.select("lang", "h", F.substring("text", 1, most).alias("text"))
    by_hash = Window.partitionBy("lang").orderBy("h", "text")
    few = some.withColumn("rn", F.row_number().over(by_hash)).where(F.col("rn") <= TRAIN_DOCS)
    before = F.sum(F.length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, -1))
    few = few.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= 4 * most)
    out: dict[str, list[bytes]] = {}
    for r in few.orderBy("lang", "rn").toLocalIterator():
        own = out.setdefault(r.lang, [])
        raw = _plain(r.text)[: max(0, most - sum(map(len, own)))]
        if raw:
            own.append(raw)
    return {k: _fitting(v, cells) for k, v in out.items() if v}


def _fitting(texts: list[bytes], cells: int) -> list[bytes]:
    """texts cut so that their automaton has no more cells."""
    out: list[bytes] = []
    left = cells // (2 * (len(set(b"".join(texts))) + 3))
    for t in texts:
        out.append(t[: max(0, left)])
        left -= len(t) + 1
    return [t for t in out if t] or [texts[0][:1]]


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transitions (states x size) of the automaton of all substrings; -1 where there is none."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(moves), size), -1, np.int32)
    for s, m in enumerate(moves):
        for c, t in m.items():
            table[s, c] = t
    return table


class Model:
    """Per language its symbol classes, a parsing table and the log of the training size.

    table[state * width + symbol] = next state's row start * 2 + (1 if a phrase ends before it).
    The last symbol is padding (byte 0, which plain text lacks) and stays; the one before it is any
    byte unseen in the language's training text.
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        self.classes, self.tables, self.logs = [], [], []
        for name in self.langs:
            raw = b" ".join(texts[name])
            seen = sorted(set(raw) | {32})
            width = len(seen) + 2
            own = np.full(256, width - 2, np.int32)
            own[seen] = np.arange(len(seen))
            own[0] = width - 1
            moves = suffix_automaton(own[np.frombuffer(raw, np.uint8)].tolist(), width)
            unseen = len(moves)  # a state of its own: such a byte is a phrase
            moves = np.vstack([moves, np.full((1, width), -1, np.int32)])
            start = np.where(moves[0] >= 0, moves[0], unseen)[None, :]
            table = np.where(moves >= 0, moves * (2 * width), start * (2 * width) + 1)
            table[0] = start * (2 * width)
            table[:, width - 1] = np.arange(len(moves)) * (2 * width)
            self.classes.append(own)
            self.tables.append(table.astype(np.int32).ravel())
            self.logs.append(math.log2(max(2, len(raw))))

    def entropies(self, texts: list[bytes]) -> np.ndarray:
        """Cross-parsing entropy of each text (plain form) by each language."""
        out = np.zeros((len(texts), len(self.langs)))
        stretches = [(i, t[a : a + STRETCH]) for i, t in enumerate(texts) for a in range(0, len(t), STRETCH)]
        for first in range(0, len(stretches), _ROWS):
            part = stretches[first : first + _ROWS]
            owner = np.array([i for i, _ in part])
            flat = b"".join(t.ljust(STRETCH, b"\0") for _, t in part)
            grid = np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(len(part), STRETCH).T)
            for k, (own, table) in enumerate(zip(self.classes, self.tables)):
                state = np.zeros(len(part), np.int32)
                ends = np.ones(len(part), np.int32)
                for row in grid:
                    state += own.take(row)
                    got = table.take(state)
                    ends += got & 1
                    state = got >> 1
                out[:, k] += np.bincount(owner, ends, len(texts))
        size = np.array([max(1, len(t)) for t in texts])[:, None]
        return out * np.array(self.logs)[None, :] / size

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        use = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        if use:
            h = self.entropies([_plain(texts[i]) for i in use])
            best = h.argmin(axis=1)
            rest = np.sort(h, axis=1)
            for j, i in enumerate(use):
                names[i] = self.langs[best[j]]
                scores[i] = float(1 - rest[j, 0] / rest[j, 1]) if len(self.langs) > 1 and rest[j, 1] > 0 else 1.0
        return names, scores


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score (1 - least / second least entropy)."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = sent.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = only(docs, doc_id=doc_id, text=text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents that aren't held out, predict for all."""
    return predict(docs, Model(training_texts(docs.where(~held_out(F.col("doc_id"))))))
