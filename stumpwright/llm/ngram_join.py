"""Operator 3: Jaccard join on word n-grams by MinHash banding.

1. Each text becomes its set of SHINGLE consecutive normalised words (64-bit hashes). Documents
   with equal sets form a class, aggregated before anything else is shuffled.
2. A class has BANDS hashes of ROWS minima each, chosen by ``bands_for`` for the target recall at
   the threshold. Classes that share a band hash are tied to the least of them (a star, not all
   pairs); components of the stars are the candidate groups.
3. Within a group every pair is verified on full n-gram sets by sparse counts as matrix products.
   Groups over BLOCK classes or BLOCK_SHINGLES shingles are cut into blocks, and each pair of blocks is one task's work, so a
   large group spreads out and no row per pair is made. Links are the pairs of at least THRESHOLD.
4. Components of the verified links are the groups of near copies.

Result per document row: doc_id, class_id (least doc_id of its near-copy group), n_links (other
documents it is linked to, its copies included), class_size.

Nulls: a null or wordless text is linked to nothing and is a class of its own; a text of fewer
words than SHINGLE is one n-gram. Null ids take part; class_id is null only where all ids of a
group are null. Repeated rows are copies. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpwright.llm.common import joined, only, release, words_of, written
from stumpwright.llm.graph import components

SHINGLE = 5
#: Links have a Jaccard similarity of at least this, as a fraction (numerator, denominator).
THRESHOLD = (4, 5)
RECALL = 0.999
ROWS = 6
BLOCK = 512
#: Shingles of a block, on average, at most.
BLOCK_SHINGLES = 1_000_000
#: Shingles of small candidate groups that one task verifies, on average.
TASK_SHINGLES = 250_000
_COLUMNS = 1 << 14
_CHUNK_TEXTS = 64
_U = np.uint64


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """Bands so that a pair at the threshold shares at least one with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


BANDS = bands_for(THRESHOLD[0] / THRESHOLD[1], ROWS, RECALL)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams."""
    words = words_of(text)
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, _U)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = _mixed(out + h[i : len(h) - k + 1 + i] + _U(k))
    return np.unique(out)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = _mixed(np.arange(1, 2 * n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return (base[:n] >> _U(32)).astype(np.uint32) | np.uint32(1), (base[n:] >> _U(32)).astype(np.uint32)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(texts, bands) int64; all sets non-empty."""
    ends = np.cumsum([len(s) for s in sets])
    starts = np.r_[0, ends[:-1]]
    x = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    mult, add = _coefficients(bands * rows)
    out = np.zeros((len(sets), bands), _U)
    with np.errstate(over="ignore"):
        for k in range(bands):
            h = np.full(len(sets), k + 1, _U)
            for j in range(k * rows, (k + 1) * rows):
                h = _mixed(h * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * mult[j] ^ add[j], starts))
            out[:, k] = h
    return out.astype(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK_TEXTS):
                part = batch.slice(at, _CHUNK_TEXTS)
                sets = [shingles(t, n) for t in part.column(1).to_pylist()]
                some = [s for s in sets if len(s)]
                found = iter(band_hashes(some, bands, rows)) if some else iter(())
                keys = [(int(xxhash.xxh3_64_intdigest(s.tobytes()) >> 1), int(xxhash.xxh3_64_intdigest(s.tobytes(), seed=1) >> 1)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int32()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n", "c1", "c2", "bands"],
                )

    return only(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {kind}, n int, c1 long, c2 long, bands array<bigint>")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, class_size per document row; see the module's text."""
    bands = bands_for(threshold[0] / threshold[1], rows, recall)
    sig = written(signatures(docs, doc_id, text, n, bands, rows))
    kind = docs.schema[doc_id].dataType.simpleString()
    classes = sig.where("n > 0").groupBy("c1", "c2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    hashed = classes.select("node", F.explode("bands").alias("h"))
    least = hashed.groupBy("h").agg(F.min("node").alias("m"), F.count("*").alias("k")).where("k > 1").select("h", "m")
    stars = hashed.join(least, "h").where("node > m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    candidates = components(stars)
    members = written(candidates.join(classes.select("node", "rep", "c1", "c2", "copies", "n"), "node"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("root").agg(blocks.alias("blocks"), F.count("*").alias("k"))
    asked = written(joined(members, sizes, ["root"], "k", members.count()).select("node", F.col("root").alias("comp"), "blocks", "rep", "c1", "c2", "copies", "n"))
    checked = written(_verified(docs, asked, doc_id, text, n, threshold))
    roots = components(checked.select(F.col("node").alias("u"), F.col("parent").alias("v")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    of = classes.select("node", "c1", "c2", "rep", "copies").join(links, "node", "left").join(roots, "node", "left")
    of = written(of.withColumn("root", F.coalesce("root", "node")))
    groups = of.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("k"))
    out = joined(of, groups, ["root"], "k", of.count())
    out = written(out.select("c1", "c2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "class_size", "copies"))
    release(classes, members, asked, checked, of)
    alone = sig.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"))
    rows = joined(sig.where("n > 0").select("doc_id", "c1", "c2"), out, ["c1", "c2"], "copies", sig.count())
    return rows.select("doc_id", F.col("class_id").cast(kind), "n_links", "class_size").unionByName(alone)


def _verified(docs: DataFrame, asked: DataFrame, doc_id: str, text: str, n: int, threshold: tuple[int, int]) -> DataFrame:
    """node, links (documents of other classes at the threshold or above), parent (a linked root in its task)."""
    d = only(docs, d=doc_id, text=text)
    # a merge join at every size: what is asked for grows with the documents
    found = d.join(asked.hint("merge"), d["d"].eqNullSafe(asked["rep"])).select("node", "comp", "blocks", "c1", "c2", "copies", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shingles(t, n).tobytes() for t in batch.column("text").to_pylist()]
            same = [(xxhash.xxh3_64_intdigest(s) >> 1) == a and (xxhash.xxh3_64_intdigest(s, seed=1) >> 1) == b for s, a, b in zip(got, batch.column("c1").to_pylist(), batch.column("c2").to_pylist())]
            cols = [batch.column(c) for c in ("node", "comp", "blocks", "copies")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.binary())], ["node", "comp", "blocks", "copies", "sh"]).filter(pa.array(same, pa.bool_()))

    s = found.mapInArrow(sets, "node long, comp long, blocks int, copies long, sh binary")
    tasks = max(1, -(-(asked.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) // TASK_SHINGLES))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    small = s.where("blocks = 1").select("*", F.lit(-1).cast("long").alias("g"), F.pmod(F.xxhash64("comp"), F.lit(tasks)).cast("int").alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("own"))
    large = s.where("blocks > 1").select("*", F.col("comp").alias("g"), own.alias("own")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("node", "comp", "blocks", "copies", "sh", "g", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own")

    def one(group: pa.Table) -> pa.Table:
        comp, node, copies, own = (group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("comp", "node", "copies", "own"))
        sh = [np.frombuffer(x, _U) for x in group.column("sh").to_pylist()]
        across = group.column("j")[0].as_py() > group.column("i")[0].as_py() >= 0 and group.column("j")[0].as_py() >= 0
        order = np.lexsort((node, comp))
        keep = np.r_[True, (node[order][1:] != node[order][:-1]) | (comp[order][1:] != comp[order][:-1])]
        order = order[keep]  # repeated rows of a class
        cuts = np.flatnonzero(np.r_[True, comp[order][1:] != comp[order][:-1], True])
        links, parent = np.zeros(len(order), np.int64), node[order].copy()
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = order[a:b]
            if b - a > 1:
                links[a:b], parent[a:b] = _links([sh[k] for k in at], node[at], copies[at], own[at] if across else None, threshold)
        return pa.table({"node": node[order], "links": links, "parent": parent})

    return small.unionByName(large).groupBy("g", "i", "j").applyInArrow(one, "node long, links long, parent long")


def _links(sets: list[np.ndarray], node: np.ndarray, copies: np.ndarray, side: np.ndarray | None, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Linked documents of each class, and the least node of its local component. With side, only
    pairs of different sides count (the others are other tasks' work)."""
    m, (p, q) = len(sets), threshold
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(values)) > 1
    new = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], new[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((m, m), np.float64)
    for first in range(0, int(often.sum()), _COLUMNS):
        a, b = np.searchsorted(column, (first, first + _COLUMNS))
        x = np.zeros((m, _COLUMNS), np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        common += x @ x.T
    both = common.astype(np.int64)
    linked = both * (p + q) >= p * (size[:, None] + size[None, :])
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    label = np.arange(m)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    return linked @ copies, node[label]


def filtered(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-copy group, of least doc_id (null ids last); all columns stay.

    Rows are told apart by their own number, so null, clashing and repeated ids decide nothing for other rows."""
    key = max(docs.columns, key=len) + "_"
    number = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.monotonically_increasing_id().alias("row"))
    keyed = written(docs.withColumn(key, number))
    stays = join(keyed, key).where("doc_id = class_id").select(F.col("doc_id.row").alias("row"))
    return keyed.join(stays.hint("merge"), keyed[key]["row"] == stays["row"], "left_semi").select(*[keyed[f"`{c}`"] for c in docs.columns])
