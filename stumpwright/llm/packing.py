"""Operator 6: conflict-constrained best-fit packing of documents into fixed-size sequences.

A document's size is its number of token ids by a tokenizer file, end id included (words only where
no file is given). Documents longer than CAPACITY are cut into full sequences and a remainder;
remainders and whole documents are items. Items are packed in groups of about GROUP_TOKENS, dealt by
a hash, one group a task; bins are searched within the group. Within a group: clusters of copies in
falling order of their largest item, items of a cluster by falling size, each into the open bin with
the smallest residual that fits it, has no document of its source yet and none of its cluster; else
into a new bin. Bins carry a bitmap of sources and one of clusters; residuals form a bitmap too,
whose next set bit is the successor. Clusters are exact copies unless the caller names others, as
the classes of the n-gram join. ``token_sequences`` joins the placed pieces to the ids themselves.

While a cluster is placed, bins that took one of it are set aside, so that a large cluster doesn't
make the search walk over its own bins.

Nulls: a null or empty text (by words: one without words) has length 0 and gets a row without a bin; a null source
conflicts with nothing; null ids are items like others. Repeated rows are a cluster, so they go to
different bins. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stumpwright.llm import token_store
from stumpwright.llm.common import written

CAPACITY = 2048
GROUP_TOKENS = 4_000_000
SCHEMA = "doc_id long, piece int, n_tokens int, group int, bin int, bin_offset int"


def n_words(text: Column) -> Column:
    """Words of a text (runs without ASCII white space), the token count used by default."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.when(F.trim(trimmed) == "", 0).otherwise(F.size(F.split(F.trim(trimmed), " ")))


class Bins:
    """Open bins by residual, with a bitmap of sources and of clusters each."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self.any = 0  # bit r: some open bin has residual r
        self.at: dict[int, dict[int, list[int]]] = defaultdict(dict)  # residual -> sources -> bins
        self.clusters: list[int] = []
        self.residual: list[int] = []
        self.sources: list[int] = []

    def _put(self, b: int) -> None:
        r = self.residual[b]
        if r:
            insort(self.at[r].setdefault(self.sources[b], []), b)
            self.any |= 1 << r

    def _take(self, b: int) -> None:
        r, mask = self.residual[b], self.sources[b]
        own = self.at[r][mask]
        del own[bisect_left(own, b)]
        if not own:
            del self.at[r][mask]
            if not self.at[r]:
                self.any &= ~(1 << r)

    def find(self, size: int, source: int, cluster: int) -> int | None:
        """The first bin, by residual then number, that fits and has neither source nor cluster."""
        left = self.any >> size
        r = size
        while left:
            skip = (left & -left).bit_length() - 1
            r, left = r + skip, left >> (skip + 1)
            best = min((b for mask, own in self.at[r].items() if not mask & source for b in own[:1] if not self.clusters[b] & cluster), default=None)
            if best is None:  # the cluster bit can only be set behind the first bin of a mask
                best = min((b for mask, own in self.at[r].items() if not mask & source for b in own if not self.clusters[b] & cluster), default=None)
            if best is not None:
                return best
            r += 1
        return None

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for an item; the bin is set aside until ``release``."""
        b = self.find(size, source, cluster)
        if b is None:
            b, self.n = self.n, self.n + 1
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._take(b)
        offset = self.capacity - self.residual[b]
        self.residual[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        return b, offset

    def release(self, bins: list[int]) -> None:
        for b in bins:
            self._put(b)


def pack(items: list[tuple[int, str | None, int]], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each item (size, source, cluster); sizes are 1..capacity."""
    by_cluster: dict[int, list[int]] = defaultdict(list)
    for i, (_, _, cluster) in enumerate(items):
        by_cluster[cluster].append(i)
    for own in by_cluster.values():
        own.sort(key=lambda i: (-items[i][0], i))
    names: dict[str, int] = {}
    bins, out = Bins(capacity), [(0, 0)] * len(items)
    order = sorted(by_cluster, key=lambda c: (-items[by_cluster[c][0]][0], by_cluster[c][0]))
    several = {c: 1 << k for k, c in enumerate(c for c in order if len(by_cluster[c]) > 1)}
    for c in order:
        used = []
        for i in by_cluster[c]:
            size, source, _ = items[i]
            bit = 0 if source is None else 1 << names.setdefault(source, len(names))
            out[i] = bins.place(size, bit, several.get(c, 0))
            used.append(out[i][0])
        bins.release(used)
    return out


def sequences(
    docs: DataFrame,
    capacity: int = CAPACITY,
    group_tokens: int = GROUP_TOKENS,
    tokenizer_path: str | None = None,
    cluster: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """A row per piece of a document: doc_id, piece, n_tokens, group, bin, bin_offset; a sequence is
    a (group, bin). cluster defaults to the text's hash, so exact copies conflict."""
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        (n_words(F.col(f"`{text}`")) if tokenizer_path is None else F.col(f"`{text}`")).alias("n"),
        (F.xxhash64(f"`{text}`") if cluster is None else cluster.cast("long")).alias("cluster"),
    )
    if tokenizer_path is not None:
        rows = token_store.counted(rows, tokenizer_path, "n", "n")
    rows = rows.withColumn("n", F.col("n").cast("int"))
    rows = written(rows)
    total = rows.select(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    full = rows.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("n") / capacity).cast("int"))).alias("piece"), "n", "source", "cluster")
    size = F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int")
    pieces = full.withColumn("size", size).where("size > 0 or n = 0").withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(groups)).cast("int"))

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "piece", "source", "cluster")])
        g = group.column("group")[0].as_py()
        size = group.column("size").to_pylist()
        items = list(zip(size, group.column("source").to_pylist(), group.column("cluster").to_pylist()))
        at = pack(items, capacity)
        return pa.table({
            "doc_id": group.column("doc_id").cast(pa.int64()), "piece": group.column("piece").cast(pa.int32()), "n_tokens": pa.array(size, pa.int32()),
            "group": pa.array([g] * len(size), pa.int32()), "bin": pa.array([b for b, _ in at], pa.int32()), "bin_offset": pa.array([o for _, o in at], pa.int32()),
        })

    real = pieces.where("size > 0").select("group", "doc_id", "piece", "size", "source", "cluster")
    none = F.lit(None).cast("int")
    empty = pieces.where("n = 0").select("doc_id", "piece", F.lit(0).alias("n_tokens"), none.alias("group"), none.alias("bin"), none.alias("bin_offset"))
    return real.groupBy("group").applyInArrow(one, SCHEMA).unionByName(empty)


def token_sequences(placed: DataFrame, tokens: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """group, bin, n_tokens, width, ids: the ids of each sequence, its pieces in order.

    tokens: doc_id, ids (raw little-endian bytes, end id included), width, a row a document, as the token
    store reads them; ids of documents have to be unique here. A sequence is at most capacity ids long."""
    own = placed.where("bin is not null").join(tokens.select("doc_id", "ids", "width"), "doc_id")
    start = F.col("piece").cast("long") * capacity * F.col("width")
    cut = F.substring(F.col("ids"), (start + 1).cast("int"), (F.col("n_tokens") * F.col("width")).cast("int"))
    pieces = F.sort_array(F.collect_list(F.struct("bin_offset", cut.alias("ids"))))
    return own.groupBy("group", "bin").agg(
        F.sum("n_tokens").cast("int").alias("n_tokens"), F.first("width").alias("width"),
        F.aggregate(pieces, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
