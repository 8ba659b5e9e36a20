"""Operator 1: token ids in a binary store with a minimal perfect hash index.

Layout below the store's path, all parts Parquet so that any Spark file system holds them:

* ``shards``: a file per shard, a row per block of consecutive documents in ascending key order:
  shard, block, the documents' keys and id counts, the ids as raw little-endian unsigned integers of
  ``width`` bytes (2 where the vocabulary allows, else 4), ``at`` (ids of the shard before the
  block) and ``seen`` (rows of the block's first key before the block in its shard). A document is
  never cut.
* ``files``: a row per shard: its file, the ids in all shards before it, and how often its first key
  occurs in them.
* ``index``: a row per key bucket, in folders by the bucket's number: the pilots of a minimal perfect
  hash over (key, occurrence), and by slot a 32-bit fingerprint and the location (shard, block,
  offset, ids).

A lookup hashes the key to a bucket and slot, compares the fingerprint, and slices one block. For few
keys (FEW_KEYS at most) it opens the folders of their buckets and the files of their shards only;
for more it joins the keys with the index and the blocks.

Nulls: a null text is an empty text (its end id only); a null key sorts first and is found as
null. Repeated keys are occurrences 1, 2, ... in the order they were read; no key's rows meet in one
task for it. An empty table gives an empty store. Texts are taken whole; a block of one very long
document is as long as the document. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright.llm import mph
from stumpwright.llm.common import only, written

BLOCK_TOKENS = 1 << 18
BLOCK_DOCS = 1 << 14
KEYS_PER_BUCKET = 8192
#: Folders of the index, at most.
INDEX_PARTS = 4096
#: Asked keys, at most, for which only the files that hold them are opened.
FEW_KEYS = 10_000
#: Distinct pieces whose ids a worker remembers; speed only.
CACHE_PIECES = 800_000
_BATCH_TEXTS = 256

_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The byte-level splitting rule for texts up to U+024F, where these classes are all letters and numbers.
_PIECE = re.compile(
    rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
)
#: A character for which the library itself has to split the text.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ]")
#: The same rule and characters for texts in Latin-1, where a class is a table of 256 bits.
_LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_LATIN_PIECE = re.compile(
    rf" ?[{_LATIN_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBERS}]+| ?[^\t\n\r \xa0{_LATIN_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
)
_LATIN = bytes((9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x100)))


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself,
    the others from U+0100 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Known(dict):
    """Ids of pieces as bytes; an unknown piece is encoded by the library's model, and kept while there is room."""

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self.tokenize, self.kind, self.map = tokenizer.model.tokenize, kind, _byte_characters()
        self.space = self.map[32]

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.space)
        else:
            shown = piece.encode().decode("latin-1").translate(self.map)
        ids = array(self.kind, [t.id for t in self.tokenize(shown)]).tobytes()
        if len(self) < CACHE_PIECES:
            self[piece] = ids
        return ids


def _splits_by_rule(tokenizer) -> bool:
    """Whether _PIECE is how the file's tokenizer splits: byte-level BPE as is, no normalizer, no dropout."""
    spec = json.loads(tokenizer.to_str())
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    )


class Encoder:
    """Ids of texts as bytes, by the tokenizers library; a piece that recurs is encoded once.

    Strings of special tokens inside a text are ordinary text. A tokenizer of another kind than
    _PIECE splits for encodes every text by itself."""

    def __init__(self, tokenizer_path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id) < 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.end = array(self.kind, [end_id]).tobytes()
        self.known = _Known(self.tokenizer, self.kind)
        self.by_rule = _splits_by_rule(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [(self._by_piece(t) if self.by_rule else self._whole(t)) + self.end for t in texts]

    def _by_piece(self, text: str) -> bytes:
        try:
            other, piece = text.encode("latin-1").translate(None, _LATIN), _LATIN_PIECE
        except UnicodeEncodeError:
            other, piece = _OTHER.search(text), _PIECE
        return self._whole(text) if other else b"".join(map(self.known.__getitem__, piece.findall(text)))

    def _whole(self, text: str) -> bytes:
        (got,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return array(self.kind, got.ids).tobytes()


@lru_cache(maxsize=1)
def _encoder(tokenizer_path: str, end_id: int) -> Encoder:
    """One encoder a worker process, whose known pieces serve all its tasks."""
    return Encoder(tokenizer_path, end_id)


_SHARD = "shard int, block int, width int, n_tokens long, at long, seen long, keys array<bigint>, lens array<int>, ids binary"
_FILES = "shard int, file string, shard_start long, first_key long, first_seen long"


def counted(docs: DataFrame, tokenizer_path: str, text: str = "text", column: str = "n_tokens", end_id: int = 0) -> DataFrame:
    """docs with the text replaced by the number of its ids, end id included; 0 for null and empty texts."""
    at = docs.columns.index(text)
    names = [column if i == at else c for i, c in enumerate(docs.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, end_id)
        for batch in batches:
            for first in range(0, batch.num_rows, _BATCH_TEXTS):
                part = batch.slice(first, _BATCH_TEXTS)
                texts = [t or "" for t in part.column(at).to_pylist()]
                n = pa.array([len(x) // encoder.width if t else 0 for t, x in zip(texts, encoder.encode(texts))], pa.int64())
                yield pa.RecordBatch.from_arrays([n if i == at else c for i, c in enumerate(part.columns)], names)

    return docs.mapInArrow(run, docs.select(*[F.lit(0).cast("long").alias(column) if i == at else F.col(f"`{c}`") for i, c in enumerate(docs.columns)]).schema)


def write(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Encode whole texts, append end_id to each, and write shards and index below path."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, block = _encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        keys: list = []
        ids: list[bytes] = []
        size = at = run = seen = 0  # run: rows of the last key so far; seen: those of the block's first key before it
        last: object = blocks

        def row() -> pa.RecordBatch:
            data = [[shard], [block], [encoder.width], [size], [at], [seen], [keys], [[len(x) // encoder.width for x in ids]], [b"".join(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            names = ["shard", "block", "width", "n_tokens", "at", "seen", "keys", "lens", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(data, kinds)], names)

        for batch in batches:
            for first in range(0, batch.num_rows, _BATCH_TEXTS):
                part = batch.slice(first, _BATCH_TEXTS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for k, own in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    n = len(own) // encoder.width
                    if keys and (size + n > BLOCK_TOKENS or len(keys) >= BLOCK_DOCS):
                        yield row()
                        at += size
                        keys, ids, size, block = [], [], 0, block + 1
                    run = run + 1 if k == last else 1
                    last = k
                    if not keys:
                        seen = run - 1
                    keys.append(k)
                    ids.append(own)
                    size += n
        if keys:
            yield row()

    spark = docs.sparkSession
    # the row number lets rows of one key go to several partitions, and the sampling of the ranges read keys alone
    rows = only(docs, key=key, text=text).select(F.col("key").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(F.asc_nulls_first("key"), "row")
    (
        ranged.sortWithinPartitions(F.asc_nulls_first("key"), "row")
        .select("key", "text")
        .mapInArrow(blocks, _SHARD)
        .write.mode("overwrite")
        .parquet(f"{path}/shards")
    )
    _write_files(spark, path)
    _write_index(spark, path)


def _write_files(spark: SparkSession, path: str) -> None:
    """A row per shard, so a row per partition of the write, passes through the driver."""
    own = spark.read.schema(_SHARD).parquet(f"{path}/shards").select(
        "shard", "block", "n_tokens", F.get("keys", F.lit(0)).alias("first"), F.element_at("keys", -1).alias("last"),
        (F.when(F.get("keys", F.lit(0)).eqNullSafe(F.element_at("keys", -1)), F.col("seen")).otherwise(0) + F.size(F.filter("keys", lambda k: k.eqNullSafe(F.element_at("keys", -1))))).alias("run"),
        F.col("_metadata.file_name").alias("file"),
    )
    shards = own.groupBy("shard").agg(
        F.first("file").alias("file"), F.sum("n_tokens").alias("n"), F.min(F.struct("block", "first")).alias("a"), F.max(F.struct("block", "last", "run")).alias("z")
    )
    rows, before, last, run = [], 0, _write_files, 0
    for r in shards.orderBy("shard").collect():
        seen = run if r.a["first"] == last else 0
        rows.append((r.shard, r.file, before, r.a["first"], seen))
        before += r.n
        run = r.z["run"] + (seen if r.z["last"] == r.a["first"] else 0)
        last = r.z["last"]
    spark.createDataFrame(rows, _FILES).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_FILES).parquet(f"{path}/files")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """A row per stored document without its ids: key, occ, shard, block, off, n."""
    b = spark.read.schema(_SHARD).parquet(f"{path}/shards").select("shard", "block", "seen", "keys", "lens")
    b = b.join(F.broadcast(files(spark, path).select("shard", "first_key", "first_seen")), "shard")
    return b.select("shard", "block", "seen", "first_key", "first_seen", "keys", "lens").mapInArrow(_entries, "key long, occ int, shard int, block int, off int, n int")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, block, seen, first, before, keys, lens in zip(*(c.to_pylist() for c in batch.columns)):
            n, occ, run, last = np.array(lens, np.int32), [], seen, keys[0]
            for k in keys:
                run = run + 1 if k == last else 1
                last = k
                occ.append(run + (before if k == first else 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(occ, pa.int32()), pa.array(np.full(len(n), shard, np.int32)), pa.array(np.full(len(n), block, np.int32)), pa.array((np.cumsum(n) - n).astype(np.int32)), pa.array(n)],
                ["key", "occ", "shard", "block", "off", "n"],
            )


def _hashed(df: DataFrame, n_buckets: int) -> DataFrame:
    h1, h2 = F.xxhash64("key", "occ"), F.xxhash64(F.lit("fp"), "occ", "key")
    return df.withColumns({"h1": h1, "h2": h2}).withColumn("bucket", F.expr(f"cast(pmod(h1, {n_buckets}L) as int)"))


def _write_index(spark: SparkSession, path: str) -> None:
    n = spark.read.schema(_SHARD).parquet(f"{path}/shards").select(F.sum(F.size("keys"))).first()[0] or 0
    n_buckets = max(1, -(-n // KEYS_PER_BUCKET))
    parts = min(n_buckets, INDEX_PARTS)
    entries = _hashed(directory(spark, path), n_buckets).withColumn("part", F.pmod("bucket", F.lit(parts)))

    def one(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("bucket", "h1", "h2", "shard", "block", "off", "n")}
        h1, h2 = col["h1"].astype(np.uint64), col["h2"].astype(np.uint64)
        pilots, slots = mph.build(h1, h2)
        at = np.argsort(slots)
        raw = {"pilots": pilots.astype("<u4"), "fps": mph.fingerprint(h2)[at].astype("<u4")} | {
            c: col[c][at].astype("<i4") for c in ("shard", "block", "off", "n")
        }
        return pa.table({"part": pa.array([int(col["bucket"][0]) % parts], pa.int32()), "bucket": pa.array([int(col["bucket"][0])], pa.int32()), "n_buckets": pa.array([n_buckets], pa.int32()), "n_keys": pa.array([len(h1)], pa.int32())} | {c: pa.array([v.tobytes()], pa.binary()) for c, v in raw.items()})

    # a part's buckets are one task's, so a folder has one file
    built = entries.repartition("part").groupBy("part", "bucket").applyInArrow(one, "part int, " + _INDEX)
    built.write.mode("overwrite").partitionBy("part").parquet(f"{path}/index")


_INDEX = "bucket int, n_buckets int, n_keys int, pilots binary, fps binary, shard binary, block binary, off binary, n binary"


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX + ", part int").parquet(f"{path}/index")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Locations of (key, occ) rows by the index: key, occ, shard, block, off, n; unknown keys are left out."""
    n_buckets = (_index(spark, path).select("n_buckets").first() or [1])[0]
    asked = _hashed(keys.select(F.col("key").cast("long"), F.col("occ").cast("int")), n_buckets)
    few = [r.bucket for r in asked.select("bucket").limit(FEW_KEYS + 1).collect()]
    index = _index(spark, path)
    if len(few) <= FEW_KEYS:
        parts = min(n_buckets, INDEX_PARTS)
        index = index.where(F.col("part").isin(sorted({b % parts for b in few})) & F.col("bucket").isin(sorted(set(few))))
    return _found(asked, index)


def _found(asked: DataFrame, index: DataFrame) -> DataFrame:
    def found(group: pa.Table, idx: pa.Table) -> pa.Table:
        get = lambda c: group.column(c).combine_chunks()
        kinds = {"shard": pa.int32(), "block": pa.int32(), "off": pa.int32(), "n": pa.int32()}
        if not idx.num_rows or not group.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "occ": pa.array([], pa.int32())} | {c: pa.array([], k) for c, k in kinds.items()})
        h1, h2 = (get(c).to_numpy(zero_copy_only=False).astype(np.uint64) for c in ("h1", "h2"))
        raw = lambda c, kind: np.frombuffer(idx.column(c)[0].as_py(), kind)
        slots = mph.lookup(h1, h2, raw("pilots", "<u4"), idx.column("n_keys")[0].as_py())
        real = pa.array(raw("fps", "<u4")[slots] == mph.fingerprint(h2))
        out = {"key": get("key"), "occ": get("occ")} | {c: pa.array(raw(c, "<i4")[slots], k) for c, k in kinds.items()}
        return pa.table(out).filter(real)

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(found, "key long, occ int, shard int, block int, off int, n int")


def read(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Ids of (key, occ) rows, by index and block: key, occ, start (ids before it in the store),
    n_tokens, ids (raw little-endian bytes of the block's width), width."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, block_start, ids, hits in zip(*(batch.column(c).to_pylist() for c in ("width", "block_start", "ids", "hits"))):
                yield pa.RecordBatch.from_pylist(
                    [{"key": h["key"], "occ": h["occ"], "start": block_start + h["off"], "n_tokens": h["n"], "width": width, "ids": ids[h["off"] * width : (h["off"] + h["n"]) * width]} for h in hits],
                    schema=pa.schema([("key", pa.int64()), ("occ", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())]),
                )

    joined = _located(spark, path, keys)
    return joined.mapInArrow(sliced, "key long, occ int, start long, n_tokens long, width int, ids binary")


def _located(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """shard, block, width, ids, hits, block_start (ids in the store before the block) of the blocks that hold keys."""
    of = files(spark, path)
    hits = lookup(spark, path, keys).groupBy("shard", "block").agg(F.collect_list(F.struct("key", "occ", "off", "n")).alias("hits"))
    names: str | list[str] = f"{path}/shards"
    if len(keys.select(F.lit(1)).limit(FEW_KEYS + 1).collect()) <= FEW_KEYS:
        hits = written(hits)
        shards = [r.shard for r in hits.select("shard").distinct().collect()]
        names = [f"{path}/shards/{r.file}" for r in of.where(F.col("shard").isin(shards)).collect()]
    blocks = spark.read.schema(_SHARD).parquet(*([names] if isinstance(names, str) else names)) if names else spark.createDataFrame([], _SHARD)
    starts = F.broadcast(of.select("shard", "shard_start"))  # a row per partition of the write
    return (
        blocks.select("shard", "block", "width", "ids", "at")
        .join(hits, ["shard", "block"])
        .join(starts, "shard")
        .withColumn("block_start", F.col("shard_start") + F.col("at"))
    )


def digest(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Per stored key: doc_id, occ, start, n_tokens, ids_crc32 over its ids as little-endian uint32."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, block_start, ids, hits in zip(*(batch.column(c).to_pylist() for c in ("width", "block_start", "ids", "hits"))):
                wide = memoryview(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([h["key"] for h in hits], pa.int64()),
                        pa.array([h["occ"] for h in hits], pa.int32()),
                        pa.array([block_start + h["off"] for h in hits], pa.int64()),
                        pa.array([h["n"] for h in hits], pa.int64()),
                        pa.array([zlib.crc32(wide[4 * h["off"] : 4 * (h["off"] + h["n"])]) for h in hits], pa.int64()),
                    ],
                    ["doc_id", "occ", "start", "n_tokens", "ids_crc32"],
                )

    return _located(spark, path, keys).mapInArrow(sums, "doc_id long, occ int, start long, n_tokens long, ids_crc32 long")


def stored_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key, occ) of every stored document."""
    return directory(spark, path).select("key", "occ")
