"""Image sources: decoded images, gray values, file types, .npy and .pgm readers."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights of red, green and blue in a gray value, in thousandths.
LUMA = (299, 587, 114)
#: Leading bytes of the file types that are told apart.
_MAGIC = (("FFD8FF", "jpg"), ("89504E47", "png"), ("47494638", "gif"), ("5035", "pgm"), ("934E554D5059", "npy"))
#: A pointer file that stands for a missing large file is smaller than this.
POINTER_BYTES = 1024


def gray(rgb: Column) -> Column:
    """Gray values of an interleaved RGB array."""
    n = F.floor(F.size(rgb) / 3).cast("int")
    r, g, b = LUMA
    at = lambda i, k: F.element_at(rgb, (i * 3 + k + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor((at(i, 0) * r + at(i, 1) * g + at(i, 2) * b) / 1000).cast("int"))


def extension(content: Column) -> Column:
    """File type by leading bytes; 'bin' for others."""
    out = F.lit("bin")
    for magic, name in reversed(_MAGIC):
        out = F.when(F.hex(F.substring(content, 1, len(magic) // 2)) == magic, name).otherwise(out)
    return out


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, category (the parent folder), length, content of files below root; pointer files are left out."""
    return tree_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root))


def tree_rows(files: DataFrame) -> DataFrame:
    """As ``read_tree``, of rows with path, length and content."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kept = files.where((F.col("length") >= POINTER_BYTES) | (extension(F.col("content")) != "bin")).where(~F.startswith(name, F.lit("_")))
    return kept.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"), "length", "content")


def read_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, h, w, px (gray) of images that the JVM can decode."""
    i = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", str(recursive).lower()).load(path).select("image.*")
    count = F.col("width") * F.col("height")
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), k, F.lit(1))), 16, 10).cast("int")
    values = F.transform(F.sequence(F.lit(1), count * F.col("nChannels")), byte)
    bgr = F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.floor((F.element_at(values, (p * F.col("nChannels") + 3).cast("int")) * LUMA[0] + F.element_at(values, (p * F.col("nChannels") + 2).cast("int")) * LUMA[1] + F.element_at(values, (p * F.col("nChannels") + 1).cast("int")) * LUMA[2]) / 1000).cast("int"))
    px = F.when(F.col("nChannels") == 1, values).otherwise(bgr)
    return i.select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), px.alias("px"))


def _pgm(raw: bytes) -> np.ndarray:
    """A binary (P5) or plain (P2) gray map of 8-bit values."""
    fields, at = [], 0
    while len(fields) < 4:
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at : at + 1] == b"#"):
            at = raw.find(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        fields.append(raw[at:end])
        at = end
    w, h, most = (int(x) for x in fields[1:])
    if fields[0] == b"P2":
        return np.array(raw[at:].split()[: w * h], np.int32).reshape(h, w)
    if fields[0] != b"P5" or most > 255:
        raise ValueError("not an 8-bit gray map")
    return np.frombuffer(raw, np.uint8, w * h, at + 1).reshape(h, w)


def _decoded(files: DataFrame, decode) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = decode(content)
                a = a[None] if a.ndim == 2 else a
                yield pa.RecordBatch.from_pylist(
                    [{"path": path, "i": i, "h": x.shape[0], "w": x.shape[1], "px": x.astype(np.int32).ravel().tolist()} for i, x in enumerate(a)],
                    schema=pa.schema([("path", pa.string()), ("i", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("px", pa.list_(pa.int32()))]),
                )

    return files.select("path", "content").mapInArrow(run, "path string, i long, h int, w int, px array<int>")


def read_pgm(spark: SparkSession, path: str) -> DataFrame:
    """path, i, h, w, px of gray maps."""
    return decode_pgm(spark.read.format("binaryFile").load(path))


def decode_pgm(files: DataFrame) -> DataFrame:
    """As ``read_pgm``, of rows with path and content."""
    return _decoded(files, _pgm)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, i (row), h, w, px of .npy arrays (N, h, w) or (h, w); no pickled objects."""
    return decode_npy(spark.read.format("binaryFile").load(path))


def decode_npy(files: DataFrame) -> DataFrame:
    """As ``read_npy``, of rows with path and content."""
    return _decoded(files, lambda raw: np.load(io.BytesIO(raw), allow_pickle=False))


def find_root(spark: SparkSession, root: str, marker: str, first: tuple[str, ...] = ()) -> str:
    """The folder that directly holds a folder named marker: one of ``first`` below root, root itself, or the
    nearest below it. Only folder names are listed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)
    level = [*(f"{root.rstrip('/')}/{f}" for f in first), root]
    while level:
        for folder in level:
            h = path(folder, marker)
            if fs.exists(h) and fs.getFileStatus(h).isDirectory():
                return folder
        level = [s.getPath().toString() for f in level if fs.exists(path(f)) for s in fs.listStatus(path(f)) if s.isDirectory()]
    raise FileNotFoundError(f"no folder {marker} below {root}")


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists on its file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        if h.getFileSystem(conf).exists(h):
            return p
    raise FileNotFoundError(", ".join(paths))
