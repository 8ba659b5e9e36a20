"""What the corpus operators share: tables, shared folders, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate normalised words: everything below 0x80 but digits and letters.
_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: A-Z to a-z, separators to a space; bytes of multi-byte characters stay.
WORD_TABLE = bytes.maketrans(
    _SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123))
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` as UTF-8; null has none."""
    return [] if text is None else utf8(text).translate(WORD_TABLE).split()


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


#: Folders of this process's intermediate tables.
_folders: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only in local mode may the session name none; the temp folder is shared there.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(base)
    _folders.append(f"{base.rstrip('/')}/stumpwright-{uuid.uuid4().hex}")
    return _folders[-1]


def written(df: DataFrame, path: str | None = None, partitions: int | None = None, level: int = 3) -> DataFrame:
    """df written as Parquet (zstd of the level) in the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    (df if partitions is None else df.coalesce(partitions)).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def size_of(table: DataFrame) -> int:
    """Bytes on disk of a table of ``written``."""
    spark = table.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._folder)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def release(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later plan reads."""
    for t in tables:
        remove(t.sparkSession, t._folder)
        if t._folder in _folders:
            _folders.remove(t._folder)


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; for when its results are written."""
    while _folders:
        remove(spark, _folders.pop())


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A key with more than one row in so many is joined by broadcast; there are fewer than so many such keys.
HOT_SHARE = 2000


def joined(left: DataFrame, right: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """left joined with right, which has a row a key and in ``n`` the key's number of rows in left; total
    is the number of left's rows. Columns: left's, then right's others.

    Keys with more than total / HOT_SHARE rows, fewer than HOT_SHARE by that bound, are broadcast, so
    their rows never meet in a task; the others are merged. Plans of both are read twice: they should be
    tables or have their exchange reused.
    """
    hot = F.broadcast(right.where(F.col(n) * HOT_SHARE > total))
    often = left.join(hot, key)
    seldom = left.join(hot.select(*key), key, "left_anti").join(right.where(F.col(n) * HOT_SHARE <= total).hint("merge"), key)
    return often.unionByName(seldom)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under own names, so extra columns can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])
