"""Labelled image tables and results kept by the content they come from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright.sources.images import first_existing

#: The table's schema: an image as bytes with its path, a label, a source, a category that may be NULL.
IMAGE_SCHEMA = "image struct<bytes:binary,path:string>, label bigint, source string, category string"
LABELS = {0: "non_face", 1: "face"}


def read_labelled(spark: SparkSession, path: str, source: str | None = None, label: int | None = None) -> DataFrame:
    """Rows of one source and label; both filters reach the scan, before any image is decoded."""
    df = spark.read.schema(IMAGE_SCHEMA).parquet(path)
    if source is not None:
        df = df.where(F.col("source") == source)
    return df if label is None else df.where(F.col("label") == label)


def write_shards(df: DataFrame, path: str, rows_per_shard: int = 10_000) -> None:
    """The table in files of at most rows_per_shard rows, in the fixed column order."""
    columns = df.select(F.col("image").cast("struct<bytes:binary,path:string>"), F.col("label").cast("bigint"), "source", "category")
    columns.write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", rows_per_shard).parquet(path)


def without_source(spark: SparkSession, path: str, new_path: str, source: str) -> bool:
    """Rewrite a table without one source to new_path; False, and nothing written, if it has none."""
    df = spark.read.parquet(path)
    if not df.where(F.col("source") == source).limit(1).count():
        return False
    df.where(~F.col("source").eqNullSafe(F.lit(source))).write.mode("overwrite").parquet(new_path)
    return True


def kept(spark: SparkSession, folder: str, inputs: DataFrame, options: object, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(inputs), written once below folder under a fingerprint of the input rows and the options,
    so changed inputs or options never meet an old result."""
    rows = inputs.agg(F.count("*"), F.sum(F.xxhash64(*inputs.columns).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(*inputs.columns))).first()
    key = hashlib.sha256(repr((tuple(rows), inputs.schema.json(), options)).encode()).hexdigest()[:32]
    path = f"{folder.rstrip('/')}/{key}"
    try:
        first_existing(spark, f"{path}/_SUCCESS")
    except FileNotFoundError:
        make(inputs).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
