"""Folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only in local mode, where that is unset, below the temp folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{(base or os.path.join(tempfile.gettempdir(), 'checkpoints')).rstrip('/')}/stumpwright-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read back: its rows are computed once and outlive executors."""
    path = shared_dir(df.sparkSession)
    _folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that ``kept`` wrote in this process; for when their results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _folders:
        path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(conf).delete(path, True)
