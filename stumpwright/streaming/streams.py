"""Structured Streaming: event windows, and mining from an unbounded stream of patches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright.functions.arithmetic import sample_order
from stumpwright.operators.cascade import Cascade, accepted
from stumpwright.storage import shared_dir


def read_parquet_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A file stream with the schema that the files have now; path is a file, a folder or a glob.

    A stream takes a folder or a glob, so the last character becomes a class of one."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    path = path.rstrip("/")
    path = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_windows(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of tumbling windows. ts is cast, as a watermark needs a time zone."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = e.groupBy(F.window("at", length).alias("win"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("win.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def run_available(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is available now, batch by batch, with its state in the shared folder."""
    spark = stream.sparkSession
    q = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", shared_dir(spark))
        .trigger(availableNow=True).foreachBatch(each).start()
    )
    q.awaitTermination()


def completed(stream: DataFrame) -> DataFrame:
    """The final result of a stream in complete mode, as a table in the shared folder: each batch
    overwrites the one before."""
    spark, path = stream.sparkSession, shared_dir(stream.sparkSession)
    run_available(stream, "complete", lambda df, _: df.write.mode("overwrite").parquet(path))
    return spark.read.parquet(path)


def mine_stream(patches: DataFrame, model: Cascade, target: int, budget: int, seed: int = 0) -> DataFrame:
    """Accepted patches of a stream until ``target`` are found or ``budget`` scanned.

    A batch is scanned in a hashed order up to what the budget leaves. Counters follow from the
    parts written so far, so a batch that is run again after a failure overwrites its own part and
    nothing is counted twice.
    """
    spark, path = patches.sparkSession, shared_dir(patches.sparkSession)
    done: dict[int, tuple[int, int]] = {}

    def batch(df: DataFrame, k: int) -> None:
        found = sum(f for b, (f, _) in done.items() if b < k)
        scanned = sum(s for b, (_, s) in done.items() if b < k)
        if found >= target or scanned >= budget:
            return
        h = "__order"
        part = df.withColumn(h, sample_order(F.col("patch_id"), seed)).orderBy(h, "patch_id").limit(budget - scanned)
        kept = accepted(part, model).orderBy(h, "patch_id").limit(target - found).drop(h)
        kept.write.mode("overwrite").parquet(f"{path}/batch={k}")
        done[k] = (spark.read.parquet(f"{path}/batch={k}").count(), part.count())

    run_available(patches, "append", batch)
    return spark.read.parquet(path).drop("batch") if done else spark.createDataFrame([], patches.schema)
