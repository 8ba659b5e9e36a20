"""Patch bundles: one Parquet table partitioned by split, with a manifest; raw .npy arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright.storage import shared_dir

#: Splits of a bundle; those with True must be there.
SPLITS = {"train_pos": True, "val_pos": True, "caltech_pool": True, "neg_seed": False, "test_pos": False, "test_neg": False}


def write(patches: DataFrame, path: str) -> None:
    """Overwrite the splits that patches hold; stale rows of those splits go, other splits stay."""
    patches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy("split").parquet(path)


def write_whole(patches: DataFrame, path: str) -> None:
    """A new bundle at path: the splits that patches hold, and none that an older bundle left there."""
    spark = patches.sparkSession
    write(patches, path)
    have = {r.split for r in patches.select("split").distinct().collect()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith("split=") and name.removeprefix("split=") not in have:
            fs.delete(s.getPath(), True)


def read(spark: SparkSession, path: str, split: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """The bundle, or one split of it (partition pruning). Missing required splits are an error."""
    df = spark.read.parquet(path)
    if required:
        have = {r.split for r in df.select("split").distinct().collect()}
        if missing := [s for s in required if s not in have]:
            raise ValueError(f"bundle without {', '.join(missing)}")
    return df if split is None else df.where(F.col("split") == split)


def manifest(patches: DataFrame, resolution: int) -> DataFrame:
    """split, n, pixels, resolution."""
    g = patches.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.size("px")).alias("pixels"))
    return g.withColumn("resolution", F.lit(resolution))


def roundtrip_manifest(patches: DataFrame, resolution: int) -> DataFrame:
    path = shared_dir(patches.sparkSession)
    write(patches, path)
    return manifest(read(patches.sparkSession, path), resolution)


def check_resolution(patches: DataFrame, resolution: int) -> DataFrame:
    """patches; a row of another size fails the job when it is read."""
    fits = F.size("px") == resolution * resolution
    return patches.withColumn("px", F.when(fits, F.col("px")).otherwise(F.raise_error(F.lit(f"a patch is not {resolution} x {resolution}"))))
