"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpwright.llm.common import joined, remove, shared_dir


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of the edges (u, v), longs.

    Large-star and small-star steps alternate until the edges are stars. Each round is written to
    the shared folder, and the round before it removed. A hub, the node of many edges, never has its
    edges met in one task: its least neighbour is aggregated before the shuffle, and then broadcast.
    """
    spark, old, last = edges.sparkSession, None, None
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        path = shared_dir(spark)
        now.write.parquet(path)
        now = spark.read.schema("u long, v long").parquet(path)
        if old:
            remove(spark, old)
        old = path
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            break
        last = seen
        now = _small_star(_large_star(now, seen[0]))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k")
    return joined(both, least, ["u"], "k", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """After a large star a node's smaller neighbours are the least nodes of their own neighbourhoods,
    so few: no key is hot here."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
