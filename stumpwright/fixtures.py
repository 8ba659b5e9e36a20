"""Test inputs derived from the synthetic tables: patches, images, boxes, landmarks, a frozen model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright.functions.arithmetic import lcg

SIDE = 8
#: Images are 24 wide and 24 to 96 high; a document gives as many as its text needs.
IMAGE_WIDTH, IMAGE_HEIGHT, IMAGE_MOST = 24, 24, 96

#: stage -> threshold
STAGES = ((0, 0.2909), (1, 0.3868), (2, 0.3773))
#: stage, t, feature_id (bank of 8 x 8, least side 2), kind, x, y, w, h, threshold, polarity, alpha
STUMPS = (
    (0, 0, 150, "3h", 0, 3, 2, 3, -30.0865, -1, 0.3647),
    (0, 1, 728, "3v", 1, 1, 7, 2, -70.1062, 1, 0.3532),
    (0, 2, 105, "2h", 4, 1, 2, 2, 2.1234, 1, 0.2949),
    (1, 0, 297, "2h", 3, 0, 2, 5, -2.0752, 1, 0.3171),
    (1, 1, 465, "2v", 2, 1, 3, 3, -0.0376, 1, 0.3034),
    (1, 2, 4, "4", 0, 0, 2, 2, -1.0912, 1, 0.2984),
    (1, 3, 678, "2v", 1, 0, 5, 4, -4.9684, -1, 0.2878),
    (1, 4, 629, "2h", 0, 2, 4, 6, 2.3332, -1, 0.3075),
    (2, 0, 460, "2h", 1, 5, 3, 3, -1.6447, 1, 0.309),
    (2, 1, 72, "4", 2, 3, 2, 2, 0.0, 1, 0.2919),
    (2, 2, 497, "2v", 2, 0, 3, 4, 4.5059, 1, 0.3011),
    (2, 3, 463, "4", 2, 0, 3, 3, -1.6553, 1, 0.3163),
    (2, 4, 573, "3v", 3, 0, 4, 2, -39.3102, 1, 0.2488),
    (2, 5, 394, "2v", 2, 0, 3, 2, -0.6394, 1, 0.2734),
    (2, 6, 395, "3v", 2, 0, 3, 2, -28.1773, 1, 0.2608),
    (2, 7, 409, "2v", 2, 4, 3, 2, 0.6408, 1, 0.2912),
)
STUMP_SCHEMA = "stage int, t int, feature_id int, kind string, x int, y int, w int, h int, threshold double, polarity int, alpha double"
STAGE_SCHEMA = "stage int, threshold double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pixel(v):
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.6) * 212.5).cast("int")))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, y, split, source, px: 8 x 8 patches from embeddings."""
    k = F.col("vec_id") % 5
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("patch_id"),
        (F.col("label") < 5).cast("int").alias("y"),
        F.when(k == 0, "val").when(k == 1, "test").otherwise("train").alias("split"),
        F.concat(F.lit("src"), (F.col("vec_id") % 3).cast("string")).alias("source"),
        F.transform("embedding", _pixel).alias("px"),
    )


def patch_pixels(p: DataFrame) -> DataFrame:
    """patch_id, y, r, c, p: patches in long form."""
    long = p.select("patch_id", "y", F.posexplode("px").alias("pos", "p"))
    return long.select("patch_id", "y", F.floor(F.col("pos") / SIDE).cast("int").alias("r"), (F.col("pos") % SIDE).cast("int").alias("c"), "p")


def text_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, px, h, w: whole documents as pixels, a code point modulo 256 each, in images of at most
    IMAGE_MOST rows; rows that a text doesn't fill are zero. A null or empty text has no image."""
    n = IMAGE_WIDTH * IMAGE_MOST
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    d = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / n).cast("int") - 1)).alias("k"))
    d = d.select((F.col("doc_id") * 1_000_000 + F.col("k")).alias("image_id"), F.substr("text", F.col("k") * n + 1, F.lit(n)).alias("t"))
    d = d.withColumn("h", F.greatest(F.lit(IMAGE_HEIGHT), F.ceil(F.length("t") / IMAGE_WIDTH).cast("int")))
    px = F.transform(F.regexp_extract_all("t", F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c) % 256)
    rest = F.array_repeat(F.lit(0), F.col("h") * IMAGE_WIDTH - F.length("t"))
    return d.select("image_id", F.concat(px, rest).alias("px"), "h", F.lit(IMAGE_WIDTH).alias("w"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, id, side ('gt' or 'det'), score, x1..y2, h1..h3, size: boxes from events."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("h1", lcg(F.col("event_id"), 1103515245, 12345))
    e = e.withColumn("h2", lcg(F.col("h1"))).withColumn("h3", lcg(F.col("h2")))
    part = lambda h, n: F.floor(F.col(h) / 64).cast("bigint") % n
    e = e.withColumn("x1", part("h1", 160).cast("double")).withColumn("y1", part("h2", 120).cast("double"))
    e = e.withColumn("size", (24 + part("h3", 72)).cast("double"))
    return e.select(
        F.col("user_id").cast("bigint").alias("image_id"),
        F.col("event_id").cast("bigint").alias("id"),
        F.when(F.col("event_type") == "signup", "gt").otherwise("det").alias("side"),
        F.col("value").cast("double").alias("score"),
        "x1", "y1", (F.col("x1") + F.col("size")).alias("x2"), (F.col("y1") + F.col("size")).alias("y2"), "h1", "h2", "h3", "size",
    )


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, le, re, nose, lm, rm (points), box x1, y1, size: five points a box."""
    b = boxes(spark, sf_dir)
    wobble = lambda h, n: (F.floor(F.col(h) / 128).cast("bigint") % n).cast("double") - (n - 1) / 2
    at = lambda fx, fy, dx, dy: F.struct((F.col("x1") + F.col("size") * fx + dx).alias("x"), (F.col("y1") + F.col("size") * fy + dy).alias("y"))
    zero = F.lit(0.0)
    return b.select(
        "id", "x1", "y1", "size",
        at(0.375, 0.375, zero, wobble("h1", 17)).alias("le"), at(0.625, 0.375, zero, wobble("h2", 17)).alias("re"),
        at(0.5, 0.5, wobble("h3", 15), zero).alias("nose"),
        at(0.375, 0.75, wobble("h1", 5), zero).alias("lm"), at(0.625, 0.75, zero, wobble("h2", 5)).alias("rm"),
    )


def stumps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STUMPS), STUMP_SCHEMA)


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STAGES), STAGE_SCHEMA)
