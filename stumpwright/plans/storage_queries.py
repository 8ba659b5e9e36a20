"""Queries through sources and sinks: tables and models written and read back, files decoded, sizes changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright import fixtures as X
from stumpwright.functions import resample
from stumpwright.plans import duck as D
from stumpwright.plans import trainer
from stumpwright.plans.patch_queries import _model
from stumpwright.plans.registry import query
from stumpwright.sources import datasets, images, models
from stumpwright.storage import shared_dir


def _bytes(px: Column) -> Column:
    return F.unhex(F.array_join(F.transform(px, lambda p: F.lpad(F.hex(p), 2, "0")), ""))


@query(f"WITH {D.PATCH} SELECT 'p' || patch_id AS path, CAST(y AS BIGINT) AS label, source, CASE WHEN y = 1 THEN NULL ELSE split END AS category, 64 AS n_bytes, px[1] AS first, px[64] AS last FROM patch WHERE source = 'src1' AND y = 0")
def labelled_shards(spark: SparkSession, sf: str) -> DataFrame:
    """A labelled image table in shards of 100 rows, read again by source and label."""
    p = X.patches(spark, sf)
    image = F.struct(_bytes(F.col("px")).alias("bytes"), F.concat(F.lit("p"), F.col("patch_id").cast("string")).alias("path"))
    path = shared_dir(spark)
    datasets.write_shards(p.select(image.alias("image"), F.col("y").alias("label"), "source", F.when(F.col("y") == 0, F.col("split")).alias("category")), path, 100)
    got = datasets.read_labelled(spark, path, "src1", 0)
    at = lambda k: F.conv(F.hex(F.substring("image.bytes", k, 1)), 16, 10).cast("int")
    return got.select("image.path", "label", "source", "category", F.octet_length("image.bytes").alias("n_bytes"), at(1).alias("first"), at(64).alias("last"))


@query(f"WITH {D.PATCH} SELECT source, split, count(*) AS n FROM patch GROUP BY source, split")
def kept_results(spark: SparkSession, sf: str) -> DataFrame:
    """A result kept under the content of its inputs; the second call reads what the first one wrote."""
    p, folder = X.patches(spark, sf).select("patch_id", "source", "split"), shared_dir(spark)
    make = lambda d: d.groupBy("source", "split").agg(F.count("*").alias("n"))
    datasets.kept(spark, folder, p, "counts", make)
    return datasets.kept(spark, folder, p, "counts", lambda d: make(d).limit(0))


@query("""SELECT 'file:/root/' || lang || '/' || CASE WHEN doc_id % 7 = 0 THEN '_' ELSE '' END || doc_id || '.jpg' AS path, lang AS category,
  CAST(octet_length(encode(text)) + CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END AS BIGINT) AS length
FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND doc_id % 7 <> 0 AND (doc_id % 3 = 0 OR octet_length(encode(text)) >= 1024)""")
def tree_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a tree, a document each: short ones without an image's leading bytes are pointers, names with _ are left out."""
    d = X.table(spark, sf, "documents").where("text is not null and lang is not null")
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, "_").otherwise(""), F.col("doc_id").cast("string"), F.lit(".jpg"))
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FFD8FF"))).otherwise(F.unhex(F.lit(""))), F.to_binary("text", F.lit("utf-8")))
    files = d.select(F.concat(F.lit("file:/root/"), "lang", F.lit("/"), name).alias("path"), content.alias("content"))
    return images.tree_rows(files.withColumn("length", F.octet_length("content").cast("bigint"))).select("path", "category", "length")


_PIXELS = f"WITH {D.IMAGE} SELECT CAST(image_id AS VARCHAR) AS path, CAST(0 AS BIGINT) AS i, h, 24 AS w, CAST(list_sum(px) AS BIGINT) AS total, CAST(px[1] AS INTEGER) AS first FROM img"


def _pixels(decoded: DataFrame) -> DataFrame:
    total = F.aggregate("px", F.lit(0).cast("bigint"), lambda a, p: a + p)
    return decoded.select("path", "i", "h", "w", total.alias("total"), F.element_at("px", 1).alias("first"))


@query(_PIXELS)
def pgm_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Text images as binary gray maps, decoded."""
    i = X.text_images(spark, sf)
    head = F.concat(F.lit("P5\n# made of text\n"), F.col("w").cast("string"), F.lit(" "), F.col("h").cast("string"), F.lit("\n255\n"))
    return _pixels(images.decode_pgm(i.select(F.col("image_id").cast("string").alias("path"), F.concat(F.to_binary(head, F.lit("utf-8")), _bytes(F.col("px"))).alias("content"))))


@query(_PIXELS)
def npy_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Text images as arrays of the .npy format, decoded."""
    i = X.text_images(spark, sf)
    shape = F.concat(F.lit("{'descr': '|u1', 'fortran_order': False, 'shape': ("), F.col("h").cast("string"), F.lit(", "), F.col("w").cast("string"), F.lit("), }"))
    head = F.concat(F.rpad(shape, 117, " "), F.lit("\n"))
    content = F.concat(F.unhex(F.lit("934E554D505901007600")), F.to_binary(head, F.lit("utf-8")), _bytes(F.col("px")))
    return _pixels(images.decode_npy(i.select(F.col("image_id").cast("string").alias("path"), content.alias("content"))))


@query(f"WITH {D.MODEL} SELECT stage, CAST(t AS INTEGER) AS t, kind, x, y, w, h, stump.threshold, polarity, alpha, stg.threshold AS stage_threshold, 8 AS width FROM stump JOIN stg USING (stage) WHERE stage < 2")
def model_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The frozen cascade saved by stage; its first two stages loaded."""
    path = shared_dir(spark)
    models.save(spark, path, _model(spark))
    m = models.load(spark, path, 2)
    rows = [(k, t, s.kind, s.x, s.y, s.w, s.h, s.threshold, s.polarity, s.alpha, stage.threshold, m.width) for k, stage in enumerate(m.stages) for t, s in enumerate(stage.stumps)]
    return spark.createDataFrame(rows, "stage int, t int, kind string, x int, y int, w int, h int, threshold double, polarity int, alpha double, stage_threshold double, width int")


@query(f"""WITH {D.PATCH}, {D.bank(4)}, {D.FVAL},
num AS (SELECT patch_id, CAST(row_number() OVER (ORDER BY patch_id) - 1 AS INTEGER) AS i FROM patch)
SELECT feature_id, list(i ORDER BY val / std, i) AS ord FROM fval JOIN pstd USING (patch_id) JOIN num USING (patch_id) GROUP BY feature_id""")
def sort_index(spark: SparkSession, sf: str) -> DataFrame:
    """The sort order of all patches by each normalised feature value, as training keeps it."""
    features, _ = trainer.feature_rows(spark, X.patches(spark, sf).select("patch_id", "px", "y"), X.SIDE, X.SIDE, trainer.Options(least_side=4))
    return trainer.sort_orders(features)


@query(f"""WITH {D.PATCH},
tap AS (SELECT o, least(7, greatest(0, k)) AS c, abs(k - ((o + 0.5) * 8 / 5 - 0.5)) AS d FROM range(0, 5) AS a(o), range(-3, 12) AS b(k)),
wt AS (SELECT o, c, sum(CAST(CASE WHEN d < 1 THEN (1.25 * d - 2.25) * d * d + 1 ELSE ((-0.75 * d + 3.75) * d - 6) * d + 3 END AS DOUBLE)) AS k FROM tap WHERE d < 2 GROUP BY o, c),
v AS (SELECT patch_id, a.o AS r, b.o AS c, sum(px[CAST(a.c * 8 + b.c + 1 AS INTEGER)] * a.k * b.k) AS v FROM patch, wt AS a, wt AS b GROUP BY ALL)
SELECT patch_id, list(CAST(greatest(0, least(255, floor(round(v, 9) + 0.5))) AS INTEGER) ORDER BY r, c) AS px FROM v GROUP BY patch_id""")
def bicubic_resize(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of 8 x 8 at 5 x 5."""
    p = X.patches(spark, sf)
    side, small = F.lit(X.SIDE), F.lit(5)
    return p.select("patch_id", resample.resized("px", side, side, small, small, F.lit("bicubic")).alias("px"))
