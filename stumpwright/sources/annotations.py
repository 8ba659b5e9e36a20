"""Annotation sources: ellipse lists, landmark lists, object annotations in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright.functions.geometry import ellipse_box

#: Object annotations: images and their boxes.
COCO_SCHEMA = (
    "images array<struct<id:bigint,file_name:string>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>>>"
)


def ellipse_blocks(text: Column) -> Column:
    """Blocks of an ellipse list: array of (image, ellipses as arrays of numbers).

    A block is an image path, a count n, and n lines whose first five fields are half axes, angle
    and centre. The count line tells where the next block begins, so lines are folded in order.
    """
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    numbers = lambda x: F.transform(F.slice(F.split(x, r"\s+"), 1, 5), lambda v: v.cast("double"))
    empty = F.array().cast("array<struct<image:string,ellipses:array<array<double>>>>")
    start = F.struct(F.lit(-1).alias("left"), F.lit("").alias("image"), empty.alias("out"))

    def step(a: Column, line: Column) -> Column:
        last = F.element_at(a["out"], -1)
        grown = F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(F.struct(last["image"].alias("image"), F.concat(last["ellipses"], F.array(numbers(line))).alias("ellipses"))))
        opened = F.concat(a["out"], F.array(F.struct(a["image"].alias("image"), F.array().cast("array<array<double>>").alias("ellipses"))))
        n = F.when(line.rlike(r"^\d+$"), F.try_to_number(line, F.lit("9999999999")).cast("int")).otherwise(0)
        return (
            F.when(a["left"] == -1, F.struct(F.lit(-2).alias("left"), line.alias("image"), a["out"].alias("out")))
            .when(a["left"] == -2, F.struct(F.when(n == 0, -1).otherwise(n).alias("left"), a["image"].alias("image"), opened.alias("out")))
            .otherwise(F.struct(F.when(a["left"] == 1, -1).otherwise(a["left"] - 1).alias("left"), a["image"].alias("image"), grown.alias("out")))
        )

    return F.aggregate(lines, start, step, lambda a: a["out"])


def ellipses(texts: DataFrame, column: str = "value") -> DataFrame:
    """image, gt_id (from 0 in each image), x1..y2: boxes around the ellipses; images without any
    have one row with NULLs."""
    b = texts.select(F.explode(ellipse_blocks(F.col(column))).alias("b"))
    e = b.select(F.col("b.image").alias("image"), F.posexplode_outer("b.ellipses").alias("gt_id", "e"))
    v = [F.element_at("e", i) for i in range(1, 6)]
    return e.withColumn("box", F.when(F.col("e").isNotNull(), ellipse_box(*v))).select("image", "gt_id", "box.*")


def read_ellipses(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return ellipses(spark.read.text(paths, wholetext=True))


_POINTS = ("left_eye", "right_eye", "nose", "left_mouth", "right_mouth")


def landmarks(texts: DataFrame, column: str = "value") -> DataFrame:
    """file and five points from a whole landmark list: two header lines, then a name and ten numbers a line."""
    lines = texts.select(F.posexplode(F.split(column, r"\r?\n")).alias("i", "line")).where((F.col("i") >= 2) & (F.trim("line") != ""))
    f = F.split(F.trim("line"), r"\s+")
    point = lambda k: F.struct(F.element_at(f, 2 * k + 2).cast("double").alias("x"), F.element_at(f, 2 * k + 3).cast("double").alias("y"))
    return lines.select(F.element_at(f, 1).alias("file"), *[point(k).alias(n) for k, n in enumerate(_POINTS)])


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    return landmarks(spark.read.text(path, wholetext=True))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COCO_SCHEMA).json(path, multiLine=True)


def coco_boxes(doc: DataFrame, category: int = 1, min_side: float = 24.0, strict_zero: bool = True) -> DataFrame:
    """ann_id, file_name, bbox, verdict of the annotations of a category.

    verdict: 'bad_bbox' (missing, or with a zero entry where strict_zero), 'too_small', 'load_fail'
    (no such image) or 'ok'.
    """
    a = doc.select(F.explode("annotations").alias("a")).select("a.*").where(F.col("category_id") == category)
    i = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    b = F.col("bbox")
    zero = F.exists(b, lambda v: v == 0) if strict_zero else (F.get(b, F.lit(2)) == 0) | (F.get(b, F.lit(3)) == 0)
    verdict = (
        F.when(b.isNull() | (F.size(b) < 4) | zero, "bad_bbox")
        .when(F.least(F.get(b, F.lit(2)), F.get(b, F.lit(3))) < min_side, "too_small")
        .when(F.col("file_name").isNull(), "load_fail")
        .otherwise("ok")
    )
    return a.join(i, "image_id", "left").select(F.col("id").alias("ann_id"), "image_id", "file_name", "bbox", verdict.alias("verdict"))


def merged_splits(train: DataFrame, valid: DataFrame, name: str = "file_name") -> DataFrame:
    """Both splits' rows, the names of the second prefixed so they can't clash."""
    return train.unionByName(valid.withColumn(name, F.concat(F.lit("v_"), F.col(name))))
