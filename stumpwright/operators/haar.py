"""Rectangle-feature banks and their values on patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stumpwright.functions.integral import integral_wide, sample_std

KINDS = ("2h", "2v", "3h", "3v", "4")
#: kind -> (columns, rows) of the rectangle grid that must fit, and its cells (dx, dy, sign).
_LAYOUT = {
    "2h": ((2, 1), ((0, 0, -1), (1, 0, 1))),
    "2v": ((1, 2), ((0, 1, -1), (0, 0, 1))),
    "3h": ((3, 1), ((0, 0, -1), (2, 0, -1), (1, 0, 1))),
    "3v": ((1, 3), ((0, 0, -1), (0, 2, -1), (0, 1, 1))),
    "4": ((2, 2), ((0, 0, -1), (1, 1, -1), (0, 1, 1), (1, 0, 1))),
}


def signed_cells(kind: str) -> tuple[tuple[int, int, int], ...]:
    return _LAYOUT[kind][1]


def rectangles(kind: Column) -> Column:
    """Signed rectangles (x, y, w, h, sign) of a feature row with columns kind, x, y, w, h."""

    def of(k: str) -> Column:
        return F.array(*[
            F.struct(
                (F.col("x") + dx * F.col("w")).cast("int").alias("x"), (F.col("y") + dy * F.col("h")).cast("int").alias("y"),
                F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.lit(sign).alias("sign"),
            )
            for dx, dy, sign in signed_cells(k)
        ])

    out = F.when(kind == KINDS[0], of(KINDS[0]))
    for k in KINDS[1:]:
        out = out.when(kind == k, of(k))
    return out


def bank(spark: SparkSession, width: int, height: int, min_w: int = 4, min_h: int = 4, shift: int = 1) -> DataFrame:
    """feature_id, kind, x, y, w, h, rects: all features of a window, numbered by (w, h, x, y, kind).

    The size depends on the window alone (60,153 features for 24 x 24), so one partition numbers it.
    """
    sizes = spark.range(min_w, width + 1).select(F.col("id").cast("int").alias("w")).crossJoin(spark.range(min_h, height + 1).select(F.col("id").cast("int").alias("h")))
    placed = sizes.withColumn("x", F.explode(F.sequence(F.lit(0), width - F.col("w"), F.lit(shift)))).withColumn("y", F.explode(F.sequence(F.lit(0), height - F.col("h"), F.lit(shift))))
    fits = F.array_compact(F.array(*[
        F.when((F.col("x") + cols * F.col("w") <= width) & (F.col("y") + rows * F.col("h") <= height), F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind")))
        for i, k in enumerate(KINDS)
        for cols, rows in [_LAYOUT[k][0]]
    ]))
    each = placed.withColumn("f", F.explode(fits)).select("w", "h", "x", "y", "f.i", "f.kind")
    number = F.row_number().over(Window.orderBy("w", "h", "x", "y", "i")) - 1
    return each.select(number.cast("int").alias("feature_id"), "kind", "x", "y", "w", "h").withColumn("rects", rectangles(F.col("kind")))


def corner_reads(rects: Column, width: int) -> Column:
    """Reads of a wide integral image (1-based index i, factor k) whose sum is the feature's value."""
    at = lambda x, y: (y * (width + 1) + x + 1).cast("int")
    read = lambda i, k: F.struct(i.alias("i"), k.cast("int").alias("k"))
    return F.flatten(F.transform(rects, lambda r: F.array(
        read(at(r["x"] + r["w"], r["y"] + r["h"]), r["sign"]), read(at(r["x"] + r["w"], r["y"]), -r["sign"]),
        read(at(r["x"], r["y"] + r["h"]), -r["sign"]), read(at(r["x"], r["y"]), r["sign"]),
    )))


def values(patches: DataFrame, features: DataFrame, width: int, normalized: bool = False) -> DataFrame:
    """patch_id, y, feature_id, val: every feature on every patch.

    The bank, of a size fixed by the window, goes to every task; rows of patches are never shuffled.
    """
    ii = patches.select("patch_id", "y", integral_wide(F.col("px"), width).alias("ii"), sample_std(F.col("px")).alias("std"))
    reads = features.select("feature_id", corner_reads(F.col("rects"), width).alias("reads"))
    raw = F.aggregate("reads", F.lit(0).cast("bigint"), lambda a, r: a + F.element_at("ii", r["i"]) * r["k"])
    value = raw / F.col("std") if normalized else raw
    return ii.crossJoin(F.broadcast(reads)).select("patch_id", "y", "feature_id", value.alias("val"))
