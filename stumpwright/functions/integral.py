"""Integral images, in long form (a row per cell) and wide form (an array per patch)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


def integral_long(px: DataFrame, power: int = 1) -> DataFrame:
    """patch_id, r, c, v: the padded integral image of p^power over (patch_id, r, c, p) rows.

    Two running sums; both windows are partitioned by patch, so one shuffle serves them.
    """
    p = F.col("p").cast("bigint")
    value = p if power == 1 else p * p
    along = Window.partitionBy("patch_id", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("patch_id", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    by_patch = px.repartition("patch_id").withColumn("rs", F.sum(value).over(along))
    inner = by_patch.select("patch_id", (F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c"), F.sum("rs").over(down).alias("v"))
    size = px.groupBy("patch_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    top = size.select("patch_id", F.lit(0).alias("r"), F.explode(F.sequence(F.lit(0), "w")).alias("c"), F.lit(0).cast("bigint").alias("v"))
    left = size.select("patch_id", F.explode(F.sequence(F.lit(1), "h")).alias("r"), F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("v"))
    return inner.unionByName(top).unionByName(left)


def integral_wide(px: Column, w: int, power: int = 1) -> Column:
    """Row-major array of (h+1)(w+1) sums from a row-major pixel array; stays in the JVM."""
    value = lambda p: p.cast("bigint") if power == 1 else p.cast("bigint") * p.cast("bigint")
    running = lambda row: F.aggregate(
        row, F.array(F.lit(0).cast("bigint")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + value(p)))
    )
    zero = F.array_repeat(F.lit(0).cast("bigint"), w + 1)
    rows = F.sequence(F.lit(0), F.floor(F.size(px) / w).cast("int") - 1)
    return F.aggregate(
        rows,
        zero,
        lambda a, r: F.concat(a, F.zip_with(F.slice(a, -(w + 1), w + 1), running(F.slice(px, r * w + 1, w)), lambda u, v: u + v)),
    )


@F.pandas_udf(ArrayType(LongType()))
def integral_arrow(px: pd.Series, w: pd.Series) -> pd.Series:
    """As integral_wide for large images: one cumulative sum per image over Arrow batches."""

    def one(p: np.ndarray, w: int) -> np.ndarray:
        a = np.asarray(p, np.int64).reshape(-1, w)
        out = np.zeros((a.shape[0] + 1, w + 1), np.int64)
        out[1:, 1:] = a.cumsum(0).cumsum(1)
        return out.ravel()

    return pd.Series([one(p, int(n)) for p, n in zip(px, w)])


def rect_sum(ii: Column, w: Column | int, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Sum over [x1,x2) x [y1,y2) by four reads of a wide integral image of an image of width w."""
    width = (w if isinstance(w, Column) else F.lit(w)) + 1
    at = lambda x, y: F.element_at(ii, (y * width + x + 1).cast("int"))
    return at(x2, y2) - at(x2, y1) - at(x1, y2) + at(x1, y1)


def scaled_corner(v: Column, scale: Column | float, offset: Column | int = 0) -> Column:
    """A corner at a scale: the product is truncated, corner by corner, before the offset is added."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return (v.cast("double") * s).cast("int") + (offset if isinstance(offset, Column) else F.lit(offset))


def region_sum(ii: Column, w: int, rect: Column, scale: Column | float = 1.0, ox: Column | int = 0, oy: Column | int = 0) -> Column:
    """Sum of a rectangle struct (x, y, w, h) at a scale and offset."""
    return rect_sum(
        ii,
        w,
        scaled_corner(rect["x"], scale, ox),
        scaled_corner(rect["y"], scale, oy),
        scaled_corner(rect["x"] + rect["w"], scale, ox),
        scaled_corner(rect["y"] + rect["h"], scale, oy),
    )


def sample_std(px: Column) -> Column:
    """Population standard deviation of an array, 1.0 at least: running mean and squared distance in the
    array's order, as the SQL's stddev_pop has them to the last bit, since sort orders show it."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sq"))

    def step(a: Column, p: Column) -> Column:
        mean = a["mean"] + (p - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["sq"] + (p - a["mean"]) * (p - mean)).alias("sq"))

    return F.greatest(F.aggregate(px, start, step, lambda a: F.sqrt(a["sq"] / a["n"])), F.lit(1.0))


def sample_stds(a: np.ndarray) -> np.ndarray:
    """sample_std over the first axis, in the same order of operations."""
    mean, sq = np.zeros(a.shape[1:]), np.zeros(a.shape[1:])
    for n, p in enumerate(a, 1):
        away = p - mean
        mean = mean + away / n
        sq += away * (p - mean)
    return np.maximum(np.sqrt(sq / len(a)), 1.0)


def window_std(total: Column, squares: Column, area: Column) -> Column:
    """Standard deviation from a sum and a sum of squares, 1.0 at least."""
    mean = total / area
    return F.greatest(F.sqrt(F.greatest(squares / area - mean * mean, F.lit(0.0))), F.lit(1.0))


def xml_norm(total: Column, squares: Column, area: Column) -> Column:
    """The other model format's factor: sqrt(area * squares - total^2), 1.0 at least."""
    t = total.cast("double")
    return F.greatest(F.sqrt(F.greatest(area * squares.cast("double") - t * t, F.lit(0.0))), F.lit(1.0))
