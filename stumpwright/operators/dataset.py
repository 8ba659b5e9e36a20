"""Dataset preparation: splits, crops, flips, counts, layouts, mean images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stumpwright.functions.arithmetic import chain, sample_order
from stumpwright.functions.geometry import reflected


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement in a hashed order of the key."""
    return rows.orderBy(sample_order(F.col(key), seed), key).limit(n)


def hold_out(rows: DataFrame, n: int, key: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(held out, rest): the sample comes first, the rest excludes it by an anti join."""
    val = sample(rows, n, key, seed)
    return val, rows.join(val.select(key), key, "left_anti")


def crop(px: Column, width: int, x: Column, y: Column, w: int, h: int) -> Column:
    """Row-major pixels of a window of a row-major image."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.slice(px, ((y + r) * width + x + 1).cast("int"), w)))


def reflect_crop(px: Column, width: int, height: Column | int, left: Column, top: Column, side: int) -> Column:
    """Square crop whose outside is reflected at the image's edges."""
    ks = F.sequence(F.lit(0), F.lit(side * side - 1))
    return F.transform(ks, lambda k: F.element_at(px, (reflected(top + F.floor(k / side).cast("int"), height) * width + reflected(left + k % side, width) + 1).cast("int")))


def hflip(px: Column, width: int) -> Column:
    """Rows of a row-major image reversed."""
    rows = F.sequence(F.lit(0), F.floor(F.size(px) / width).cast("int") - 1)
    return F.flatten(F.transform(rows, lambda r: F.reverse(F.slice(px, r * width + 1, width))))


def augmented(patches: DataFrame, width: int) -> DataFrame:
    """patches and their mirror images, told apart by ``flipped``."""
    return patches.withColumn("flipped", F.lit(0)).unionByName(patches.withColumn("px", hflip(F.col("px"), width)).withColumn("flipped", F.lit(1)))


def jitter_crops(images: DataFrame, key: str, width: int, side: int, max_shift: int, seed: int = 0) -> DataFrame:
    """Per image the centre crop (variant 0) and a crop at a hashed offset in 0..2*max_shift (variant 1)."""
    m = 2 * max_shift + 1
    off = lambda s: (F.floor(chain(F.col(key), 3, seed + s) / 64) % m).cast("int")
    where = lambda v, x, y: F.struct(F.lit(v).alias("variant"), x.alias("ox"), y.alias("oy"))
    c = F.lit(max_shift)
    rows = images.withColumn("v", F.explode(F.array(where(0, c, c), where(1, off(0), off(1)))))
    return rows.select(key, "v.variant", "v.ox", "v.oy", crop(F.col("px"), width, F.col("v.ox"), F.col("v.oy"), side, side).alias("px"))


def random_crops(images: DataFrame, key: str, side: int, per_image: int, target: int, seed: int = 0) -> DataFrame:
    """key, pass, k, ox, oy: crops at hashed places, pass by pass over all images that are large
    enough, until ``target``. The number of passes is known from the image count, so it is one job."""
    big = images.where((F.col("w") >= side) & (F.col("h") >= side)).select(key, "w", "h")
    n = big.count()
    if not n:
        return big.select(key, *[F.lit(0).alias(c) for c in ("pass", "k", "ox", "oy")]).limit(0)
    passes = math.ceil(target / (n * per_image))
    c = big.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_image - 1))))
    slot = F.col(key) * 1009 + F.col("pass") * 31 + F.col("k")
    place = lambda s, span: (F.floor(chain(slot, 3, seed + s) / 64) % (span - side + 1)).cast("int")
    out = c.select(key, "pass", "k", place(0, F.col("w")).alias("ox"), place(1, F.col("h")).alias("oy"))
    return out.orderBy("pass", sample_order(F.col(key), seed), key, "k").limit(target)


def excludes_keywords(category: Column, words: tuple[str, ...] = ("face", "people", "human")) -> Column:
    """False for categories that name a person; the words are fixed values."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(category), F.lit(w))
    return ~out


def counts(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts by all columns with subtotals from the right (rollup)."""
    return rows.rollup(*columns).agg(F.count("*").alias("n"))


def capped(rows: DataFrame, group: str, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group, numbered from 0 (``seq``)."""
    seq = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return rows.withColumn("seq", seq).where(F.col("seq") < n)


def grid_layout(rows: DataFrame, order: list[Column | str], columns: int, cell: int, pad: int) -> DataFrame:
    """rows with their place in a mosaic: row, col and the cell's corner x, y. A mosaic is a page of
    pictures, so one ordered numbering is enough."""
    i = F.row_number().over(Window.orderBy(*order)) - 1
    out = rows.withColumn("i", i)
    out = out.withColumn("row", F.floor(F.col("i") / columns).cast("int")).withColumn("col", (F.col("i") % columns).cast("int"))
    return out.withColumn("x", pad + F.col("col") * (cell + pad)).withColumn("y", pad + F.col("row") * (cell + pad)).drop("i")


def pixel_stats(patches: DataFrame, *by: str) -> DataFrame:
    """by, n, mean, std: count, pixel mean and deviation per group, from sums per patch."""
    s = patches.select(*by, F.aggregate("px", F.lit(0.0), lambda a, x: a + x).alias("a"), F.aggregate("px", F.lit(0.0), lambda a, x: a + x * x).alias("b"), F.size("px").alias("k"))
    mean = F.sum("a") / F.sum("k")
    return s.groupBy(*by).agg(F.count("*").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.sum("b") / F.sum("k") - mean * mean, F.lit(0.0))).alias("std"))


def value_stats(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """by, n, mean, std of a column."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def mean_image(pixels: DataFrame) -> DataFrame:
    """r, c, mean over (r, c, p) rows."""
    return pixels.groupBy("r", "c").agg(F.avg("p").alias("mean"))


# 1-D weights of a 3-tap Gaussian with sigma 0.6, outer and middle.
_SIDE = math.exp(-1 / (2 * 0.6 * 0.6))
BLUR = (_SIDE / (1 + 2 * _SIDE), 1 / (1 + 2 * _SIDE))


def blurred(mean: DataFrame, height: int, width: int) -> DataFrame:
    """r, c, v: a 3 x 3 Gaussian of a mean image, reflected at the edges (without the edge itself).

    A mean image is of one patch's size, whatever the number of patches."""
    taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(BLUR[d == 0]).alias("k")) for d in (-1, 0, 1)])
    around = mean.select("r", "c").distinct().withColumn("a", F.explode(taps)).withColumn("b", F.explode(taps))
    around = around.select("r", "c", reflected(F.col("r") + F.col("a.d"), height).alias("rr"), reflected(F.col("c") + F.col("b.d"), width).alias("cc"), (F.col("a.k") * F.col("b.k")).alias("k"))
    m = mean.select(F.col("r").alias("rr"), F.col("c").alias("cc"), "mean")
    return around.join(m, ["rr", "cc"]).groupBy("r", "c").agg(F.sum(F.col("mean") * F.col("k")).alias("v"))


def eyes_and_mouth(mean: DataFrame, height: int, width: int) -> DataFrame:
    """part ('left_eye', 'right_eye', 'mouth'), r, c of the dark spots of a mean face.

    Eyes: the darkest spot of the upper two thirds, then the darkest a quarter of the width away.
    Mouth: the darkest in the middle columns from a quarter of the height below the eyes on.
    """
    upper = blurred(mean.where(F.col("r") < height * 2 // 3), height * 2 // 3, width)
    dark = F.struct(F.round("v", 9).alias("v"), "r", "c")
    first = upper.agg(F.min(dark).alias("a"))
    second = upper.crossJoin(F.broadcast(first)).where(F.abs(F.col("c") - F.col("a.c")) >= width * 0.25).agg(F.min(dark).alias("b"))
    eyes = first.crossJoin(second).select("a", "b")
    found = eyes.first()
    spark = mean.sparkSession
    if found is None or found.a is None or found.b is None:
        return spark.createDataFrame([], "part string, r int, c int")
    pair = sorted([(found.a.c, found.a.r), (found.b.c, found.b.r)])
    top = int((pair[0][1] + pair[1][1]) / 2 + 0.25 * height)
    rows = [("left_eye", pair[0][1], pair[0][0]), ("right_eye", pair[1][1], pair[1][0])]
    below = mean.where(F.col("r") >= top)
    if top < height:
        soft = blurred(below.withColumn("r", F.col("r") - top), height - top, width).withColumn("r", F.col("r") + top)
        m = soft.where((F.col("c") >= int(width * 0.3)) & (F.col("c") < int(width * 0.7))).agg(F.min(dark).alias("m")).first().m
        rows.append(("mouth", m.r, m.c))
    else:
        rows.append(("mouth", height - 1, width // 2))
    return spark.createDataFrame(rows, "part string, r int, c int")
