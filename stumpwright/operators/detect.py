"""Multi-scale sliding-window detection with early exit, as chained filters over window rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright.functions.integral import integral_wide, rect_sum, window_std, xml_norm
from stumpwright.functions.resample import resize_array, resized
from stumpwright.operators.cascade import Cascade, vote
from stumpwright.operators.haar import signed_cells


def pyramid(base: tuple[int, int], image: tuple[int, int], growth: float = 1.25, min_shift: int = 2, min_face: float | None = None, max_face: float | None = None) -> list[tuple[int, float, int, int, int]]:
    """(level, scale, window width, window height, step) while the window fits the image; the scale is
    a running product."""
    (w, h), (width, height) = base, image
    scale = max(1.0, float(min_face) / max(w, h)) if min_face is not None else 1.0
    out: list[tuple[int, float, int, int, int]] = []
    while int(w * scale) <= width and int(h * scale) <= height and (max_face is None or scale <= float(max_face) / max(w, h)):
        out.append((len(out), scale, int(w * scale), int(h * scale), max(min_shift, int(scale))))
        scale *= growth
    return out


PYRAMID = "level int, scale double, win_w int, win_h int, step int"


def scales(spark: SparkSession, *args, **kwargs) -> DataFrame:
    return spark.createDataFrame(pyramid(*args, **kwargs), PYRAMID)


def spread(images: DataFrame) -> DataFrame:
    """images over all cores: dealt anew only where a small input has fewer partitions than there are
    cores, as an image's windows cost far more than moving the image."""
    cores = images.sparkSession.sparkContext.defaultParallelism
    return images.repartition(cores) if images.rdd.getNumPartitions() < cores else images


def window_grid(images: DataFrame, scales: DataFrame) -> DataFrame:
    """Every origin of every scale in every image: images' columns, the scale's, ox, oy.

    images need h and w. The scale list is a few dozen rows; windows are generated where the image is.
    """
    fits = (F.col("win_w") <= F.col("w")) & (F.col("win_h") <= F.col("h"))
    g = images.join(F.broadcast(scales), fits)
    g = g.withColumn("oy", F.explode(F.sequence(F.lit(0), F.col("h") - F.col("win_h"), F.col("step"))))
    return g.withColumn("ox", F.explode(F.sequence(F.lit(0), F.col("w") - F.col("win_w"), F.col("step"))))


def with_integrals(images: DataFrame, width: int) -> DataFrame:
    return images.withColumn("ii", integral_wide(F.col("px"), width)).withColumn("ii2", integral_wide(F.col("px"), width, 2)).drop("px")


def _corners() -> list[Column]:
    return [F.col("ox"), F.col("oy"), F.col("ox") + F.col("win_w"), F.col("oy") + F.col("win_h")]


def window_stds(grid: DataFrame, width: int) -> DataFrame:
    """grid with std, the deviation inside each window from the two integral images."""
    area = (F.col("win_w") * F.col("win_h")).cast("double")
    total, squares = rect_sum(F.col("ii"), width, *_corners()), rect_sum(F.col("ii2"), width, *_corners())
    return grid.withColumn("std", window_std(total, squares, area)).drop("ii2")


def detections(images: DataFrame, model: Cascade, width: int, height: int, min_score: float | None = None, **pyramid_options) -> DataFrame:
    """image_id, x1, y1, x2, y2, score: windows that pass every stage; the score is the sum of their
    margins over the stages. images: image_id, px, h, w, all of one width and at least of the height.

    One filter a stage, in order: a window that fails pays for no later stage. A window's row carries
    the integral images of its image, so this form is for images of a few windows; ``detections_arrow``
    is for others.
    """
    s = scales(images.sparkSession, (model.width, model.height), (width, height), **pyramid_options)
    out = window_stds(window_grid(with_integrals(spread(images), width), s), width).withColumn("margin", F.lit(0.0))
    for stage in model.stages:
        v = vote(stage, F.col("ii"), width, F.col("std"), F.col("scale"), F.col("ox"), F.col("oy"))
        out = out.withColumn("vote", v).where(F.col("vote") >= stage.threshold).withColumn("margin", F.col("margin") + F.col("vote") - stage.threshold)
    x1, y1, x2, y2 = _corners()
    found = out.select("image_id", F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.col("margin").alias("score")).alias("d"))
    if min_score is not None:
        found = found.select("image_id", F.explode(F.filter(F.array("d"), lambda d: d["score"] >= min_score)).alias("d"))
    return found.select("image_id", "d.*")


def detections_arrow(images: DataFrame, model: Cascade, min_score: float | None = None, **pyramid_options) -> DataFrame:
    """As ``detections``, for images of any size (h, w per row): an image's windows are arrays, and
    only its detections become rows. A large image then costs its pixels, not its pixels per window.
    """
    kind = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, px, h, w in _stacks(batch):
                row, *found = _stack_windows(px, len(rows), h, w, model, pyramid_options)
                if min_score is not None:
                    row, *found = (x[found[4] >= min_score] for x in (row, *found))
                ids = batch.column(0).take(pa.array(rows[row]))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int32)) for x in found[:4]), pa.array(found[4])], ["image_id", "x1", "y1", "x2", "y2", "score"])

    return spread(images).select("image_id", "h", "w", "px").mapInArrow(run, f"image_id {kind}, x1 int, y1 int, x2 int, y2 int, score double")


#: Pixels of the images of one size that are worked on at once; a larger image is worked on alone.
STACK_PIXELS = 1 << 18


def _stacks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(rows, pixels, h, w) of a batch's images (image_id, h, w, px), those of equal size together."""
    h, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
    for height, width in sorted(set(zip(h.tolist(), w.tolist()))):
        rows = np.flatnonzero((h == height) & (w == width))
        size = max(1, STACK_PIXELS // max(1, height * width))
        for k in range(0, len(rows), size):
            own = rows[k : k + size]
            yield own, batch.column(3).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False), height, width


class _Integrals:
    """The two integral images of each of n images of a size, and sums over arrays of rectangles."""

    def __init__(self, px: np.ndarray, n: int, h: int, w: int):
        a = px.astype(np.int64).reshape(n, h, w)
        self.row, self.image = w + 1, (h + 1) * (w + 1)
        self.plain, self.squared = (np.pad(x.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0))).ravel() for x in (a, a * a))

    def sums(self, t: np.ndarray, at: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
        """Sums of t in the rectangles; ``at`` is where their images begin, a multiple of ``image``."""
        top, low = at + y1 * self.row, at + y2 * self.row
        return t[low + x2] - t[top + x2] - t[low + x1] + t[top + x1]

    def std(self, at: np.ndarray, x: np.ndarray, y: np.ndarray, w: int, h: int) -> np.ndarray:
        area, box = float(w * h), (at, x, y, x + w, y + h)
        mean = self.sums(self.plain, *box) / area
        return np.maximum(np.sqrt(np.maximum(self.sums(self.squared, *box) / area - mean * mean, 0.0)), 1.0)


def _origins(n: int, h: int, w: int, win_h: int, win_w: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image, x and y of the windows of a size in n images."""
    grid = np.meshgrid(np.arange(n), np.arange(0, h - win_h + 1, step), np.arange(0, w - win_w + 1, step), indexing="ij")
    image, y, x = (g.ravel() for g in grid)
    return image, x, y


def window_stds_arrow(images: DataFrame, base: tuple[int, int], **pyramid_options) -> DataFrame:
    """image_id, level, ox, oy, std of every window, for images of any size: a window's row never carries its image."""
    kind = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, px, h, w in _stacks(batch):
                ii = _Integrals(px, len(rows), h, w)
                for level, _, win_w, win_h, step in pyramid(base, (w, h), **pyramid_options):
                    row, x, y = _origins(len(rows), h, w, win_h, win_w, step)
                    std = ii.std(row * ii.image, x, y, win_w, win_h)
                    cols = [batch.column(0).take(pa.array(rows[row])), *(pa.array(v.astype(np.int32)) for v in (np.full(len(x), level), x, y)), pa.array(std)]
                    yield pa.RecordBatch.from_arrays(cols, ["image_id", "level", "ox", "oy", "std"])

    return spread(images).select("image_id", "h", "w", "px").mapInArrow(run, f"image_id {kind}, level int, ox int, oy int, std double")


def _stack_windows(px: np.ndarray, n: int, h: int, w: int, model: Cascade, options: dict) -> list[np.ndarray]:
    """Image, x1, y1, x2, y2, score of the windows of n images of a size that pass every stage."""
    ii = _Integrals(px, n, h, w)
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 5 + [np.zeros(0)]]
    for _, scale, win_w, win_h, step in pyramid((model.width, model.height), (w, h), **options):
        image, x, y = _origins(n, h, w, win_h, win_w, step)
        std, margin = ii.std(image * ii.image, x, y, win_w, win_h), np.zeros(len(x))
        for stage in model.stages:
            total, at = np.zeros(len(x)), image * ii.image
            for s in stage.stumps:
                value = 0
                for dx, dy, sign in signed_cells(s.kind):
                    left, top = s.x + dx * s.w, s.y + dy * s.h
                    value = value + sign * ii.sums(ii.plain, at, x + int(left * scale), y + int(top * scale), x + int((left + s.w) * scale), y + int((top + s.h) * scale))
                total += s.alpha * (s.polarity * value < s.polarity * s.threshold * (scale * scale) * std)
            vote_ = total / stage.total
            alive = vote_ >= stage.threshold
            margin = (margin + vote_ - stage.threshold)[alive]
            image, x, y, std = image[alive], x[alive], y[alive], std[alive]
        out.append([image, x, y, x + win_w, y + win_h, margin])
    return [np.concatenate(c) for c in zip(*out)]


def shrink_levels(image: tuple[int, int], base: tuple[int, int], growth: float = 1.25, min_face: float | None = None, max_face: float | None = None) -> list[tuple[int, float, int, int]]:
    """(level, scale, width, height) of an image pyramid that shrinks the image instead of growing the window."""
    levels = pyramid(base, image, growth, 1, min_face, max_face)
    return [(k, s, max(base[0], round(image[0] / s)), max(base[1], round(image[1] / s))) for k, s, *_ in levels]


# The other model format: rectangles with weights, two leaves a stump, sums against a stage threshold.


@dataclass(frozen=True)
class LeafStump:
    rects: tuple[tuple[int, int, int, int, float], ...]
    threshold: float
    left: float
    right: float


@dataclass(frozen=True)
class LeafStage:
    threshold: float
    stumps: tuple[LeafStump, ...]


@dataclass(frozen=True)
class LeafCascade:
    stages: tuple[LeafStage, ...]
    width: int
    height: int


def leaf_sum(stage: LeafStage, ii: Column, width: int, norm: Column, ox: Column | int = 0, oy: Column | int = 0) -> Column:
    """Sum of the leaves a window reaches: left where the value is below threshold * norm."""
    off = lambda v, o: F.lit(v) + (o if isinstance(o, Column) else F.lit(o))
    out = F.lit(0.0)
    for s in stage.stumps:
        value = F.lit(0.0)
        for x, y, w, h, weight in s.rects:
            value = value + rect_sum(ii, width, off(x, ox), off(y, oy), off(x + w, ox), off(y + h, oy)).cast("double") * F.lit(float(weight))
        out = out + F.when(value < F.lit(s.threshold) * norm, F.lit(s.left)).otherwise(F.lit(s.right))
    return out


def base_sized(patches: DataFrame, width: int, height: int) -> DataFrame:
    """patches (px, and h and w where sizes differ) of the base size; others are resized, in Python workers that
    rows of the base size never enter."""
    if not {"h", "w"} <= set(patches.columns):
        return patches
    fits = (F.col("h") == height) & (F.col("w") == width)
    size = [F.lit(height), F.lit(width)]
    other = patches.where(~fits).withColumn("px", resized("px", "h", "w", *size, F.lit("bicubic")))
    out = patches.where(fits).unionByName(other.withColumn("px", F.col("px").cast(patches.schema["px"].dataType)))
    return out.withColumn("h", size[0]).withColumn("w", size[1])


def leaf_verdicts(patches: DataFrame, model: LeafCascade) -> DataFrame:
    """patches with passed and score (sum of stage sum - threshold over the stages until the first miss);
    patches of another size (h, w) are resized first."""
    patches = base_sized(patches, model.width, model.height)
    w, area = model.width, F.lit(float(model.width * model.height))
    last = F.element_at
    p = patches.withColumn("ii", integral_wide(F.col("px"), w)).withColumn("ii2", integral_wide(F.col("px"), w, 2))
    p = p.withColumn("norm", xml_norm(last("ii", -1), last("ii2", -1), area)).withColumn("passed", F.lit(True)).withColumn("score", F.lit(0.0))
    for s in model.stages:
        p = p.withColumn("sum", leaf_sum(s, F.col("ii"), w, F.col("norm")))
        p = p.withColumn("passed", F.col("passed") & (F.col("sum") >= s.threshold))
        p = p.withColumn("score", F.col("score") + F.when(F.col("passed"), F.col("sum") - s.threshold).otherwise(0.0))
    return p.drop("ii", "ii2", "norm", "sum")


def leaf_detections(images: DataFrame, model: LeafCascade, step: int = 2, min_score: float | None = None, **pyramid_options) -> DataFrame:
    """image_id, x1..y2, score: windows of the base size that pass every stage on shrunken images, in
    image pixels. images: image_id, h, w, px."""
    kind = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, h, w, px in zip(*(batch.column(c) for c in range(4))):
                a = px.values.to_numpy(zero_copy_only=False).astype(float).reshape(h.as_py(), w.as_py())
                found = _leaf_windows(a, model, step, pyramid_options)
                if min_score is not None:
                    found = [x[found[4] >= min_score] for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([image.as_py()] * len(found[0]), batch.schema.field(0).type), *map(pa.array, found)], ["image_id", "x1", "y1", "x2", "y2", "score"])

    return spread(images).select("image_id", "h", "w", "px").mapInArrow(run, f"image_id {kind}, x1 double, y1 double, x2 double, y2 double, score double")


def _leaf_windows(a: np.ndarray, model: LeafCascade, step: int, options: dict) -> list[np.ndarray]:
    (height, width), (bw, bh) = a.shape, (model.width, model.height)
    out = [[np.zeros(0)] * 5]
    for _, _, w, h in shrink_levels((width, height), (bw, bh), **options):
        small = resize_array(a, h, w).astype(np.int64)
        ii, ii2 = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))).ravel() for t in (small, small * small))
        row = w + 1
        y, x = (g.ravel() for g in np.meshgrid(np.arange(0, h - bh + 1, step), np.arange(0, w - bw + 1, step), indexing="ij"))

        def sums(t: np.ndarray, dx: int, dy: int, rw: int, rh: int) -> np.ndarray:
            x1, y1 = x + dx, y + dy
            return (t[(y1 + rh) * row + x1 + rw] - t[y1 * row + x1 + rw] - t[(y1 + rh) * row + x1] + t[y1 * row + x1]).astype(float)

        total = sums(ii, 0, 0, bw, bh)
        norm = np.maximum(np.sqrt(np.maximum(bw * bh * sums(ii2, 0, 0, bw, bh) - total * total, 0.0)), 1.0)
        score = np.zeros(len(x))
        for stage in model.stages:
            leaves = np.zeros(len(x))
            for s in stage.stumps:
                value = sum(k * sums(ii, *rect) for *rect, k in s.rects)
                leaves += np.where(value < s.threshold * norm, s.left, s.right)
            alive = leaves >= stage.threshold
            score = (score + leaves - stage.threshold)[alive]
            x, y, norm = x[alive], y[alive], norm[alive]
        sx, sy = width / w, height / h
        out.append([x * sx, y * sy, (x + bw) * sx, (y + bh) * sy, score])
    return [np.concatenate(c) for c in zip(*out)]


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """n, agree, rate of two verdict tables (patch_id, passed); a patch that one of them lacks disagrees."""
    j = a.select("patch_id", F.col("passed").alias("pa")).join(b.select("patch_id", F.col("passed").alias("pb")), "patch_id", "full_outer")
    same = F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))
    return j.agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), F.avg(same.cast("double")).alias("rate"))
