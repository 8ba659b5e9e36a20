"""Detections against ground truth: matching, average precision, reports."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpwright.functions.geometry import iou
from stumpwright.operators import nms, ranking
from stumpwright.storage import kept


def overlaps(det: DataFrame, gt: DataFrame, least: float, cell: int = 64) -> DataFrame:
    """image_id, det_id, gt_id, score, iou of pairs in one image that overlap by ``least`` (more than 0) or more.

    Boxes meet by (image, stripe of the x axis), and a pair counts in the first stripe it shares."""
    corners = ("x1", "y1", "x2", "y2")

    def striped(boxes: DataFrame, id_: str, prefix: str, *more: str) -> DataFrame:
        stripe = lambda x: F.floor(x / cell).cast("int")
        own = boxes.select("image_id", F.col("id").alias(id_), *more, *[F.col(c).alias(prefix + c) for c in corners])
        own = own.withColumn(prefix + "first", stripe(F.col(prefix + "x1")))
        return own.withColumn("stripe", F.explode(F.sequence(F.col(prefix + "first"), stripe(F.col(prefix + "x2")))))

    both = striped(det, "det_id", "d", "score").join(striped(gt, "gt_id", "g"), ["image_id", "stripe"]).where(F.col("stripe") == F.greatest("dfirst", "gfirst"))
    side = lambda p: {c: F.col(p + c) for c in corners}
    return both.withColumn("iou", iou(side("d"), side("g"))).where(F.col("iou") >= least).select("image_id", "det_id", "gt_id", "score", "iou")


def _greedy(table: pa.Table) -> pa.Table:
    """One image: detections by falling score take the free box of highest overlap (ties: the later)."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("score", "det_id", "iou", "gt_id"))), key=lambda r: (-r[0], r[1], -r[2], -r[3]))
    used: set[int] = set()
    done: dict[int, int] = {}
    for _, det, _, gt in rows:
        if det not in done and gt not in used:
            used.add(gt)
            done[det] = gt
    image = table.column("image_id")[0].as_py() if table.num_rows else 0
    return pa.table({"image_id": pa.array([image] * len(done), pa.int64()), "det_id": pa.array(list(done), pa.int64()), "gt_id": pa.array(list(done.values()), pa.int64())})


def matched(det: DataFrame, gt: DataFrame, threshold: float) -> DataFrame:
    """image_id, det_id, gt_id of the greedy one-to-one matching. Only overlapping pairs reach the
    per-image step."""
    return overlaps(det, gt, threshold).groupBy("image_id").applyInArrow(_greedy, "image_id long, det_id long, gt_id long")


def flagged(det: DataFrame, gt: DataFrame, threshold: float) -> DataFrame:
    """det_id, image_id, score, tp for all detections."""
    hits = matched(det, gt, threshold).select("image_id", "det_id", F.lit(1).alias("tp"))
    return det.select("image_id", F.col("id").alias("det_id"), "score").join(hits, ["image_id", "det_id"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))


_ORDER = (F.desc, "score"), (F.asc, "image_id"), (F.asc, "det_id")


def _curve(flags: DataFrame, n_gt: int) -> DataFrame:
    order = [f(c) for f, c in _ORDER]
    c = ranking.ranked(ranking.dealt(flags.select("image_id", "det_id", "score", "tp"), *order), *order, sums=("tp",))
    return c.select(ranking.PART, "rk", "tp", "cum_tp", (F.col("rk") - F.col("cum_tp")).alias("cum_fp"), (F.col("cum_tp") / max(n_gt, 1)).alias("recall"), (F.col("cum_tp") / F.col("rk")).alias("precision"))


def curve(flags: DataFrame, n_gt: int) -> DataFrame:
    """rk, tp, cum_tp, cum_fp, recall, precision by (score desc, image, det); ranges of the order are numbered side by side."""
    return _curve(flags, n_gt).drop(ranking.PART)


def summary(flags: DataFrame, n_gt: int) -> DataFrame:
    """One row: all-points average precision (envelope of precision), final recall and precision, counts."""
    envelope = ranking.largest_after(_curve(flags, n_gt), "precision", F.col("rk"))
    n = F.count("*")
    tp = F.coalesce(F.sum("tp"), F.lit(0))
    return envelope.agg(
        F.coalesce(F.sum(F.when(F.col("tp") == 1, F.col("after") / max(n_gt, 1))), F.lit(0.0)).alias("ap"),
        (tp / max(n_gt, 1)).cast("double").alias("recall"),
        F.coalesce(F.try_divide(tp.cast("double"), n.cast("double")), F.lit(0.0)).alias("precision"),
        n.alias("n_det"), tp.alias("tp"), (n - tp).alias("fp"),
    )


def recall_at_fp(flags: DataFrame, n_gt: int, budgets: tuple[int, ...] = (50, 100, 284, 500, 1000)) -> DataFrame:
    """budget, recall: at the first detection whose false positives exceed the budget, else at the last.

    One pass over the curve answers all budgets."""
    first = lambda b: F.min_by("recall", F.when(F.col("cum_fp") > b, F.col("rk")))
    found = _curve(flags, n_gt).agg(*[first(b).alias(f"b{i}") for i, b in enumerate(budgets)], F.max("recall").alias("last"))
    rows = F.array(*[F.struct(F.lit(b).alias("budget"), F.coalesce(f"b{i}", "last", F.lit(0.0)).alias("recall")) for i, b in enumerate(budgets)])
    return found.select(F.explode(rows).alias("r")).select("r.*")


def report(det: DataFrame, gt: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """A summary row per overlap threshold; detections without ground truth in their image count as false."""
    n_gt, out = gt.count(), None
    for t in thresholds:
        row = summary(flagged(det, gt, t), n_gt).withColumn("iou_threshold", F.lit(t))
        out = row if out is None else out.unionByName(row)
    return out


def end_to_end(images: DataFrame, gt: DataFrame, detector: Callable[[DataFrame], DataFrame], thresholds: tuple[float, ...] = (0.3, 0.5), budgets: tuple[int, ...] = (50, 100, 284, 500, 1000), **suppression) -> tuple[DataFrame, DataFrame]:
    """Detector, suppression and evaluation in one call: the report by overlap threshold, and recall by
    threshold and budget of false positives.

    images: image_id and what the detector reads; gt: image_id, id and the box. All images count: those
    without detections by their missed boxes, those without boxes by their false detections."""
    found = detector(images).select("image_id", "score", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    found = found.withColumn("id", F.xxhash64("image_id", "x1", "y1", "x2", "y2"))
    det = kept(nms.suppress(found, **suppression).withColumnRenamed("root", "id"))
    own = gt.join(images.select("image_id").distinct(), "image_id", "left_semi")
    n_gt, at = own.count(), None
    for t in thresholds:
        one = recall_at_fp(flagged(det, own, t), n_gt, budgets).select(F.lit(t).alias("iou_threshold"), "budget", "recall")
        at = one if at is None else at.unionByName(one)
    return report(det, own, thresholds), at
