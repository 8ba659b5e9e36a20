"""Overlap suppression: fused pairs, their components, one box a component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpwright.functions.geometry import fuses, pixel_overlaps


def pairs(boxes: DataFrame, metric: str = "hybrid", threshold: float = 0.3, iom_threshold: float = 0.7, cell: int = 64) -> DataFrame:
    """image_id, a, b (ids, a < b), iou, iom of the boxes of an image that fuse.

    Boxes meet by (image, stripe of the x axis) and a pair counts in the first stripe they share,
    so an image with many boxes isn't compared all against all.
    """
    stripe = lambda x: F.floor(x / cell).cast("int")
    b = boxes.select("image_id", "id", "x1", "y1", "x2", "y2", stripe(F.col("x1")).alias("first"), F.explode(F.sequence(stripe(F.col("x1")), stripe(F.col("x2") + 1))).alias("stripe"))
    l, r = b.alias("l"), b.alias("r")
    met = (
        (F.col("l.image_id") == F.col("r.image_id")) & (F.col("l.stripe") == F.col("r.stripe")) & (F.col("l.id") < F.col("r.id"))
        & (F.col("l.stripe") == F.greatest("l.first", "r.first"))
    )
    side = lambda s: {c: F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2")}
    iou, iom = pixel_overlaps(side("l"), side("r"))
    return l.join(r, met & fuses(iou, iom, metric, threshold, iom_threshold)).select(F.col("l.image_id"), F.col("l.id").alias("a"), F.col("r.id").alias("b"), iou.alias("iou"), iom.alias("iom"))


def _roots(table: pa.Table) -> pa.Table:
    """Union-find over one image's pairs; a detector leaves at most its windows in an image."""
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(inv[: len(a)].tolist(), inv[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = ids[[find(i) for i in range(len(ids))]] if len(ids) else ids
    image = np.full(len(ids), table.column("image_id")[0].as_py() if table.num_rows else 0, np.int64)
    return pa.table({"image_id": image, "id": ids.astype(np.int64), "root": root.astype(np.int64)})


def components(boxes: DataFrame, **overlap) -> DataFrame:
    """boxes with root, the least id of their component."""
    linked = pairs(boxes, **overlap).select("image_id", "a", "b").groupBy("image_id").applyInArrow(_roots, "image_id long, id long, root long")
    return boxes.join(linked, ["image_id", "id"], "left").withColumn("root", F.coalesce("root", "id"))


def suppress(boxes: DataFrame, mode: str = "weighted", digits: int | None = None, **overlap) -> DataFrame:
    """One box per component: the score-weighted mean with truncated corners and the highest score
    ('weighted'; plain mean where scores sum to 0 or less), or the best box ('greedy'; ties: least id).
    digits rounds means before they are truncated, so that the order of summation can't decide a corner."""
    c = components(boxes, **overlap)
    corners = ("x1", "y1", "x2", "y2")
    if mode == "weighted":
        total = F.sum("score")
        rounded = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
        mean = [rounded(F.when(total > 0, F.try_divide(F.sum(F.col("score") * F.col(x)), total)).otherwise(F.avg(x))).cast("int").alias(x) for x in corners]
        return c.groupBy("image_id", "root").agg(*mean, F.max("score").alias("score"), F.count("*").alias("n_boxes"))
    best = F.max(F.struct("score", (-F.col("id")).alias("neg"), *corners)).alias("m")
    g = c.groupBy("image_id", "root").agg(best, F.count("*").alias("n_boxes"))
    return g.select("image_id", "root", *[F.col(f"m.{x}").cast("int").alias(x) for x in corners], "m.score", "n_boxes")
