"""Greedy tuning of stage thresholds on a score matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grid 0.30, 0.32, ... 0.70 and the least gain that counts.
GRID = tuple(round(0.30 + 0.02 * i, 2) for i in range(21))
MIN_GAIN = 1e-6


def objective(name: str, min_spec: float = 0.97) -> Column:
    """'f1', or 'recall-at-spec': 1 + recall where specificity reaches min_spec, else specificity."""
    if name == "f1":
        return F.col("f1")
    if name == "recall-at-spec":
        return F.when(F.col("specificity") >= min_spec, F.col("recall") + 1.0).otherwise(F.col("specificity"))
    raise ValueError(f"unknown objective: {name}")


def sweep(scored: DataFrame, thresholds: Sequence[float], stage: int, grid: Sequence[float] = GRID) -> DataFrame:
    """t, tp, fp, fn, tn, recall, specificity, precision, f1 with each grid value at one stage.

    The other stages decide once per patch; the grid, a few values, meets each patch as an array, so
    there is one scan and one aggregate of the grid's size.
    """
    others = F.lit(True)
    for k, t in enumerate(thresholds):
        if k != stage:
            others = others & (F.element_at("scores", k + 1) >= t)
    p = scored.select("y", others.alias("ok"), F.element_at("scores", stage + 1).alias("s"))
    g = p.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    hit, pos = F.col("ok") & (F.col("s") >= F.col("t")), F.col("y") == 1
    c = g.groupBy("t").agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    one = lambda a, b: a / F.greatest(b, F.lit(1)).cast("double")
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", one(tp, tp + fn).alias("recall"), one(tn, tn + fp).alias("specificity"), one(tp, tp + fp).alias("precision"), one(2 * tp, 2 * tp + fp + fn).alias("f1"))


def tune(scored: DataFrame, thresholds: Sequence[float], name: str = "f1", grid: Sequence[float] = GRID, max_passes: int = 4) -> list[float]:
    """Coordinate descent over the stages' thresholds; a job per coordinate, which returns the grid."""
    out = list(thresholds)
    scored = scored.select("y", "scores").persist()
    goal = objective(name)
    try:
        for _ in range(max_passes):
            changed = False
            for k in range(len(out)):
                rows = {r.t: r.goal for r in sweep(scored, out, k, [out[k], *[t for t in grid if t != out[k]]]).select("t", goal.alias("goal")).collect()}
                best_t, best = out[k], rows[out[k]]
                for t in grid:
                    if rows[t] > best + MIN_GAIN:
                        best_t, best = t, rows[t]
                changed |= best_t != out[k]
                out[k] = best_t
            if not changed:
                break
    finally:
        scored.unpersist()
    return out
