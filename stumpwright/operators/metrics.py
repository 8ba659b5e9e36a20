"""Counts and rates of a binary classifier, calibration, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stumpwright.functions.arithmetic import guarded, half_even
from stumpwright.operators import ranking
from stumpwright.storage import kept


def confusion(verdicts: DataFrame, y: str = "y", passed: str = "passed", undefined: float | None = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one per value of ``by``): tp, tn, fp, fn and the rates; ``undefined`` stands for x/0 (None: NULL)."""
    p, t = F.col(passed), F.col(y) == 1
    c = verdicts.groupBy(*by).agg(
        F.count_if(p & t).alias("tp"), F.count_if(~p & ~t).alias("tn"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn")
    )
    return rates(c, undefined)


def rates(c: DataFrame, undefined: float | None = 0.0) -> DataFrame:
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    return c.select(
        "*",
        guarded(tp + tn, tp + tn + fp + fn, undefined).alias("accuracy"),
        guarded(tp, tp + fp, undefined).alias("precision"),
        guarded(tp, tp + fn, undefined).alias("recall"),
        guarded(tn, tn + fp, undefined).alias("specificity"),
        guarded(2 * tp, 2 * tp + fp + fn, undefined).alias("f1"),
    )


def calibrated_threshold(scores: DataFrame, recall: float, floor: float, cap: float = 0.95) -> DataFrame:
    """The largest threshold that ``recall`` of the scores reach, between floor and cap.

    The k-th largest score comes from a distributed top-k, not from a global window.
    """
    n = scores.count()
    k = max(1, -int(-(recall * n) // 1))
    kth = scores.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("s"))
    return kth.select(F.lit(n).cast("bigint").alias("n"), F.lit(k).cast("bigint").alias("k"), F.least(F.lit(cap), F.greatest(F.lit(floor), F.col("s"))).alias("threshold"))


def operating_point(scores: DataFrame, threshold: float) -> DataFrame:
    """fpr over rows with y = 0 and recall over rows with y = 1, at score >= threshold."""
    hit = F.when(F.col("score") >= threshold, 1.0).otherwise(0.0)
    return scores.agg(F.avg(F.when(F.col("y") == 0, hit)).alias("fpr"), F.avg(F.when(F.col("y") == 1, hit)).alias("recall"))


def operating_points(long: DataFrame, thresholds: Column) -> DataFrame:
    """stage, fpr, recall at the stages' thresholds over long scores: one pass for all stages."""
    t = F.element_at(thresholds, (F.col("stage") + 1).cast("int"))
    hit = F.when(F.col("score") >= t, 1.0).otherwise(0.0)
    return long.groupBy("stage").agg(F.avg(F.when(F.col("y") == 0, hit)).alias("fpr"), F.avg(F.when(F.col("y") == 1, hit)).alias("recall"))


def survival(long: DataFrame, thresholds: Column) -> DataFrame:
    """long scores with alive (all stages so far passed) and margin (sum over passed stages until the first miss)."""
    t = F.element_at(thresholds, (F.col("stage") + 1).cast("int"))
    w = Window.partitionBy("patch_id").orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    alive = F.min(F.when(F.col("score") >= t, 1).otherwise(0)).over(w)
    flagged = long.withColumn("threshold", t).withColumn("alive", alive)
    gain = F.when(F.col("alive") == 1, F.col("score") - F.col("threshold")).otherwise(0.0)
    return flagged.withColumn("running_margin", F.sum(gain).over(w))


def diagnostics(long: DataFrame, thresholds: Column) -> DataFrame:
    """Per stage: mean and outer percentiles by class, cumulative pass rates, negatives newly rejected.

    The scores are read several times and so written first."""
    long = kept(long)
    s = survival(long, thresholds)
    before = F.coalesce(F.lag("alive").over(Window.partitionBy("patch_id").orderBy("stage")), F.lit(1))
    s = s.withColumn("before", before)
    pos, neg = F.col("y") == 1, F.col("y") == 0
    alive = F.col("alive").cast("double")
    out = s.groupBy("stage").agg(
        F.first("threshold").alias("threshold"),
        F.avg(F.when(pos, F.col("score"))).alias("pos_mean"), F.avg(F.when(neg, F.col("score"))).alias("neg_mean"),
        F.avg(F.when(pos, alive)).alias("pass_pos"), F.avg(F.when(neg, alive)).alias("pass_neg"),
        F.sum(F.when(neg, F.col("alive"))).alias("n_now"), F.sum(F.when(neg, F.col("before"))).alias("n_before"),
    )
    out = out.withColumn("rejected_here", 1.0 - F.col("n_now") / F.greatest(F.col("n_before"), F.lit(1))).drop("n_now", "n_before")
    stages = [r.stage for r in long.select("stage").distinct().collect()]
    tails = ranking.quantiles(long.where("y in (0, 1)"), "score", {(k, y): (q,) for k in stages for y, q in ((1, 0.01), (0, 0.99))}, "stage", "y")
    rows = [(k, tails[k, 1][0], tails[k, 0][0]) for k in stages]
    return out.join(F.broadcast(long.sparkSession.createDataFrame(rows, "stage int, pos_p1 double, neg_p99 double")), "stage")


#: The percentile bands of the score report.
BANDS = ((0.0, 0.05), (0.05, 0.10), (0.10, 0.20), (0.20, 0.30), (0.45, 0.55), (0.70, 0.80), (0.90, 0.95), (0.95, 1.00))
QUANTILES = (0.0, 0.05, 0.10, 0.20, 0.50, 0.80, 0.90, 0.95, 1.0)


def quantiles(scores: DataFrame, column: str = "margin") -> DataFrame:
    """q, value: exact linear quantiles."""
    got = ranking.quantiles(scores, column, {(): QUANTILES})[()]
    return scores.sparkSession.createDataFrame(list(zip(QUANTILES, got)), "q double, value double")


def band_samples(ranked: DataFrame, n: int, per_band: int, order: Column) -> DataFrame:
    """band and rows of ``ranked`` (rank from 0 by score) by percentile band, at most per_band in ``order``."""
    bands = ranked.sparkSession.createDataFrame([(i, round(lo * n), round(hi * n)) for i, (lo, hi) in enumerate(BANDS)], "band int, lo long, hi long")
    inside = ranked.join(F.broadcast(bands), (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    rn = F.row_number().over(Window.partitionBy("band").orderBy(order, "patch_id"))
    return inside.withColumn("rn", rn).where(F.col("rn") <= per_band).drop("rn", "lo", "hi")


def without_lowest(scores: DataFrame, fraction: float, score: str = "score", key: str = "patch_id") -> DataFrame:
    """scores without round(fraction * n) lowest rows (ties by key); n and the cut are one small job each."""
    n = scores.count()
    drop = round(fraction * n)
    if not drop:
        return scores
    gone = scores.orderBy(score, key).limit(drop).select(key)
    return scores.join(gone, key, "left_anti")


__all__ = ["BANDS", "QUANTILES", "band_samples", "calibrated_threshold", "confusion", "diagnostics", "half_even", "operating_point", "quantiles", "rates", "survival", "without_lowest"]
