"""Best decision stump over long feature values, and boosting rounds, as window plans."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Errors are compared after rounding, so that the order of sums can't decide.
DIGITS = 9


def balanced_weights(labels: DataFrame) -> DataFrame:
    """patch_id, y, wt: half of the weight to each class, shared evenly."""
    n = labels.groupBy().agg(F.sum("y").alias("np"), F.sum(1 - F.col("y")).alias("nn"))
    return labels.crossJoin(F.broadcast(n)).select("patch_id", "y", F.when(F.col("y") == 1, 0.5 / F.col("np")).otherwise(0.5 / F.col("nn")).alias("wt"))


def stump_errors(weighted: DataFrame, tie_exact: bool = True) -> DataFrame:
    """feature_id, val, err, polarity: the better error of each threshold.

    weighted: feature_id, patch_id, y, val, wt. Tie-exact errors are those of the stump's own
    predictions (strict comparison, equal values together); otherwise rows are taken in
    (val, patch_id) order and each excludes itself from the sums before it, for both polarities.
    """
    pos, neg = F.col("wt") * F.col("y"), F.col("wt") * (1 - F.col("y"))
    order = ["val"] if tie_exact else ["val", "patch_id"]
    rows = weighted.select("feature_id", *order, pos.alias("wp"), neg.alias("wn"))
    if tie_exact:
        rows = rows.groupBy("feature_id", "val").agg(F.sum("wp").alias("wp"), F.sum("wn").alias("wn"))
    all_ = Window.partitionBy("feature_id")
    upto = all_.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cp, cn = F.sum("wp").over(upto), F.sum("wn").over(upto)
    tp, tn = F.sum("wp").over(all_), F.sum("wn").over(all_)
    s = rows.select("feature_id", *order, "wp", "wn", cp.alias("cp"), cn.alias("cn"), tp.alias("tp"), tn.alias("tn"))
    below = F.col("cn") - F.col("wn") + F.col("tp") - (F.col("cp") - F.col("wp"))
    above = F.col("cp") + F.col("tn") - F.col("cn") if tie_exact else F.col("cp") - F.col("wp") + F.col("tn") - (F.col("cn") - F.col("wn"))
    below, above = F.round(below, DIGITS), F.round(above, DIGITS)
    return s.select("feature_id", *order, F.least(below, above).alias("err"), F.when(below < above, 1).otherwise(-1).alias("polarity"))


def best_per_feature(errors: DataFrame) -> DataFrame:
    """feature_id, err, threshold, polarity: least error, then least threshold."""
    order = [c for c in ("val", "patch_id") if c in errors.columns]
    least = F.min(F.struct("err", *order, "polarity")).alias("m")
    return errors.groupBy("feature_id").agg(least).select("feature_id", "m.err", F.col("m.val").alias("threshold"), "m.polarity")


def best(errors: DataFrame) -> DataFrame:
    """One row, by least (err, feature_id): a partial minimum per task, then one of those."""
    least = best_per_feature(errors).agg(F.min(F.struct("err", "feature_id", "threshold", "polarity")).alias("m"))
    return least.where("m is not null").select("m.feature_id", "m.threshold", "m.polarity", "m.err")


def predicts(val: Column, threshold: Column | float, polarity: Column | int) -> Column:
    """1 where polarity * val < polarity * threshold, strictly."""
    return F.when(polarity * val < polarity * threshold, 1).otherwise(0)


@dataclass(frozen=True)
class Stump:
    feature_id: int
    threshold: float
    polarity: int
    alpha: float
    error: float


def boost(values: DataFrame, rounds: int, tie_exact: bool = True) -> tuple[list[Stump], DataFrame]:
    """AdaBoost over long values (patch_id, y, feature_id, val); stops early at an error of 0.5.

    Returns the stumps and the weights after the last round (patch_id, y, wt). A round is one job
    that returns one row; the weights are an expression over the stumps so far.
    """
    labels = values.select("patch_id", "y").distinct()
    weights, out = balanced_weights(labels), []
    for _ in range(rounds):
        got = best(stump_errors(values.join(weights.select("patch_id", "wt"), "patch_id"), tie_exact)).first()
        if got is None or got.err >= 0.5:
            break
        err = min(max(got.err, 1e-10), 0.5 - 1e-10)
        beta = err / (1 - err)
        out.append(Stump(got.feature_id, got.threshold, got.polarity, math.log(1 / beta), got.err))
        weights = reweighted(weights, values.where(F.col("feature_id") == got.feature_id), got.threshold, got.polarity, beta)
    return out, weights


def reweighted(weights: DataFrame, own: DataFrame, threshold: float, polarity: int, beta: float) -> DataFrame:
    """Weights times beta where the stump is right, scaled to a sum of 1."""
    right = predicts(F.col("val"), threshold, polarity) == F.col("y")
    new = weights.join(own.select("patch_id", "val"), "patch_id").select("patch_id", "y", (F.col("wt") * F.when(right, beta).otherwise(1.0)).alias("wt"))
    return new.crossJoin(F.broadcast(new.groupBy().agg(F.sum("wt").alias("total")))).select("patch_id", "y", (F.col("wt") / F.col("total")).alias("wt"))
