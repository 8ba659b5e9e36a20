"""Queries over patches: integral images, features, stumps, cascade scores, calibration, mining."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright import fixtures as X
from stumpwright.functions.arithmetic import sample_order
from stumpwright.functions.integral import integral_long, integral_wide, region_sum
from stumpwright.operators import cascade, detect, haar, metrics, mining, ranking, stump, tuning
from stumpwright.plans import duck as D
from stumpwright.plans.registry import query
from stumpwright.sources.xml_cascade import parse_cascade

LEAST = 2
RECALL, DROP, PER_BAND = 0.99, 0.35, 5
BUDGET, TARGET = 150, 40


def r6(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


def _model(spark: SparkSession) -> cascade.Cascade:
    return cascade.Cascade.of(X.stages(spark), X.stumps(spark), X.SIDE, X.SIDE)


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, cascade.Cascade]:
    m = _model(spark)
    return cascade.stage_scores(X.patches(spark, sf), m), m


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return cascade.verdicts(*_scored(spark, sf))


def _values(spark: SparkSession, sf: str, normalized: bool = False) -> DataFrame:
    return haar.values(X.patches(spark, sf), haar.bank(spark, X.SIDE, X.SIDE, LEAST, LEAST), X.SIDE, normalized)


def _integral_sql(p: str) -> str:
    return f"""WITH {D.PATCH},
a AS (SELECT patch_id, r, c, sum({p}) OVER (PARTITION BY patch_id, r ORDER BY c) AS s FROM px)
SELECT patch_id, r + 1 AS r, c + 1 AS c, CAST(sum(s) OVER (PARTITION BY patch_id, c ORDER BY r) AS BIGINT) AS v FROM a
UNION ALL SELECT patch_id, 0, CAST(c AS INTEGER), 0 FROM patch, range(0, 9) AS g(c)
UNION ALL SELECT patch_id, CAST(r AS INTEGER), 0, 0 FROM patch, range(1, 9) AS g(r)"""


@query(_integral_sql("p"))
def integral_image(spark: SparkSession, sf: str) -> DataFrame:
    return integral_long(X.patch_pixels(X.patches(spark, sf)))


@query(_integral_sql("p * p"))
def integral_image_sq(spark: SparkSession, sf: str) -> DataFrame:
    return integral_long(X.patch_pixels(X.patches(spark, sf)), power=2)


@query(f"WITH {D.PATCH} SELECT patch_id, round(avg(p), 6) AS mean, round(greatest(stddev_pop(p), 1.0), 6) AS std FROM px GROUP BY patch_id")
def patch_std(spark: SparkSession, sf: str) -> DataFrame:
    g = X.patch_pixels(X.patches(spark, sf)).groupBy("patch_id")
    return g.agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.greatest(F.stddev_pop("p"), F.lit(1.0)), 6).alias("std"))


_RECTS = ((0, 0, 1, 1), (0, 0, 2, 2), (1, 1, 3, 2), (2, 0, 3, 4))


@query(f"""WITH {D.PATCH}, q(i, x, y, w, h) AS (VALUES {D.rows((i, *r) for i, r in enumerate(_RECTS))}), s(scale, ox, oy) AS (VALUES (CAST(1.0 AS DOUBLE), 0, 0), (CAST(1.25 AS DOUBLE), 1, 2))
SELECT patch_id, i AS rect_id, scale, CAST(coalesce(sum(p), 0) AS BIGINT) AS v
FROM patch CROSS JOIN q CROSS JOIN s LEFT JOIN px USING (patch_id)
WHERE c >= ox + trunc(x * scale) AND c < ox + trunc((x + w) * scale) AND r >= oy + trunc(q.y * scale) AND r < oy + trunc((q.y + h) * scale)
GROUP BY patch_id, i, scale""")
def region_sum_scaled(spark: SparkSession, sf: str) -> DataFrame:
    p = X.patches(spark, sf).select("patch_id", integral_wide(F.col("px"), X.SIDE).alias("ii"))
    q = spark.createDataFrame([(i, (x, y, w, h)) for i, (x, y, w, h) in enumerate(_RECTS)], "rect_id int, rect struct<x:int,y:int,w:int,h:int>")
    s = spark.createDataFrame([(1.0, 0, 0), (1.25, 1, 2)], "scale double, ox int, oy int")
    v = region_sum(F.col("ii"), X.SIDE, F.col("rect"), F.col("scale"), F.col("ox"), F.col("oy"))
    return p.crossJoin(F.broadcast(q.crossJoin(s))).select("patch_id", "rect_id", "scale", v.alias("v"))


@query(f"WITH {D.bank(LEAST)} SELECT feature_id, kind, x, y, w, h FROM bank")
def haar_bank(spark: SparkSession, sf: str) -> DataFrame:
    return haar.bank(spark, X.SIDE, X.SIDE, LEAST, LEAST).drop("rects")


@query(f"WITH {D.bank(1)} SELECT feature_id, CAST(rx AS INTEGER) AS x1, CAST(ry AS INTEGER) AS y1, CAST(rx + w AS INTEGER) AS x2, CAST(ry + h AS INTEGER) AS y2, sign FROM frect")
def haar_rects_packed(spark: SparkSession, sf: str) -> DataFrame:
    f = haar.bank(spark, X.SIDE, X.SIDE, 1, 1).select("feature_id", F.explode("rects").alias("r"))
    return f.select("feature_id", F.col("r.x").alias("x1"), F.col("r.y").alias("y1"), (F.col("r.x") + F.col("r.w")).alias("x2"), (F.col("r.y") + F.col("r.h")).alias("y2"), "r.sign")


@query(f"WITH {D.PATCH}, {D.bank(LEAST)}, {D.FVAL} SELECT patch_id, feature_id, val FROM fval")
def haar_values(spark: SparkSession, sf: str) -> DataFrame:
    return _values(spark, sf).drop("y")


@query(f"WITH {D.PATCH}, {D.bank(LEAST)}, {D.FVAL} SELECT patch_id, feature_id, round(val / std, 6) AS val FROM fval JOIN pstd USING (patch_id)")
def haar_values_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _values(spark, sf, normalized=True).select("patch_id", "feature_id", *r6("val"))


_WEIGHTS = "wt0 AS (SELECT patch_id, y, CASE WHEN y = 1 THEN 0.5 / sum(y) OVER () ELSE 0.5 / sum(1 - y) OVER () END AS wt FROM patch)"


def _round_sql(i: int, tie_exact: bool = True) -> str:
    """Errors e{i} and the winner b{i} under weights wt{i}, then weights wt{i+1}."""
    if tie_exact:
        rows = f"SELECT feature_id, val, 0 AS k, sum(wt * f.y) AS wp, sum(wt * (1 - f.y)) AS wn FROM fval AS f JOIN wt{i} AS w USING (patch_id) GROUP BY feature_id, val"
        above = "cp + tn - cn"
    else:
        rows = f"SELECT feature_id, val, patch_id AS k, wt * f.y AS wp, wt * (1 - f.y) AS wn FROM fval AS f JOIN wt{i} AS w USING (patch_id)"
        above = "cp - wp + tn - (cn - wn)"
    return f"""g{i} AS ({rows}),
s{i} AS (SELECT *, sum(wp) OVER o AS cp, sum(wn) OVER o AS cn, sum(wp) OVER (PARTITION BY feature_id) AS tp, sum(wn) OVER (PARTITION BY feature_id) AS tn
  FROM g{i} WINDOW o AS (PARTITION BY feature_id ORDER BY val, k ROWS UNBOUNDED PRECEDING)),
e{i} AS (SELECT feature_id, val, k, round(cn - wn + tp - (cp - wp), 9) AS below, round({above}, 9) AS above FROM s{i}),
f{i} AS (
  SELECT feature_id, val AS threshold, CASE WHEN below < above THEN 1 ELSE -1 END AS polarity, least(below, above) AS err
  FROM e{i} QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY least(below, above), val, k) = 1),
b{i} AS (SELECT {i + 1} AS round, feature_id, threshold, polarity, err, greatest(err, 1e-10) / (1 - greatest(err, 1e-10)) AS beta FROM f{i} ORDER BY err, feature_id LIMIT 1),
u{i} AS (
  SELECT w.patch_id, w.y, w.wt * CASE WHEN (CASE WHEN b.polarity * val < b.polarity * b.threshold THEN 1 ELSE 0 END) = w.y THEN beta ELSE 1 END AS wt
  FROM wt{i} AS w, b{i} AS b JOIN fval AS f ON f.feature_id = b.feature_id WHERE f.patch_id = w.patch_id),
wt{i + 1} AS (SELECT patch_id, y, wt / sum(wt) OVER () AS wt FROM u{i})"""


_VALS = f"WITH {D.PATCH}, {D.bank(LEAST)}, {D.FVAL}, {_WEIGHTS}"


@query(f"{_VALS}, {_round_sql(0)} SELECT feature_id, threshold, polarity, err FROM f0")
def stump_tie_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The best stump of every feature, errors exact under ties."""
    return stump.best_per_feature(stump.stump_errors(_weighted(spark, sf))).select("feature_id", "threshold", "polarity", "err")


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    v = _values(spark, sf)
    w = stump.balanced_weights(X.patches(spark, sf).select("patch_id", "y"))
    return v.join(w.select("patch_id", "wt"), "patch_id")


@query(f"{_VALS}, {_round_sql(0, tie_exact=False)} SELECT feature_id, threshold, polarity, err FROM f0")
def stump_compat(spark: SparkSession, sf: str) -> DataFrame:
    """The best stump of every feature, rows one by one with a fixed tie-break."""
    return stump.best_per_feature(stump.stump_errors(_weighted(spark, sf), tie_exact=False)).select("feature_id", "threshold", "polarity", "err")


@query(f"WITH {D.PATCH}, {_WEIGHTS} SELECT round(sum(wt * y), 9) AS pos, round(sum(wt * (1 - y)), 9) AS neg, count(*) AS n FROM wt0")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = stump.balanced_weights(X.patches(spark, sf).select("patch_id", "y"))
    return w.agg(F.round(F.sum(F.col("wt") * F.col("y")), 9).alias("pos"), F.round(F.sum(F.col("wt") * (1 - F.col("y"))), 9).alias("neg"), F.count("*").alias("n"))


@query(f"{_VALS}, {_round_sql(0)} SELECT patch_id, y, round(wt, 9) AS wt FROM wt1")
def boost_round_1(spark: SparkSession, sf: str) -> DataFrame:
    """Weights after one round."""
    _, weights = stump.boost(_values(spark, sf).persist(), 1)
    return weights.select("patch_id", "y", F.round("wt", 9).alias("wt"))


@query(f"{_VALS}, {_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)}\n" + " UNION ALL ".join(f"SELECT round, feature_id, CAST(threshold AS DOUBLE) AS threshold, polarity, round(ln(1 / beta), 6) AS alpha, round(err, 6) AS err FROM b{i}" for i in range(3)))
def boost_round_3(spark: SparkSession, sf: str) -> DataFrame:
    """The stumps of three rounds."""
    values = _values(spark, sf).persist()
    found, _ = stump.boost(values, 3)
    values.unpersist()
    rows = [(i + 1, s.feature_id, float(s.threshold), s.polarity, s.alpha, s.error) for i, s in enumerate(found)]
    return spark.createDataFrame(rows, "round int, feature_id int, threshold double, polarity int, alpha double, err double").select("round", "feature_id", "threshold", "polarity", *r6("alpha", "err"))


@query(f"WITH {D.SCORES} SELECT patch_id, y, CAST(stage AS INTEGER) AS stage, round(score, 6) AS score FROM sc")
def stage_scores(spark: SparkSession, sf: str) -> DataFrame:
    return cascade.long_scores(_scored(spark, sf)[0]).select("patch_id", "y", "stage", *r6("score"))


@query(f"WITH {D.SCORES} SELECT patch_id, y FROM ver WHERE passed")
def cascade_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Early exit: one filter a stage."""
    return cascade.accepted(X.patches(spark, sf), _model(spark)).select("patch_id", "y")


@query(f"WITH {D.SCORES} SELECT patch_id, y, round(margin, 6) AS margin, passed FROM ver")
def cascade_margin(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf).select("patch_id", "y", *r6("margin"), "passed")


_RATES = """round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""
_COUNTS = "CAST(count(*) FILTER (passed AND y = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT passed AND y = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (passed AND y = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT passed AND y = 1) AS BIGINT) AS fn"


@query(f"WITH {D.SCORES}, c AS (SELECT {_COUNTS} FROM ver) SELECT tp, tn, fp, fn, {_RATES} FROM c")
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_verdicts(spark, sf)).select("tp", "tn", "fp", "fn", *r6("accuracy", "precision", "recall", "specificity", "f1"))


@query(f"WITH {D.SCORES}, c AS (SELECT source, {_COUNTS} FROM (SELECT *, false AS passed FROM ver_) GROUP BY source) SELECT source, tp, tn, fp, fn, {_RATES} FROM c".replace("ver_", "(SELECT patch_id, y, source FROM ver)"))
def confusion_guarded(spark: SparkSession, sf: str) -> DataFrame:
    """A detector that accepts nothing: rates over zero are 0."""
    rejected = _verdicts(spark, sf).withColumn("passed", F.lit(False))
    return metrics.confusion(rejected, by=("source",)).select("source", "tp", "tn", "fp", "fn", *r6("accuracy", "precision", "recall", "specificity", "f1"))


_FLOOR = min(s[10] for s in X.STUMPS if s[0] == 0) / sum(s[10] for s in X.STUMPS if s[0] == 0)


@query(f"""WITH {D.SCORES}, v AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS n FROM sc WHERE stage = 0 AND y = 1 AND split = 'val')
SELECT n, CAST(greatest(1, ceil({RECALL} * n)) AS BIGINT) AS k, round(least(0.95, greatest({_FLOOR!r}, score)), 6) AS threshold FROM v WHERE rn = greatest(1, ceil({RECALL} * n))""")
def calibrated_threshold(spark: SparkSession, sf: str) -> DataFrame:
    s, _ = _scored(spark, sf)
    val = s.where("split = 'val' and y = 1").select(F.element_at("scores", 1).alias("score"))
    return metrics.calibrated_threshold(val, RECALL, _FLOOR).select("n", "k", *r6("threshold"))


@query(f"""WITH {D.SCORES} SELECT CAST(stage AS INTEGER) AS stage, round(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) FILTER (y = 0), 6) AS fpr,
  round(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) FILTER (y = 1), 6) AS recall FROM sc GROUP BY stage""")
def operating_point(spark: SparkSession, sf: str) -> DataFrame:
    s, m = _scored(spark, sf)
    out = metrics.operating_points(cascade.long_scores(s), cascade.thresholds(m))
    return out.select("stage", *r6("fpr", "recall"))


@query(f"WITH {D.SCORES} SELECT split, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n FROM ver WHERE y = 1 GROUP BY split")
def cumulative_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf).where("y = 1").groupBy("split").agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("recall"), F.count("*").alias("n"))


_SURVIVAL = """al AS (SELECT *, min(CASE WHEN score >= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY patch_id ORDER BY stage) AS alive FROM sc),
bf AS (SELECT *, coalesce(lag(alive) OVER (PARTITION BY patch_id ORDER BY stage), 1) AS before FROM al)"""


@query(f"""WITH {D.SCORES}, {_SURVIVAL} SELECT CAST(stage AS INTEGER) AS stage, any_value(threshold) AS threshold,
  round(avg(score) FILTER (y = 1), 6) AS pos_mean, round(quantile_cont(score, 0.01) FILTER (y = 1), 6) AS pos_p1,
  round(avg(score) FILTER (y = 0), 6) AS neg_mean, round(quantile_cont(score, 0.99) FILTER (y = 0), 6) AS neg_p99,
  round(avg(alive) FILTER (y = 1), 6) AS pass_pos, round(avg(alive) FILTER (y = 0), 6) AS pass_neg,
  round(1 - sum(alive) FILTER (y = 0) / greatest(sum(before) FILTER (y = 0), 1), 6) AS rejected_here FROM bf GROUP BY stage""")
def stage_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    s, m = _scored(spark, sf)
    out = metrics.diagnostics(cascade.long_scores(s), cascade.thresholds(m))
    return out.select("stage", "threshold", *r6("pos_mean", "pos_p1", "neg_mean", "neg_p99", "pass_pos", "pass_neg", "rejected_here"))


@query(f"""WITH {D.SCORES}, {_SURVIVAL} SELECT patch_id, CAST(stage AS INTEGER) AS stage, CAST(alive AS INTEGER) AS alive,
  round(sum(CASE WHEN alive = 1 THEN score - threshold ELSE 0 END) OVER (PARTITION BY patch_id ORDER BY stage), 6) AS running_margin FROM bf""")
def stage_survival(spark: SparkSession, sf: str) -> DataFrame:
    s, m = _scored(spark, sf)
    return metrics.survival(cascade.long_scores(s), cascade.thresholds(m)).select("patch_id", "stage", "alive", *r6("running_margin"))


@query(f"WITH {D.SCORES} SELECT CAST(q AS DOUBLE) AS q, round(v, 6) AS value FROM (SELECT unnest({list(metrics.QUANTILES)!r}) AS q, unnest(quantile_cont(margin, {list(metrics.QUANTILES)!r})) AS v FROM ver WHERE y = 1)")
def score_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.quantiles(_verdicts(spark, sf).where("y = 1")).select(F.col("q").cast("double").alias("q"), *r6("value"))


@query(f"""WITH {D.SCORES}, rk AS (SELECT patch_id, row_number() OVER (ORDER BY round(margin, 9), patch_id) - 1 AS rank, count(*) OVER () AS n FROM ver WHERE y = 1),
b(band, lo, hi) AS (VALUES {D.rows((i, *b) for i, b in enumerate(metrics.BANDS))})
SELECT band, patch_id, rank FROM rk JOIN b ON rank >= round_even(lo * n, 0) AND rank < round_even(hi * n, 0)
QUALIFY row_number() OVER (PARTITION BY band ORDER BY {D.order("patch_id", 3)}, patch_id) <= {PER_BAND}""")
def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    v = _verdicts(spark, sf).where("y = 1").select("patch_id", F.round("margin", 9).alias("margin"))
    order = (F.col("margin"), F.col("patch_id"))
    ranked = ranking.ranked(ranking.dealt(v, *order), *order).withColumn("rank", (F.col("rk") - 1).cast("bigint"))
    return metrics.band_samples(ranked, v.count(), PER_BAND, sample_order(F.col("patch_id"), 3)).select("band", "patch_id", "rank")


def _sweep_sql(columns: str) -> str:
    return f"""WITH {D.SCORES}, o AS (SELECT patch_id, any_value(y) AS y, bool_and(score >= threshold OR stage = 1) AS ok, max(score) FILTER (stage = 1) AS s FROM sc GROUP BY patch_id),
gr AS (SELECT round(0.30 + 0.02 * i, 2) AS t FROM range(0, 21) AS g(i)),
c AS (SELECT CAST(t AS DOUBLE) AS t, count(*) FILTER (ok AND s >= t AND y = 1) AS tp, count(*) FILTER (ok AND s >= t AND y = 0) AS fp,
  count(*) FILTER (NOT (ok AND s >= t) AND y = 1) AS fn, count(*) FILTER (NOT (ok AND s >= t) AND y = 0) AS tn FROM o, gr GROUP BY t),
m AS (SELECT *, tp / greatest(tp + fn, 1) AS recall, tn / greatest(tn + fp, 1) AS specificity, tp / greatest(tp + fp, 1) AS precision, 2 * tp / greatest(2 * tp + fp + fn, 1) AS f1 FROM c)
SELECT {columns} FROM m"""


@query(_sweep_sql("t, tp, fp, fn, tn, " + D.rounded("recall", "specificity", "precision", "f1")))
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """One coordinate of the tuner: stage 1 over the grid."""
    s, m = _scored(spark, sf)
    return tuning.sweep(s, [x.threshold for x in m.stages], 1).select("t", "tp", "fp", "fn", "tn", *r6("recall", "specificity", "precision", "f1"))


@query(_sweep_sql("t, round(CASE WHEN specificity >= 0.3 THEN 1 + recall ELSE specificity END, 6) AS goal"))
def threshold_sweep_recall_at_spec(spark: SparkSession, sf: str) -> DataFrame:
    s, m = _scored(spark, sf)
    out = tuning.sweep(s, [x.threshold for x in m.stages], 1)
    return out.select("t", F.round(tuning.objective("recall-at-spec", 0.3), 6).alias("goal"))


def _tuning_sql(passes: int = 4) -> str:
    """The whole descent: a step a coordinate and pass, each from the thresholds of the step before."""
    n = len(X.STAGES)
    stage = [f"max(score) FILTER (stage = {k}) AS s{k}" for k in range(n)]
    out = [f"WITH {D.SCORES}, sm AS MATERIALIZED (SELECT patch_id, any_value(y) AS y, any_value(split) AS split, {', '.join(stage)} FROM sc GROUP BY patch_id)"]
    out.append(f"h0 AS (SELECT {', '.join(f'CAST({t!r} AS DOUBLE) AS t{k}' for k, t in X.STAGES)})")
    for step in range(passes * n):
        k, ts = step % n, ", ".join(f"t{j}" for j in range(n))
        passed = " AND ".join(f"s{j} >= {'t' if j == k else f't{j}'}" for j in range(n))
        grid = f"SELECT CAST(round(0.30 + 0.02 * i, 2) AS DOUBLE) AS t, {ts} FROM range(0, 21) AS g(i), h{step} UNION SELECT t{k}, {ts} FROM h{step}"
        f1 = f"2 * count(*) FILTER (ok AND y = 1) / greatest(2 * count(*) FILTER (ok AND y = 1) + count(*) FILTER (ok AND y = 0) + count(*) FILTER (NOT ok AND y = 1), 1)"
        out.append(f"g{step} AS MATERIALIZED (SELECT t, {ts}, {f1} AS f1 FROM (SELECT y, t, {ts}, {passed} AS ok FROM sm, ({grid}) WHERE split = 'val') GROUP BY ALL)")
        now = f"(SELECT f1 FROM g{step} WHERE t = t{k})"
        best = f"(SELECT CASE WHEN max(f1) > {now} + 1e-6 THEN min(t) FILTER (f1 = (SELECT max(f1) FROM g{step})) ELSE any_value(t{k}) END FROM g{step})"
        out.append(f"h{step + 1} AS MATERIALIZED (SELECT {', '.join(best + f' AS t{k}' if j == k else f't{j}' for j in range(n))} FROM h{step})")
    last, passed = f"h{passes * n}", " AND ".join(f"s{j} >= t{j}" for j in range(n))
    out.append(f"c AS (SELECT {_COUNTS} FROM (SELECT y, {passed} AS passed FROM sm, {last} WHERE split = 'test'))")
    rates = re.sub(r"round\((.*?), 6\) AS", r"\1 AS", _RATES)
    return ",\n".join(out) + f"\nSELECT tp, tn, fp, fn, {rates}, [{', '.join(f't{j}' for j in range(n))}] AS thresholds FROM c, {last}"


@query(_tuning_sql())
def threshold_tuning(spark: SparkSession, sf: str) -> DataFrame:
    """The tuned thresholds, found on the validation split and applied to the test split."""
    s, m = _scored(spark, sf)
    tuned = tuning.tune(s.where("split = 'val'"), [x.threshold for x in m.stages])
    test = cascade.verdicts(s.where("split = 'test'"), m.with_thresholds(tuned))
    return metrics.confusion(test).withColumn("thresholds", F.array(*[F.lit(t) for t in tuned]))


@query(f"""WITH {D.SCORES}, p AS (SELECT patch_id, margin, row_number() OVER (ORDER BY round(margin, 9), patch_id) AS rn, count(*) OVER () AS n FROM ver WHERE y = 1)
SELECT patch_id, round(margin, 6) AS margin FROM p WHERE rn > round_even({DROP} * n, 0)""")
def drop_low_score(spark: SparkSession, sf: str) -> DataFrame:
    v = _verdicts(spark, sf).where("y = 1").select("patch_id", F.round("margin", 9).alias("margin"))
    return metrics.without_lowest(v, DROP, "margin").select("patch_id", *r6("margin"))


def _mine_sql(where: str, budget: str, target: str, seed: int) -> str:
    o = D.order("patch_id", seed)
    return f"""SELECT patch_id FROM (
  SELECT patch_id, row_number() OVER (ORDER BY o, patch_id) AS k FROM (
    SELECT patch_id, {o} AS o, passed, row_number() OVER (ORDER BY {o}, patch_id) AS rn FROM ver WHERE {where}) WHERE rn <= {budget} AND passed)
  WHERE k <= {target}"""


@query(f"WITH {D.SCORES} {_mine_sql('y = 0', str(BUDGET), str(TARGET), 7)}")
def mine_budgeted(spark: SparkSession, sf: str) -> DataFrame:
    return mining.mine(X.patches(spark, sf).where("y = 0"), _model(spark), TARGET, BUDGET, 7).select("patch_id")


_SEED_N = "(SELECT count(*) FROM ver WHERE y = 0 AND source = 'src0')"


@query(f"""WITH {D.SCORES},
a AS ({_mine_sql("y = 0 AND source = 'src0'", f"least(60, {_SEED_N})", "45", 7)}),
b AS ({_mine_sql("y = 0 AND source = 'src1'", f"120 - least(60, 2 * {_SEED_N})", "90 - (SELECT count(*) FROM a)", 7)}),
c AS ({_mine_sql("y = 0 AND source = 'src2'", "1000000000", "90 - (SELECT count(*) FROM a) - (SELECT count(*) FROM b)", 7)})
SELECT patch_id, 'seed' AS pool FROM a UNION ALL SELECT patch_id, 'main' FROM b UNION ALL SELECT patch_id, 'reserve' FROM c""")
def mine_stratified(spark: SparkSession, sf: str) -> DataFrame:
    neg = X.patches(spark, sf).where("y = 0")
    of = lambda s: neg.where(F.col("source") == s)
    return mining.mine_stratified(of("src1"), _model(spark), 90, 120, of("src0"), of("src2"), 7).select("patch_id", "pool")


@query(f"WITH {D.SCORES} SELECT patch_id FROM ver WHERE passed AND y = 0")
def mine_full_pool(spark: SparkSession, sf: str) -> DataFrame:
    return mining.mine_all(X.patches(spark, sf).where("y = 0"), _model(spark)).select("patch_id")


@query(f"WITH {D.SCORES} SELECT patch_id, y, bool_and(score >= threshold) AS passed FROM sc WHERE stage < 2 GROUP BY patch_id, y")
def truncate_model(spark: SparkSession, sf: str) -> DataFrame:
    m = _model(spark).truncated(2)
    return cascade.verdicts(cascade.stage_scores(X.patches(spark, sf), m), m).select("patch_id", "y", "passed")


@query(f"WITH {D.MODEL} SELECT CAST(stage AS INTEGER) AS stage, any_value(g.threshold) AS threshold, count(*) AS n_stumps, round(sum(alpha), 6) AS sum_alpha FROM stump JOIN stg AS g USING (stage) GROUP BY stage")
def stage_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = X.stumps(spark).groupBy("stage").agg(F.count("*").alias("n_stumps"), F.round(F.sum("alpha"), 6).alias("sum_alpha"))
    return X.stages(spark).join(n, "stage").select("stage", "threshold", "n_stumps", "sum_alpha")


@query(f"WITH {D.bank(LEAST)}, {D.MODEL} SELECT CAST(s.stage AS INTEGER) AS stage, CAST(s.t AS INTEGER) AS t, min(b.feature_id) AS feature_id FROM stump AS s JOIN bank AS b ON s.kind = b.kind AND s.x = b.x AND s.y = b.y AND s.w = b.w AND s.h = b.h GROUP BY s.stage, s.t")
def stump_feature_match(spark: SparkSession, sf: str) -> DataFrame:
    """Saved stumps found again in a bank by their geometry."""
    b = haar.bank(spark, X.SIDE, X.SIDE, LEAST, LEAST).select("kind", "x", "y", "w", "h", F.col("feature_id").alias("found"))
    j = X.stumps(spark).join(b, ["kind", "x", "y", "w", "h"], "left")
    return j.groupBy("stage", "t").agg(F.coalesce(F.min("found"), F.raise_error(F.lit("stump without a feature")).cast("int")).alias("feature_id"))


#: A two-stage model of the other format for an 8 x 8 window.
XML = """<cascade><width>8</width><height>8</height>
<stages>
 <_><stageThreshold>-0.4</stageThreshold><weakClassifiers>
  <_><internalNodes>0 -1 0 -0.01</internalNodes><leafValues>0.6 -0.5</leafValues></_>
  <_><internalNodes>0 -1 1 0.02</internalNodes><leafValues>-0.4 0.3</leafValues></_></weakClassifiers></_>
 <_><stageThreshold>-0.2</stageThreshold><weakClassifiers>
  <_><internalNodes>0 -1 2 0.0</internalNodes><leafValues>0.5 -0.3</leafValues></_>
  <_><internalNodes>0 -1 0 0.015</internalNodes><leafValues>-0.1 0.2</leafValues></_></weakClassifiers></_>
</stages>
<features>
 <_><rects><_>0 0 8 8 -1.</_><_>2 0 4 8 2.</_></rects></_>
 <_><rects><_>0 0 8 4 -1.</_><_>0 2 8 2 2.</_></rects></_>
 <_><rects><_>1 1 6 6 -1.</_><_>3 3 2 2 9.</_></rects></_>
</features></cascade>"""


_LEAF = f"""nf AS (SELECT patch_id, greatest(sqrt(greatest(64.0 * sum(p * p) - CAST(sum(p) AS DOUBLE) * sum(p), 0)), 1.0) AS nf FROM px GROUP BY patch_id),
lrc(f, x, y, w, h, k) AS (VALUES (0, 0, 0, 8, 8, -1), (0, 2, 0, 4, 8, 2), (1, 0, 0, 8, 4, -1), (1, 0, 2, 8, 2, 2), (2, 1, 1, 6, 6, -1), (2, 3, 3, 2, 2, 9)),
ls(stage, f, thr, l, r) AS (VALUES (0, 0, -0.01, 0.6, -0.5), (0, 1, 0.02, -0.4, 0.3), (1, 2, 0.0, 0.5, -0.3), (1, 0, 0.015, -0.1, 0.2)),
lv AS (SELECT patch_id, f, sum(k * p) AS v FROM px JOIN lrc AS rc ON px.c >= x AND px.c < x + w AND px.r >= rc.y AND px.r < rc.y + h GROUP BY patch_id, f),
lsum AS (SELECT patch_id, stage, sum(CASE WHEN v < thr * nf THEN l ELSE ls.r END) AS s FROM ls JOIN lv USING (f) JOIN nf USING (patch_id) GROUP BY patch_id, stage),
lt AS (SELECT patch_id, max(CAST(s AS DOUBLE)) FILTER (stage = 0) + 0.4 AS a, max(CAST(s AS DOUBLE)) FILTER (stage = 1) + 0.2 AS b FROM lsum GROUP BY patch_id),
xv AS (SELECT patch_id, round(a, 9) >= 0 AND round(b, 9) >= 0 AS passed, round(CASE WHEN round(a, 9) < 0 THEN 0 WHEN round(b, 9) < 0 THEN a ELSE a + b END, 6) AS score FROM lt)"""


@query(f"WITH {D.PATCH}, {_LEAF} SELECT patch_id, passed, score FROM xv")
def xml_cascade_scores(spark: SparkSession, sf: str) -> DataFrame:
    return detect.leaf_verdicts(X.patches(spark, sf), parse_cascade(XML)).select("patch_id", "passed", *r6("score"))


@query(f"""WITH {D.SCORES}, w AS (SELECT patch_id, bool_and(score >= threshold) AS pb FROM sc WHERE stage < 2 AND patch_id % 7 <> 0 GROUP BY patch_id)
SELECT count(*) AS n, count(*) FILTER (coalesce(passed = pb, false)) AS agree, round(avg(CASE WHEN coalesce(passed = pb, false) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM ver FULL JOIN w USING (patch_id)""")
def parity_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of the model with its first two stages, where both give a verdict."""
    m = _model(spark).truncated(2)
    other = cascade.verdicts(cascade.stage_scores(X.patches(spark, sf).where("patch_id % 7 <> 0"), m), m)
    return detect.parity(_verdicts(spark, sf), other).select("n", "agree", F.round("rate", 6).alias("rate"))


def _rates_of(name: str, verdicts: str) -> str:
    return f"SELECT '{name}' AS detector, tp, tn, fp, fn, {_RATES} FROM (SELECT {_COUNTS} FROM {verdicts})"


@query(f"""WITH {D.SCORES}, {_LEAF}, {", ".join(f"t{k} AS (SELECT patch_id, y, bool_and(score >= threshold) AS passed FROM sc WHERE stage < {k} GROUP BY patch_id, y)" for k in (1, 2, 3))},
x AS (SELECT patch_id, y, passed FROM xv JOIN patch USING (patch_id))
{" UNION ALL ".join([_rates_of(f"stages_{k}", f"t{k}") for k in (1, 2, 3)] + [_rates_of("xml", "x")])}""")
def detector_table(spark: SparkSession, sf: str) -> DataFrame:
    """One row of counts and rates per detector: the cascade at every depth, and the XML model."""
    p, m = X.patches(spark, sf), _model(spark)
    found = {"xml": detect.leaf_verdicts(p, parse_cascade(XML))}
    for k in (1, 2, 3):
        short = m.truncated(k)
        found[f"stages_{k}"] = cascade.verdicts(cascade.stage_scores(p, short), short)
    out = None
    for name, v in found.items():
        one = metrics.confusion(v).select(F.lit(name).alias("detector"), "tp", "tn", "fp", "fn", *r6("accuracy", "precision", "recall", "specificity", "f1"))
        out = one if out is None else out.unionByName(one)
    return out
