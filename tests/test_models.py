"""Boosting, training, tuning, detection and suppression against plain NumPy versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stumpwright import fixtures as X
from stumpwright.functions import geometry as G
from stumpwright.operators import cascade, detect, evaluation, metrics, mining, nms, stump, tuning
from stumpwright.plans import trainer
from stumpwright.plans.patch_queries import _model
from stumpwright.sources import models


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.booleans()), min_size=2, max_size=12))
def test_tie_exact_error_is_the_error_of_the_predictions(rows):
    v, y = np.array([[float(a) for a, _ in rows]]), np.array([int(b) for _, b in rows])
    w = np.arange(1, len(y) + 1) / sum(range(1, len(y) + 1))
    order = np.argsort(v, axis=1, kind="stable")
    err, thr, pol = trainer.best_of_rows(v, order, w * y, w * (1 - y), True)
    wrong = (pol[0] * v[0] < pol[0] * thr[0]) != (y == 1)
    assert abs(w[wrong].sum() - err[0]) < 1e-8
    least = min(w[((p * v[0] < p * t) != (y == 1))].sum() for t in v[0] for p in (1, -1))
    assert abs(least - err[0]) < 1e-8


def test_long_and_feature_major_search_agree(spark, sf):
    from stumpwright.operators import haar

    p = X.patches(spark, sf)
    long = haar.values(p, haar.bank(spark, 8, 8, 3, 3), 8, normalized=True)
    w = stump.balanced_weights(p.select("patch_id", "y"))
    a = stump.best(stump.stump_errors(long.join(w.select("patch_id", "wt"), "patch_id"))).first()
    for presort in (True, False):
        features, y = trainer.feature_rows(spark, p.select("patch_id", "px", "y"), 8, 8, trainer.Options(least_side=3, precompute_sort=presort))
        b = trainer.best_stump(features, np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()), y)
        assert (a.feature_id, a.polarity) == (b["feature_id"], b["polarity"]) and abs(a.threshold - b["threshold"]) < 1e-9


def test_training_resumes_and_truncates(spark, sf, tmp_path):
    p = X.patches(spark, sf)
    pos, neg = p.where("y = 1"), p.where("y = 0")
    opts = trainer.Options(max_stages=2, max_stumps=2, layer_recall=0.95, target_negatives=60, mining_budget=300, least_side=4, min_cascade_recall=0.5, target_stage_fpr=0.95)
    whole, logs = trainer.train(spark, pos, neg, str(tmp_path / "a"), 8, 8, opts)
    first, _ = trainer.train(spark, pos, neg, str(tmp_path / "b"), 8, 8, trainer.Options(**{**opts.__dict__, "max_stages": 1}))
    assert first.stages == whole.stages[:1] == whole.truncated(1).stages
    again, _ = trainer.train(spark, pos, neg, str(tmp_path / "b"), 8, 8, opts, resume=first)
    assert again.stages == whole.stages == models.load(spark, str(tmp_path / "b")).stages
    for x in logs:  # the floor, the weakest stump's share, may cost recall
        alphas = [s.alpha for s in x.stumps]
        assert x.recall >= 0.95 or abs(x.threshold - min(alphas) / sum(alphas)) < 1e-12
    longer = trainer.extend_last(spark, first, pos, neg, str(tmp_path / "c"), 4, opts)
    assert longer.stages[0].stumps[: len(first.stages[0].stumps)] == first.stages[0].stumps
    with pytest.raises(ValueError):
        whole.truncated(0)


def test_empty_stage_is_refused():
    with pytest.raises(ValueError):
        cascade.Cascade([cascade.Stage(0.5, ())], 8, 8)


def _numpy_nms(boxes, threshold=0.3, iom=0.7):
    parent = list(range(len(boxes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(boxes):
        for j, b in enumerate(boxes[:i]):
            w = max(0, min(a[2], b[2]) - max(a[0], b[0]) + 1)
            h = max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
            pa, pb = ((x[2] - x[0] + 1) * (x[3] - x[1] + 1) for x in (a, b))
            if w * h / (pa + pb - w * h) > threshold or w * h / min(pa, pb) > iom:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(boxes))]


def test_suppression_against_numpy_and_any_order(spark):
    rng = random.Random(3)
    boxes = [(x := rng.randrange(300), y := rng.randrange(80), x + rng.randrange(5, 60), y + rng.randrange(5, 60)) for _ in range(90)]
    rows = [(7, i, float(rng.random()), *map(float, b)) for i, b in enumerate(boxes)]
    schema = "image_id long, id long, score double, x1 double, y1 double, x2 double, y2 double"
    want = dict(enumerate(_numpy_nms(boxes)))
    for cell in (16, 1000):
        shuffled = rows[:]
        rng.shuffle(shuffled)
        got = nms.components(spark.createDataFrame(shuffled, schema), cell=cell).collect()
        assert {r.id: r.root for r in got} == want
    for mode in ("weighted", "greedy"):
        assert nms.suppress(spark.createDataFrame(rows, schema), mode=mode).count() == len(set(want.values()))
    assert nms.suppress(spark.createDataFrame([], schema)).count() == 0


def test_matching_prefers_score_then_overlap_then_the_later_box(spark):
    schema = "image_id long, id long, score double, x1 double, y1 double, x2 double, y2 double"
    det = spark.createDataFrame([(1, 1, 0.5, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.9, 0.0, 0.0, 10.0, 9.0), (2, 3, 0.1, 0.0, 0.0, 5.0, 5.0)], schema)
    gt = spark.createDataFrame([(1, 10, None, 0.0, 0.0, 10.0, 10.0), (1, 11, None, 0.0, 0.0, 10.0, 10.0)], schema)
    got = {r.det_id: r.gt_id for r in evaluation.matched(det, gt, 0.5).collect()}
    assert got == {2: 11, 1: 10}
    s = evaluation.summary(evaluation.flagged(det, gt, 0.5), 2).first()
    assert (s.ap, s.recall, s.n_det, s.tp, s.fp) == (1.0, 1.0, 3, 2, 1)
    none = evaluation.summary(evaluation.flagged(det.limit(0), gt, 0.5), 2).first()
    assert (none.ap, none.recall, none.precision, none.n_det) == (0.0, 0.0, 0.0, 0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=8, max_size=8))
def test_iou_is_symmetric_and_bounded(spark, v):
    a = (min(v[0], v[1]), min(v[2], v[3]), max(v[0], v[1]) + 1, max(v[2], v[3]) + 1)
    b = (min(v[4], v[5]), min(v[6], v[7]), max(v[4], v[5]) + 1, max(v[6], v[7]) + 1)
    t = "struct<x1:double,y1:double,x2:double,y2:double>"
    df = spark.createDataFrame([(tuple(map(float, a)), tuple(map(float, b)))], f"a {t}, b {t}")
    p, q, s = df.select(G.iou(F.col("a"), F.col("b")), G.iou(F.col("b"), F.col("a")), G.iou(F.col("a"), F.col("a"))).first()
    assert p == q and 0 <= p <= 1 and s == 1


def test_mining_is_a_bounded_part_of_the_pool(spark, sf):
    pool = X.patches(spark, sf).where("y = 0")
    ids = {r.patch_id for r in pool.collect()}
    for target, budget in ((5, 50), (1000, 30), (0, 10), (10, 0)):
        got = [r.patch_id for r in mining.mine(pool, _model(spark), target, budget).collect()]
        assert len(got) <= min(target, budget) and set(got) <= ids and len(set(got)) == len(got)


def test_a_higher_threshold_never_raises_recall(spark, sf):
    m = _model(spark)
    s = cascade.stage_scores(X.patches(spark, sf), m)
    rows = tuning.sweep(s, [x.threshold for x in m.stages], 0).orderBy("t").collect()
    assert all(a.recall >= b.recall and a.specificity <= b.specificity for a, b in zip(rows, rows[1:]))
    tuned = tuning.tune(s, [x.threshold for x in m.stages], max_passes=2)
    f1 = lambda model: metrics.confusion(cascade.verdicts(s, model)).first().f1
    assert f1(m.with_thresholds(tuned)) >= f1(m)


def test_detector_on_base_window_equals_patch_verdict(spark, sf):
    m = _model(spark)
    p = X.patches(spark, sf)
    images = p.select(F.col("patch_id").alias("image_id"), "px", F.lit(8).alias("h"), F.lit(8).alias("w"))
    found = {r.image_id: r.score for r in detect.detections(images, m, 8, 8).collect()}
    want = {r.patch_id: r.margin for r in cascade.verdicts(cascade.stage_scores(p, m), m).where("passed").collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
