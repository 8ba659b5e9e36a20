"""Training of a cascade: boosting rounds over feature-major rows, calibration, mining, stop rules.

Feature values are laid out once per stage as one row per feature (an array over the samples), so a
round moves no data: the weights, a number per sample, go out with the task, each task searches its
features, and one row comes back. Every finished stage is written, so training can resume.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright.functions.integral import integral_arrow, sample_std
from stumpwright.operators import dataset, haar
from stumpwright.operators.cascade import Cascade, Stage, StumpRow
from stumpwright.operators.mining import mine_stratified
from stumpwright.sources import models
from stumpwright.storage import shared_dir

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Options:
    """Knobs of training; defaults are those of the command line this mirrors."""

    layer_recall: float = 0.99
    target_stage_fpr: float = 0.5
    max_stages: int = 30
    max_stumps: int = 500
    min_stumps: int = 1
    min_cascade_recall: float = 0.80
    min_stage_negatives: int = 0
    target_negatives: int = 3000
    mining_budget: int = 100_000
    seed: int = 42
    least_side: int = 4
    tie_exact: bool = True
    precompute_sort: bool = True


@dataclass
class StageLog:
    stage: int
    stumps: list[StumpRow] = field(default_factory=list)
    threshold: float = 0.0
    fpr: float = 1.0
    recall: float = 0.0
    capped: bool = False
    cumulative: float = 0.0  # recall of the cascade up to the stage, on the validation samples


def best_of_rows(values: np.ndarray, order: np.ndarray, pos: np.ndarray, neg: np.ndarray, tie_exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per feature row: least error, threshold, polarity. order sorts each row by (value, sample)."""
    return best_of_sorted(np.take_along_axis(values, order, 1), order, pos, neg, tie_exact)


def best_of_sorted(v: np.ndarray, order: np.ndarray, pos: np.ndarray, neg: np.ndarray, tie_exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``best_of_rows``, of rows that are sorted already; order says by which samples.

    The first of equal errors, at nine digits, counts; tie_exact lets only the ends of a run of equal values
    split it."""
    signed = (pos - neg).take(order)
    run = signed.cumsum(1)
    before = run - signed
    below, above = pos.sum() - before, neg.sum() + (run if tie_exact else before)
    if tie_exact:
        same = v[:, 1:] == v[:, :-1]
        np.copyto(below[:, 1:], np.inf, where=same)  # a sample that isn't the first of its run
        np.copyto(above[:, :-1], np.inf, where=same)  # or not the last
    (eb, b), (ea, a) = _first_least(below), _first_least(above)
    r = np.arange(len(v))
    at = np.where((ea < eb) | ((ea == eb) & (a < b)), a, b)
    polarity = np.where((eb < ea) | ((eb == ea) & (b <= a) & ((v[r, a] != v[r, b]) if tie_exact else (a != b))), 1, -1)
    return np.minimum(eb, ea), v[r, at], polarity


def _first_least(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's least value at nine digits, and where it is first."""
    least = x.min(1)
    r, k = np.nonzero(x <= (least + 2e-9)[:, None])
    out = least.round(9)
    own = x[r, k].round(9) == out[r]
    r, k = r[own], k[own]
    _, first = np.unique(r, return_index=True)
    return out, k[first]


#: Bytes of a stage's samples, as integral images, that the driver takes and broadcasts at most.
SAMPLE_BYTES = 1 << 30


def _small(n: int, width: int, height: int) -> int:
    """n, where so many samples of a window pass through the driver; more are refused."""
    if n * (width + 1) * (height + 1) * 8 > SAMPLE_BYTES:
        raise ValueError(f"{n} samples of {width} x {height} are over {SAMPLE_BYTES} bytes: sample the positives, or ask for fewer negatives")
    return n


#: Values of feature rows that are worked on at once: what stays in a core's cache in a round, what makes a batch in writing.
_BLOCK, _VALUES = 1 << 17, 1 << 22


def _by_sample(vals: bytes, order: bytes) -> np.ndarray:
    """A feature row's values in the order of the samples."""
    v, o = np.frombuffer(vals, "<f8"), np.frombuffer(order, "<i4")
    if not len(o):
        return v
    out = np.empty_like(v)
    out[o] = v
    return out


_FEATURE_ROW = "feature_id int, kind string, x int, y int, w int, h int, vals binary, ord binary"


def feature_rows(spark: SparkSession, samples: DataFrame, width: int, height: int, opts: Options) -> tuple[DataFrame, np.ndarray]:
    """Feature-major rows of normalised values in the shared folder, each sorted and with its sort order (or as
    the samples come and without an order, where it isn't precomputed); and the labels.

    Samples of one stage (thousands of small patches, SAMPLE_BYTES at most or an error) go to every task;
    features are dealt out.
    """
    _small(samples.count(), width, height)
    rows = samples.select("patch_id", "y", integral_arrow(F.col("px"), F.lit(width)).alias("ii"), sample_std(F.col("px")).alias("std")).orderBy("patch_id").collect()
    ii = np.array([r.ii for r in rows], np.int64).reshape(len(rows), -1)
    std, y = np.array([r["std"] for r in rows]), np.array([r.y for r in rows])
    sent = spark.sparkContext.broadcast((np.ascontiguousarray(ii.T), std))
    bank = haar.bank(spark, width, height, opts.least_side, opts.least_side)
    reads = bank.select("feature_id", "kind", "x", "y", "w", "h", haar.corner_reads(F.col("rects"), width).alias("reads"))
    precompute = opts.precompute_sort

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ii, std = sent.value
        step = max(1, _VALUES // max(1, len(std)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch, vals, orders = whole.slice(at, step), [], []
                for own in batch.column("reads").to_pylist():
                    v = np.zeros(len(std), np.int64)
                    for r in own:
                        v += r["k"] * ii[r["i"] - 1]
                    v = v / std
                    order = np.argsort(v, kind="stable") if precompute else None
                    vals.append((v if order is None else v[order]).astype("<f8").tobytes())
                    orders.append(b"" if order is None else order.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("feature_id", "kind", "x", "y", "w", "h")), pa.array(vals, pa.binary()), pa.array(orders, pa.binary())], ["feature_id", "kind", "x", "y", "w", "h", "vals", "ord"])

    path = shared_dir(spark)
    n = max(spark.sparkContext.defaultParallelism, 1)
    reads.repartition(n).mapInArrow(run, _FEATURE_ROW).write.parquet(path)
    return spark.read.schema(_FEATURE_ROW).parquet(path).persist(), y


def sort_orders(features: DataFrame) -> DataFrame:
    """feature_id, ord: the samples of each feature row (their numbers by patch_id) in the order of value, then number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = [np.frombuffer(o, "<i4") for o in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(orders, pa.list_(pa.int32()))], ["feature_id", "ord"])

    return features.select("feature_id", "ord").mapInArrow(run, "feature_id int, ord array<int>")


def best_stump(features: DataFrame, weights: np.ndarray, y: np.ndarray, tie_exact: bool = True) -> dict | None:
    """The feature row's stump of least (error, feature_id): a row a task, then one."""
    pos, neg = weights * y, weights * (1 - y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        step = max(1, _BLOCK // max(1, len(y)))
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                v = np.frombuffer(b"".join(batch.column("vals").to_pylist()), "<f8").reshape(batch.num_rows, -1)
                raw = b"".join(batch.column("ord").to_pylist())
                if raw:
                    err, thr, pol = best_of_sorted(v, np.frombuffer(raw, "<i4").reshape(v.shape), pos, neg, tie_exact)
                else:
                    err, thr, pol = best_of_rows(v, np.argsort(v, axis=1, kind="stable"), pos, neg, tie_exact)
                ids = batch.column("feature_id").to_numpy()
                k = int(np.lexsort((ids, err))[0])
                if best is None or (err[k], ids[k]) < (best["err"], best["feature_id"]):
                    best = {c: batch.column(c)[k].as_py() for c in ("feature_id", "kind", "x", "y", "w", "h", "vals", "ord")} | {"err": float(err[k]), "threshold": float(thr[k]), "polarity": int(pol[k])}
        if best:
            yield pa.RecordBatch.from_pylist([best], schema=_BEST)

    got = features.mapInArrow(run, "feature_id int, kind string, x int, y int, w int, h int, err double, threshold double, polarity int, vals binary, ord binary")
    row = got.orderBy("err", "feature_id").first()
    return row.asDict() if row else None


_BEST = pa.schema([("feature_id", pa.int32()), ("kind", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("err", pa.float64()), ("threshold", pa.float64()), ("polarity", pa.int32()), ("vals", pa.binary()), ("ord", pa.binary())])


def calibrated(scores: np.ndarray, alphas: list[float], recall: float) -> float:
    """The k-th largest score for the recall, at least the weakest stump's share, at most 0.95."""
    k = max(1, math.ceil(recall * len(scores)))
    return float(min(0.95, max(min(alphas) / sum(alphas), np.sort(scores)[::-1][k - 1])))


def boost_stage(features: DataFrame, y: np.ndarray, opts: Options, replay: tuple[StumpRow, ...] = (), val_votes=None) -> tuple[list[StumpRow], float, float, float]:
    """Rounds until the false-positive rate at the calibrated threshold reaches the target at enough
    stumps and recall. ``replay`` stumps come first, with their own weights. Returns the stumps,
    threshold, fpr and recall on the training samples (or on val_votes' where given)."""
    n_pos, n_neg = int(y.sum()), int((1 - y).sum())
    w = np.where(y == 1, 0.5 / max(n_pos, 1), 0.5 / max(n_neg, 1))
    total, alphas, out = np.zeros(len(y)), [], []
    threshold, fpr, recall = 0.5, 1.0, 0.0
    known = list(replay)
    while len(out) < opts.max_stumps:
        if w.sum() <= 0:
            break
        w = w / w.sum()
        if known:
            s = known.pop(0)
            row = features.where((F.col("kind") == s.kind) & (F.col("x") == s.x) & (F.col("y") == s.y) & (F.col("w") == s.w) & (F.col("h") == s.h)).orderBy("feature_id").first()
            if row is None:
                raise ValueError("a saved stump has no feature in this bank")
            fires = s.polarity * _by_sample(row["vals"], row["ord"]) < s.polarity * s.threshold
            beta = math.exp(-s.alpha)
        else:
            b = best_stump(features, w, y, opts.tie_exact)
            if b is None or b["err"] >= 0.5:
                break
            err = min(max(b["err"], 1e-10), 0.5 - 1e-10)
            beta = err / (1 - err)
            s = StumpRow(b["kind"], b["x"], b["y"], b["w"], b["h"], b["threshold"], b["polarity"], math.log(1 / beta))
            fires = s.polarity * _by_sample(b["vals"], b["ord"]) < s.polarity * s.threshold
        w = w * np.where(fires == (y == 1), beta, 1.0)
        out.append(s)
        alphas.append(s.alpha)
        total += s.alpha * fires
        score = total / sum(alphas)
        val = val_votes(out) if val_votes else score[y == 1]
        threshold = calibrated(val, alphas, opts.layer_recall) if opts.target_stage_fpr > 0 else 0.5
        fpr, recall = float((score[y == 0] >= threshold).mean()) if n_neg else 0.0, float((val >= threshold).mean())
        if opts.target_stage_fpr > 0 and not known and fpr <= opts.target_stage_fpr and recall >= opts.layer_recall and len(out) >= opts.min_stumps:
            break
    if not out:
        raise ValueError("no stump is better than chance on these samples")
    return out, calibrated(val_votes(out) if val_votes else (total / sum(alphas))[y == 1], alphas, opts.layer_recall), fpr, recall


def _votes(patches: list[tuple[np.ndarray, float]]):
    """Votes of a list of stumps on held (ii, std) pairs, for calibration on a validation set."""
    ii = np.array([p for p, _ in patches], np.int64)
    std = np.array([s for _, s in patches])

    def of(stumps: list[StumpRow]) -> np.ndarray:
        width = int(math.isqrt(ii.shape[1]))
        total = np.zeros(len(ii))
        for s in stumps:
            v = np.zeros(len(ii))
            for dx, dy, sign in haar.signed_cells(s.kind):
                x1, y1 = s.x + dx * s.w, s.y + dy * s.h
                x2, y2 = x1 + s.w, y1 + s.h
                v += sign * (ii[:, y2 * width + x2] - ii[:, y1 * width + x2] - ii[:, y2 * width + x1] + ii[:, y1 * width + x1])
            total += s.alpha * (s.polarity * v < s.polarity * s.threshold * std)
        return total / sum(s.alpha for s in stumps)

    return of


def _held(patches: DataFrame, width: int, height: int) -> list[tuple[np.ndarray, float]]:
    """Validation samples on the driver; the same bound as for a stage's samples."""
    _small(patches.count(), width, height)
    rows = patches.select(integral_arrow(F.col("px"), F.lit(width)).alias("ii"), sample_std(F.col("px")).alias("std")).toLocalIterator()
    return [(np.array(r.ii), r["std"]) for r in rows]


def _passing(stages: list[Stage], votes, n: int) -> float:
    """The part of the held samples that pass all stages."""
    passed = np.ones(n, bool)
    for s in stages:
        passed &= votes(list(s.stumps)) >= s.threshold
    return float(passed.mean()) if n else 0.0


def train(spark: SparkSession, positives: DataFrame, pool: DataFrame, path: str, width: int, height: int, opts: Options = Options(), validation: DataFrame | None = None, seed_pool: DataFrame | None = None, reserve: DataFrame | None = None, resume: Cascade | None = None) -> tuple[Cascade, list[StageLog]]:
    """Stages until a stop rule: no or too few negatives, a stage at its stump cap above the target
    rate, recall of the cascade below the floor, or max_stages. The stage that trips a rule is kept.

    positives, pool, seed_pool, reserve: patch_id, px. Each stage is written to path as it is done.
    """
    stages = list(resume.stages) if resume else []
    if resume and (resume.width, resume.height) != (width, height):
        raise ValueError("the model to resume has another window")
    logs: list[StageLog] = []
    pos = positives.select("patch_id", "px", F.lit(1).alias("y"))
    held = _held(validation if validation is not None else positives, width, height)
    votes = _votes(held)
    while len(stages) < opts.max_stages:
        k = len(stages)
        if k == 0:
            neg = dataset.sample(seed_pool if seed_pool is not None else pool, opts.target_negatives, "patch_id", opts.seed)
        else:
            neg = mine_stratified(pool, Cascade(stages, width, height), opts.target_negatives, opts.mining_budget, seed_pool, reserve, opts.seed + k)
        neg = neg.select("patch_id", "px", F.lit(0).alias("y")).persist()
        n_neg = neg.count()
        if n_neg == 0 or (n_neg < opts.min_stage_negatives and (k > 0 or resume is not None)):
            log.info("stage %d: %d negatives are left", k, n_neg)
            break
        features, y = feature_rows(spark, pos.unionByName(neg), width, height, opts)
        stumps, threshold, fpr, recall = boost_stage(features, y, opts, val_votes=votes)
        features.unpersist()
        neg.unpersist()
        stage = Stage(threshold, tuple(stumps))
        stages.append(stage)
        models.save_stage(spark, path, k, stage, width, height)
        capped = opts.target_stage_fpr > 0 and len(stumps) >= opts.max_stumps and fpr > opts.target_stage_fpr
        logs.append(StageLog(k, stumps, threshold, fpr, recall, capped, _passing(stages, votes, len(held))))
        if capped or logs[-1].cumulative < opts.min_cascade_recall:
            break
    if not stages:
        raise ValueError("no negatives to train a first stage with")
    return Cascade(stages, width, height), logs


def extend_last(
    spark: SparkSession, model: Cascade, positives: DataFrame, pool: DataFrame, path: str, max_stumps: int, opts: Options = Options(),
    validation: DataFrame | None = None, seed_pool: DataFrame | None = None, reserve: DataFrame | None = None, logs: list[StageLog] | None = None,
) -> Cascade:
    """The last stage again with more stumps: negatives mined by the stages before it, its stumps
    replayed with their stored weights, then new rounds up to the cap, and a new threshold.

    Threshold and stop rule go by the validation samples (the positives where none are given), as does the
    cumulative recall, which a row in ``logs`` reports."""
    k = len(model.stages) - 1
    before, last = model.stages[:k], model.stages[k]
    if k:
        neg = mine_stratified(pool, Cascade(before, model.width, model.height), opts.target_negatives, opts.mining_budget, seed_pool, reserve, opts.seed + k)
    else:
        neg = dataset.sample(seed_pool if seed_pool is not None else pool, opts.target_negatives, "patch_id", opts.seed)
    both = positives.select("patch_id", "px", F.lit(1).alias("y")).unionByName(neg.select("patch_id", "px", F.lit(0).alias("y")))
    held = _held(validation if validation is not None else positives, model.width, model.height)
    votes = _votes(held)
    features, y = feature_rows(spark, both, model.width, model.height, opts)
    more = Options(**{**opts.__dict__, "max_stumps": max_stumps, "min_stumps": len(last.stumps) + 1})
    stumps, threshold, fpr, recall = boost_stage(features, y, more, replay=last.stumps, val_votes=votes)
    features.unpersist()
    stage = Stage(threshold, tuple(stumps))
    models.save_stage(spark, path, k, stage, model.width, model.height)
    if logs is not None:
        logs.append(StageLog(k, stumps, threshold, fpr, recall, len(stumps) >= max_stumps, _passing([*before, stage], votes, len(held))))
    return Cascade([*before, stage], model.width, model.height)
