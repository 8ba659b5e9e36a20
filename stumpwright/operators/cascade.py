"""Scoring with a boosted cascade: votes, verdicts, margins, early exit.

A model is two small tables (stages, stumps), read on the driver once. Patches are scored by an Arrow
function of their pixels, a batch's integral images at a time, so scoring is a narrow plan and no other
column leaves the JVM; a stage looks only at the patches that are left. The column forms (``vote``,
``feature_value``) serve windows of larger images.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType

from stumpwright.functions.integral import rect_sum, sample_stds, scaled_corner
from stumpwright.operators.haar import signed_cells


@dataclass(frozen=True)
class StumpRow:
    kind: str
    x: int
    y: int
    w: int
    h: int
    threshold: float
    polarity: int
    alpha: float


@dataclass(frozen=True)
class Stage:
    threshold: float
    stumps: tuple[StumpRow, ...]

    @property
    def total(self) -> float:
        return sum(s.alpha for s in self.stumps)


class Cascade:
    """An ordered list of stages for a base window."""

    def __init__(self, stages: Sequence[Stage], width: int, height: int):
        if any(not s.stumps or s.total <= 0 for s in stages):
            raise ValueError("a stage without stumps or without weight has no defined vote")
        self.stages, self.width, self.height = tuple(stages), width, height

    @classmethod
    def of(cls, stages: DataFrame, stumps: DataFrame, width: int, height: int) -> Cascade:
        """From model tables, which have a row per stage and stump."""
        rows = stumps.orderBy("stage", "t").collect()
        make = lambda r: StumpRow(r.kind, r.x, r.y, r.w, r.h, r.threshold, r.polarity, r.alpha)
        found = [Stage(s.threshold, tuple(make(r) for r in rows if r.stage == s.stage)) for s in stages.orderBy("stage").collect()]
        return cls(found, width, height)

    def truncated(self, n: int) -> Cascade:
        """The first n stages (at least one; all of them if n is larger)."""
        if n < 1:
            raise ValueError("a cascade keeps one stage at least")
        return Cascade(self.stages[:n], self.width, self.height)

    def with_thresholds(self, thresholds: Sequence[float]) -> Cascade:
        return Cascade([Stage(t, s.stumps) for t, s in zip(thresholds, self.stages, strict=True)], self.width, self.height)


def feature_value(s: StumpRow, ii: Column, width: Column | int, scale: Column | float = 1.0, ox: Column | int = 0, oy: Column | int = 0) -> Column:
    """Signed rectangle sums; every corner is truncated by itself at a scale."""
    out = None
    for dx, dy, sign in signed_cells(s.kind):
        x, y = s.x + dx * s.w, s.y + dy * s.h
        plain = not isinstance(scale, Column) and scale == 1.0
        corner = lambda v, o: F.lit(v) + (o if isinstance(o, Column) else F.lit(o)) if plain else scaled_corner(F.lit(v), scale, o)
        one = rect_sum(ii, width, corner(x, ox), corner(y, oy), corner(x + s.w, ox), corner(y + s.h, oy)) * sign
        out = one if out is None else out + one
    return out


def vote(stage: Stage, ii: Column, width: Column | int, std: Column, scale: Column | float = 1.0, ox: Column | int = 0, oy: Column | int = 0) -> Column:
    """Weighted vote in 0..1; a stump's threshold grows with the window's area and deviation."""
    area = F.lit(1.0) if not isinstance(scale, Column) and scale == 1.0 else (scale if isinstance(scale, Column) else F.lit(scale)) * scale
    out = F.lit(0.0)
    for s in stage.stumps:
        fires = F.lit(float(s.polarity)) * feature_value(s, ii, width, scale, ox, oy) < F.lit(s.polarity * s.threshold) * area * std
        out = out + F.when(fires, F.lit(s.alpha)).otherwise(F.lit(0.0))
    return out / F.lit(stage.total)


#: Patches whose integral images are held at once.
_CHUNK = 2048


class _Scorer:
    """Votes on a batch of patches, in the order of operations of the column form."""

    def __init__(self, model: Cascade):
        self.stages, self.width, self.height = model.stages, model.width, model.height

    def chunks(self, px: pa.Array):
        """Pixels of the patches that aren't null, as (height, width, patches)."""
        px = px.drop_null()
        if len(px) and pc.any(pc.not_equal(pc.list_value_length(px), self.width * self.height)).as_py():
            raise ValueError(f"a patch is not {self.width} x {self.height}")
        for at in range(0, len(px), _CHUNK):
            part = px.slice(at, _CHUNK).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield np.ascontiguousarray(part.reshape(-1, self.height, self.width).transpose(1, 2, 0))

    def prepared(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Integral images and deviations."""
        h, w, n = a.shape
        ii = np.zeros((h + 1, w + 1, n), np.int64)
        ii[1:, 1:] = a.cumsum(0).cumsum(1)
        return ii, sample_stds(a.reshape(h * w, n))

    def vote(self, stage: Stage, ii: np.ndarray, std: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        std, out = std[rows], 0.0
        for s in stage.stumps:
            value = 0
            for dx, dy, sign in signed_cells(s.kind):
                x1, y1 = s.x + dx * s.w, s.y + dy * s.h
                x2, y2 = x1 + s.w, y1 + s.h
                value = value + sign * (ii[y2, x2][rows] - ii[y1, x2][rows] - ii[y2, x1][rows] + ii[y1, x1][rows])
            out = out + np.where(s.polarity * value < s.polarity * s.threshold * std, s.alpha, 0.0)
        return out / stage.total

    def scores(self, px: pa.Array) -> pa.Array:
        """A list of all stages' votes per patch."""
        rows = [np.stack([self.vote(s, *got, slice(None)) for s in self.stages], 1) for got in map(self.prepared, self.chunks(px))]
        every = iter(np.concatenate(rows).tolist() if rows else ())
        return pa.array([next(every) if known else None for known in px.is_valid().to_pylist()], pa.list_(pa.float64()))

    def passes(self, px: pa.Array) -> pa.Array:
        """Whether every stage accepts the patch."""
        out = []
        for got in map(self.prepared, self.chunks(px)):
            left = np.arange(len(got[1]))
            for s in self.stages:
                left = left[self.vote(s, *got, left) >= s.threshold]
            out.append(np.zeros(len(got[1]), bool))
            out[-1][left] = True
        known = px.is_valid().to_numpy(zero_copy_only=False)
        found = np.zeros(len(px), bool)
        found[known] = np.concatenate(out) if out else []
        return pa.array(found)


def stage_scores(patches: DataFrame, model: Cascade) -> DataFrame:
    """patches (with their other columns, but px) and scores: the vote of every stage, without early exit.
    A null patch has null scores; one of another size is an error."""
    scorer = _Scorer(model)

    @F.arrow_udf(ArrayType(DoubleType()))
    def scores(px: pa.Array) -> pa.Array:
        return scorer.scores(px)

    return patches.withColumn("scores", scores("px")).drop("px")


def thresholds(model: Cascade) -> Column:
    return F.array(*[F.lit(s.threshold) for s in model.stages])


def verdicts(scored: DataFrame, model: Cascade) -> DataFrame:
    """scored with margin (sum of score - threshold over all stages) and passed (all reach theirs)."""
    t = thresholds(model)
    margin = F.aggregate(F.zip_with("scores", t, lambda s, t: s - t), F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn("margin", margin).withColumn("passed", F.forall(F.zip_with("scores", t, lambda s, t: s >= t), lambda x: x))


def accepted(patches: DataFrame, model: Cascade) -> DataFrame:
    """The patches that every stage accepts; a patch rejected by a stage pays for no later one. A null
    patch isn't accepted, one of another size is an error."""
    scorer = _Scorer(model)

    @F.arrow_udf(BooleanType())
    def passes(px: pa.Array) -> pa.Array:
        return scorer.passes(px)

    return patches.where(passes("px"))


def long_scores(scored: DataFrame) -> DataFrame:
    """A row per patch and stage: stage, score beside the other columns."""
    keep = [c for c in scored.columns if c != "scores"]
    return scored.select(*keep, F.posexplode("scores").alias("stage", "score"))
