"""Models as Parquet: a partition per stage, so training can stop and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright.fixtures import STUMP_SCHEMA
from stumpwright.operators.cascade import Cascade, Stage, StumpRow
from stumpwright.operators.detect import LeafCascade, LeafStage, LeafStump

_ROW = "stage_threshold double, " + STUMP_SCHEMA.removeprefix("stage int, ") + ", width int, height int"


def save_stage(spark: SparkSession, path: str, k: int, stage: Stage, width: int, height: int) -> None:
    """Write stage k, over a stage k that is there."""
    rows = [(stage.threshold, i, -1, s.kind, s.x, s.y, s.w, s.h, s.threshold, s.polarity, s.alpha, width, height) for i, s in enumerate(stage.stumps)]
    spark.createDataFrame(rows, _ROW).coalesce(1).write.mode("overwrite").parquet(f"{path}/stage={k}")


def save(spark: SparkSession, path: str, model: Cascade) -> None:
    for k, stage in enumerate(model.stages):
        save_stage(spark, path, k, stage, model.width, model.height)


def load(spark: SparkSession, path: str, stages: int | None = None) -> Cascade:
    """The cascade below path, or its first stages."""
    rows = spark.read.schema(_ROW + ", stage int").parquet(path).orderBy("stage", "t").collect()
    if not rows:
        raise ValueError(f"no model in {path}")
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r.stage, []).append(r)
    built = [Stage(own[0].stage_threshold, tuple(StumpRow(r.kind, r.x, r.y, r.w, r.h, r.threshold, r.polarity, r.alpha) for r in own)) for _, own in sorted(found.items())]
    return Cascade(built[:stages] if stages else built, rows[0].width, rows[0].height)


_LEAF = "stage int, t int, stage_threshold double, threshold double, below double, above double, rects array<array<double>>, width int, height int"


def save_leaf(spark: SparkSession, path: str, model: LeafCascade) -> None:
    """A model of the XML format as a Parquet table, a row a stump."""
    rows = [
        (k, t, s.threshold, c.threshold, c.left, c.right, [list(map(float, r)) for r in c.rects], model.width, model.height)
        for k, s in enumerate(model.stages) for t, c in enumerate(s.stumps)
    ]
    spark.createDataFrame(rows, _LEAF).coalesce(1).write.mode("overwrite").parquet(path)


def load_leaf(spark: SparkSession, path: str) -> LeafCascade:
    rows = spark.read.schema(_LEAF).parquet(path).orderBy("stage", "t").collect()
    if not rows:
        raise ValueError(f"no model in {path}")
    rects = lambda r: tuple((int(x), int(y), int(w), int(h), k) for x, y, w, h, k in r.rects)
    stages: dict[int, list] = {}
    for r in rows:
        stages.setdefault(r.stage, []).append(r)
    built = tuple(LeafStage(own[0].stage_threshold, tuple(LeafStump(rects(r), r.threshold, r.below, r.above) for r in own)) for _, own in sorted(stages.items()))
    return LeafCascade(built, rows[0].width, rows[0].height)


def latest(registry: DataFrame, key: str, order: Column) -> DataFrame:
    """key and the path of greatest order."""
    return registry.groupBy(key).agg(F.max_by("path", order).alias("path"))
