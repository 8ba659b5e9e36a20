"""Bundles for training from a labelled image table: splits without leaks, augmentation, pools."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpwright.operators import dataset
from stumpwright.sources import bundles


@dataclass(frozen=True)
class Plan:
    """What goes into a bundle. ``benchmark`` names the source of validation and test, or is None."""

    face_sources: tuple[str, ...]
    benchmark: str | None = None
    n_faces: int | None = None
    val_size: int = 1000
    negatives: str = "pool"  # 'pool', 'benchmark' or 'mixed'
    pool_size: int = 100_000
    jitter: int = 0
    augment: bool = True
    seed: int = 42

    def __post_init__(self) -> None:
        if not self.face_sources:
            raise ValueError("no face source")
        if self.negatives not in ("pool", "benchmark", "mixed"):
            raise ValueError(f"unknown kind of negatives: {self.negatives}")
        if self.negatives != "pool" and self.benchmark is None:
            raise ValueError("benchmark negatives need a benchmark")


def prepare(faces: DataFrame, pool: DataFrame, plan: Plan, side: int) -> DataFrame:
    """split, id, px of all parts in one table.

    faces: id, split ('train' or 'test'), source, label, px of (side + 2 * jitter)^2; pool: id, px of
    side^2. Validation is drawn first and kept out of training by an anti join; jitter gives a centre
    and a shifted crop; then mirror images.
    """
    big = side + 2 * plan.jitter
    middle = dataset.crop(F.col("px"), big, F.lit(plan.jitter), F.lit(plan.jitter), side, side) if plan.jitter else F.col("px")
    of = lambda split, label: faces.where((F.col("split") == split) & (F.col("label") == label)).drop("split")
    named = lambda df, split: df.select(F.lit(split).alias("split"), "id", "px")
    train, parts = of("train", 1), []
    if plan.benchmark is not None:
        own = train.where(F.col("source") == plan.benchmark)
        val, _ = dataset.hold_out(own, plan.val_size, "id", plan.seed)
        parts.append(named(val.withColumn("px", middle), "val_pos"))
        train = train.join(val.select("id"), "id", "left_anti")
    gathered = None
    for s in plan.face_sources:
        part = train.where(F.col("source") == s)
        part = dataset.sample(part, plan.n_faces, "id", plan.seed) if plan.n_faces is not None else part
        gathered = part if gathered is None else gathered.unionByName(part)
    if plan.jitter:
        pos = dataset.jitter_crops(gathered, "id", big, side, plan.jitter, plan.seed).select("id", "px")
    else:
        pos = gathered.select("id", "px")
    parts.append(named(dataset.augmented(pos, side) if plan.augment else pos, "train_pos"))
    if plan.negatives != "benchmark":
        parts.append(named(dataset.sample(pool.select("id", "px"), plan.pool_size, "id", plan.seed), "caltech_pool"))
    if plan.negatives != "pool":
        neg = of("train", 0).where(F.col("source") == plan.benchmark).withColumn("px", middle).select("id", "px")
        neg = dataset.augmented(neg, side) if plan.augment else neg
        parts.append(named(neg, "neg_seed"))
        if plan.negatives == "benchmark":
            parts.append(named(neg, "caltech_pool"))
    if plan.benchmark is not None:
        for label, split in ((1, "test_pos"), (0, "test_neg")):
            test = of("test", label).where(F.coalesce("source", F.lit(plan.benchmark)) == plan.benchmark)
            parts.append(named(test.withColumn("px", middle), split))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save(bundle: DataFrame, path: str, side: int) -> DataFrame:
    """Write the bundle by split, over an older one as a whole, and return its manifest."""
    bundles.write_whole(bundle, path)
    return bundles.manifest(bundles.read(bundle.sparkSession, path), side)
