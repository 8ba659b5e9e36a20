"""Commands over bundles and models: python -m stumpwright.cli COMMAND --help."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright.functions import resample
from stumpwright.functions.arithmetic import sample_order
from stumpwright.operators import cascade, dataset, detect, evaluation, metrics, mining, nms, tuning
from stumpwright.plans import prepare, trainer
from stumpwright.sources import annotations, bundles, images, models, xml_cascade
from stumpwright.storage import kept


def _patches(spark: SparkSession, data: str, split: str) -> DataFrame:
    df = bundles.read(spark, data, split)
    return df.withColumnRenamed("id", "patch_id") if "id" in df.columns else df


def _labelled(spark: SparkSession, data: str) -> DataFrame:
    pos, neg = (_patches(spark, data, s).withColumn("y", F.lit(y)) for s, y in (("test_pos", 1), ("test_neg", 0)))
    return pos.unionByName(neg)


def train(spark: SparkSession, data: str, model: str, resolution: int = 24, resume: bool = False, drop: float = 0.0, **options) -> cascade.Cascade:
    """Train on a bundle (train_pos, val_pos, caltech_pool, neg_seed?) and write stages to model.
    drop leaves out that part of the positives, those of the lowest scores in the bundle's face_scores."""
    pos = bundles.check_resolution(_patches(spark, data, "train_pos"), resolution)
    if drop > 0:
        scores = spark.read.parquet(f"{data}_scores").select("patch_id", "score")
        pos = pos.join(metrics.without_lowest(scores, drop).select("patch_id"), "patch_id", "left_semi")
    seed = _patches(spark, data, "neg_seed")
    opts = trainer.Options(**options)
    old = models.load(spark, model) if resume else None
    out, _ = trainer.train(spark, pos, _patches(spark, data, "caltech_pool"), model, resolution, resolution, opts, _patches(spark, data, "val_pos"), seed if not seed.isEmpty() else None, None, old)
    return out


def test(spark: SparkSession, data: str, model: str) -> DataFrame:
    """Counts and rates on test_pos and test_neg."""
    m = models.load(spark, model)
    return metrics.confusion(cascade.verdicts(cascade.stage_scores(_labelled(spark, data), m), m))


def _detector(spark: SparkSession, model: str, min_face: float = 0.0, max_face: float = 0.0, min_score: float | None = None):
    """images -> detections; a model path ending in .xml is of the other format. Bounds of 0 are none."""
    bounds = {k: v for k, v in (("min_face", min_face), ("max_face", max_face)) if v}
    if model.endswith(".xml"):
        leaf = xml_cascade.read_cascade(spark, model)
        return lambda i: detect.leaf_detections(i, leaf, min_score=min_score, **bounds)
    own = models.load(spark, model)
    return lambda i: detect.detections_arrow(i, own, min_score=min_score, **bounds)


def detect_images(spark: SparkSession, path: str, model: str, threshold: float = 0.3, mode: str = "weighted", metric: str = "hybrid", min_face: float = 0.0, max_face: float = 0.0, min_score: float = -1e300, out: str = "") -> DataFrame:
    """Suppressed detections in image files; with out, also the images as PNG with the boxes drawn, a Parquet table."""
    i = images.read_images(spark, path).withColumn("image_id", F.xxhash64("path"))
    d = _detector(spark, model, min_face, max_face, min_score)(i)
    d = d.select("image_id", F.xxhash64(*d.columns).alias("id"), "score", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    found = kept(nms.suppress(d, mode, metric=metric, threshold=threshold).join(i.select("image_id", "path"), "image_id"))
    if out:
        boxes = found.groupBy("image_id").agg(F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]))).alias("boxes"))
        drawn = i.join(boxes, "image_id", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast("array<double>")))
        drawn.select("path", resample.annotated("px", "w", "boxes").alias("png")).write.mode("overwrite").parquet(out)
    return found


def prepare_bundle(spark: SparkSession, faces: str, pool: str, out: str, sources: str, resolution: int = 24, benchmark: str = "", n_faces: int = 0, val_size: int = 1000, negatives: str = "pool", pool_size: int = 100_000, jitter: int = 0, no_augment: bool = False, seed: int = 42) -> DataFrame:
    """Make a bundle from tables of faces (id, split, source, label, px) and pool (id, px); sources is comma-separated."""
    plan = prepare.Plan(tuple(sources.split(",")), benchmark or None, n_faces or None, val_size, negatives, pool_size, jitter, not no_augment, seed)
    return prepare.save(prepare.prepare(spark.read.parquet(faces), spark.read.parquet(pool), plan, resolution), out, resolution)


def mine_raw(spark: SparkSession, raw: str, model: str, out: str, target: int = 15_000, budget: int = 500_000_000, per_image: int = 200, seed: int = 42) -> DataFrame:
    """Accepted random crops of a table of images (image_id, px, h, w, all of one width), written to out."""
    i = spark.read.parquet(raw)
    width = i.select("w").first()
    mining.mine_raw(i, models.load(spark, model), width[0] if width else 1, target, budget, per_image, seed).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def evaluate_images(spark: SparkSession, data: str, lists: str, model: str, marker: str = "2002", threshold: float = 0.3, min_face: float = 0.0, max_face: float = 0.0, overlaps: str = "0.3,0.5") -> DataFrame:
    """Detector, suppression and matching against ellipse lists: a row per overlap with recall by budget of false positives.

    Images lie as <image path>.jpg below the folder in data that holds the marker folder."""
    root = images.find_root(spark, data, marker, ("originalPics",))
    boxes = annotations.read_ellipses(spark, lists)
    named = boxes.select(F.xxhash64("image").alias("image_id"), "image", F.col("gt_id").alias("id"), "x1", "y1", "x2", "y2")
    wanted = named.select("image_id", "image").distinct()
    files = images.read_images(spark, root, recursive=True)
    i = wanted.join(files.withColumn("image", F.regexp_replace(F.substring_index("path", f"{root.rstrip('/').rsplit('/', 1)[-1]}/", -1), r"\.[a-zA-Z]+$", "")), "image", "left")
    steps = tuple(float(x) for x in overlaps.split(","))
    empty = F.array().cast("array<int>")  # an image that can't be read has no detections, and its boxes count as missed
    i = i.withColumns({"px": F.coalesce("px", empty), "h": F.coalesce("h", F.lit(0)), "w": F.coalesce("w", F.lit(0))})
    rep, at = evaluation.end_to_end(i, named.where("id is not null"), _detector(spark, model, min_face, max_face), steps, threshold=threshold)
    return rep.join(at.groupBy("iou_threshold").pivot("budget").agg(F.first("recall")), "iou_threshold")


def baseline(spark: SparkSession, data: str, detectors: str) -> DataFrame:
    """A row of counts and rates on the test splits per comma-separated model; those ending in .xml are of the other format."""
    rows, out = _labelled(spark, data), None
    for path in detectors.split(","):
        if path.endswith(".xml"):
            v = detect.leaf_verdicts(rows, xml_cascade.read_cascade(spark, path))
        else:
            m = models.load(spark, path)
            v = cascade.verdicts(cascade.stage_scores(rows, m), m)
        one = metrics.confusion(v).withColumn("detector", F.lit(path))
        out = one if out is None else out.unionByName(one)
    return out


def convert(spark: SparkSession, xml: str, out: str) -> str:
    """Write a model of the XML format as a table, and check that it reads back the same."""
    m = xml_cascade.read_cascade(spark, xml)
    models.save_leaf(spark, out, m)
    if models.load_leaf(spark, out) != m:
        raise ValueError(f"{out} differs from {xml}")
    return f"{len(m.stages)} stages, window {m.width} x {m.height}"


def parity(spark: SparkSession, data: str, one: str, other: str) -> DataFrame:
    """How often two models agree on the test splits."""
    def verdicts(path: str) -> DataFrame:
        rows = _labelled(spark, data)
        if path.endswith(".xml"):
            return detect.leaf_verdicts(rows, xml_cascade.read_cascade(spark, path))
        m = models.load(spark, path)
        return cascade.verdicts(cascade.stage_scores(rows, m), m)

    return detect.parity(verdicts(one), verdicts(other))


def inspect(spark: SparkSession, table: str, out: str = "", samples: int = 200, seed: int = 42) -> DataFrame:
    """Counts by split, source and label of a table of images (id, split, source, label, px, w); with out, up to so many PNG
    samples of each, numbered by folder, as a Parquet table."""
    rows = spark.read.parquet(table)
    if out:
        folder = F.concat_ws("/", "source", "split", F.col("label").cast("string"))
        some = dataset.capped(rows.withColumn("folder", folder), "folder", [sample_order(F.col("id"), seed), "id"], samples)
        some.select("folder", "seq", "id", resample.png("px", "w").alias("png")).write.mode("overwrite").parquet(out)
    return dataset.counts(rows, "split", "source", "label")


def stats(spark: SparkSession, table: str) -> DataFrame:
    """Counts, pixel means and deviations by source and split of a table of images."""
    return dataset.pixel_stats(spark.read.parquet(table), "source", "split")


def tune(spark: SparkSession, data: str, model: str, out: str, goal: str = "f1", part: str = "val") -> list[float]:
    """Tune thresholds on val_pos against a part of the pool ('val', a held-out set) or on the test
    splits ('test', an upper bound), and write the model with them to out."""
    m = models.load(spark, model)
    if part == "test":
        rows = _labelled(spark, data)
    else:
        rows = _patches(spark, data, "val_pos").withColumn("y", F.lit(1)).unionByName(_patches(spark, data, "caltech_pool").withColumn("y", F.lit(0)))
    found = tuning.tune(cascade.stage_scores(rows, m), [s.threshold for s in m.stages], goal)
    models.save(spark, out, m.with_thresholds(found))
    return found


def diagnose(spark: SparkSession, data: str, model: str) -> DataFrame:
    """Per-stage report on the test splits."""
    m = models.load(spark, model)
    return metrics.diagnostics(cascade.long_scores(cascade.stage_scores(_labelled(spark, data), m)), cascade.thresholds(m))


def score_faces(spark: SparkSession, data: str, model: str, out: str | None = None) -> DataFrame:
    """patch_id, score (sum of margins), passed of the training positives; written beside the bundle if out is given."""
    m = models.load(spark, model)
    v = cascade.verdicts(cascade.stage_scores(_patches(spark, data, "train_pos"), m), m).select("patch_id", F.col("margin").alias("score"), "passed")
    if out:
        v.write.mode("overwrite").parquet(out)
        v = spark.read.parquet(out)
    return v


def mine(spark: SparkSession, data: str, model: str) -> DataFrame:
    """Every patch of the pool that the model accepts."""
    return mining.mine_all(_patches(spark, data, "caltech_pool"), models.load(spark, model))


def extend(spark: SparkSession, data: str, model: str, out: str, max_stumps: int, **options) -> cascade.Cascade:
    """Retrain the last stage with a higher cap, into a copy of the model at out; val_pos sets its threshold."""
    m = models.load(spark, model)
    models.save(spark, out, m)
    seed, val = _patches(spark, data, "neg_seed"), _patches(spark, data, "val_pos")
    return trainer.extend_last(spark, m, _patches(spark, data, "train_pos"), _patches(spark, data, "caltech_pool"), out, max_stumps, trainer.Options(**options), None if val.isEmpty() else val, None if seed.isEmpty() else seed)


def truncate(spark: SparkSession, model: str, out: str, stages: int) -> cascade.Cascade:
    m = models.load(spark, model).truncated(stages)
    models.save(spark, out, m)
    return m


def evaluate(det: DataFrame, gt: DataFrame, thresholds: Sequence[float] = (0.3, 0.5)) -> DataFrame:
    return evaluation.report(det, gt, tuple(thresholds))


def main(argv: Sequence[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="stumpwright", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, f, *names: str, **optional) -> None:
        p = sub.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        for n in names:
            p.add_argument(f"--{n}", required=True)
        for n, default in optional.items():
            kind = {"action": "store_true"} if default is False else {"type": type(default), "default": default}
            p.add_argument(f"--{n.replace('_', '-')}", **kind)
        p.set_defaults(run=f)

    o = trainer.Options()
    knobs = {k: getattr(o, k) for k in ("layer_recall", "target_stage_fpr", "max_stages", "max_stumps", "min_stumps", "min_cascade_recall", "min_stage_negatives", "target_negatives", "mining_budget", "seed", "least_side")}
    command("train", train, "data", "model", resolution=24, resume=False, drop=0.0, **knobs)
    command("test", test, "data", "model")
    command("detect", detect_images, "path", "model", threshold=0.3, mode="weighted", metric="hybrid", min_face=0.0, max_face=0.0, min_score=-1e300, out="")
    command("prepare", prepare_bundle, "faces", "pool", "out", "sources", resolution=24, benchmark="", n_faces=0, val_size=1000, negatives="pool", pool_size=100_000, jitter=0, no_augment=False, seed=42)
    command("mine-raw", mine_raw, "raw", "model", "out", target=15_000, budget=500_000_000, per_image=200, seed=42)
    command("eval", evaluate_images, "data", "lists", "model", marker="2002", threshold=0.3, min_face=0.0, max_face=0.0, overlaps="0.3,0.5")
    command("baseline", baseline, "data", "detectors")
    command("convert", convert, "xml", "out")
    command("parity", parity, "data", "one", "other")
    command("inspect", inspect, "table", out="", samples=200, seed=42)
    command("stats", stats, "table")
    command("tune", tune, "data", "model", "out", goal="f1", part="val")
    command("diagnose", diagnose, "data", "model")
    command("score-faces", score_faces, "data", "model", out="")
    command("mine", mine, "data", "model")
    command("truncate", truncate, "model", "out", stages=1)
    command("extend", extend, "data", "model", "out", max_stumps=500)
    args = vars(top.parse_args(argv))
    run = args.pop("run")
    args.pop("command")
    result = run(SparkSession.builder.getOrCreate(), **args)
    if isinstance(result, DataFrame):
        result.show(50, truncate=False)
    else:
        print(result)


if __name__ == "__main__":
    main()
