"""Bundles anew, longer last stages, other patch sizes, three-point warps, evaluation from files, commands over tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plain
from stumpwright import cli
from stumpwright import fixtures as X
from stumpwright.functions import geometry as G
from stumpwright.functions import resample
from stumpwright.operators import cascade, detect, evaluation, metrics, mining, ranking
from stumpwright.plans import prepare, trainer
from stumpwright.plans.patch_queries import XML, _model
from stumpwright.sources import bundles, images, models
from stumpwright.sources.xml_cascade import parse_cascade


def test_a_new_bundle_leaves_no_old_split(spark, sf, tmp_path):
    p = X.patches(spark, sf).select(F.col("patch_id").alias("id"), "split", "px")
    prepare.save(p, str(tmp_path / "b"), 8)
    left = {r.split for r in prepare.save(p.where("split <> 'val'"), str(tmp_path / "b"), 8).collect()}
    assert left == {"train", "test"} == {r.split for r in bundles.read(spark, str(tmp_path / "b")).select("split").distinct().collect()}


def test_last_stage_goes_by_validation(spark, sf, tmp_path):
    p = X.patches(spark, sf)
    pos, neg, val = p.where("y = 1 and split = 'train'"), p.where("y = 0 and split = 'train'"), p.where("y = 1 and split = 'val'")
    opts = trainer.Options(max_stages=1, max_stumps=2, layer_recall=0.95, target_negatives=60, target_stage_fpr=0.01)
    model, _ = trainer.train(spark, pos, neg, str(tmp_path / "m"), 8, 8, opts, val)
    logs = []
    longer = trainer.extend_last(spark, model, pos, neg, str(tmp_path / "n"), 4, opts, val, neg, None, logs)
    held = cascade.verdicts(cascade.stage_scores(val, longer), longer)
    assert len(longer.stages[0].stumps) > 2 and abs(logs[0].cumulative - held.agg(F.avg(F.col("passed").cast("double"))).first()[0]) < 1e-12
    scores = np.array([r.scores[0] for r in held.select("scores").collect()])
    alphas = [s.alpha for s in longer.stages[0].stumps]
    assert abs(longer.stages[0].threshold - trainer.calibrated(scores, alphas, 0.95)) < 1e-9
    with pytest.raises(ValueError, match="bytes"):
        trainer._small(1 << 24, 24, 24)


def test_patches_of_other_sizes_are_resized(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (8, 8)), rng.integers(0, 256, (13, 11))
    rows = [(1, 8, 8, a.ravel().tolist()), (2, 13, 11, b.ravel().tolist())]
    df = spark.createDataFrame(rows, "patch_id long, h int, w int, px array<int>")
    got = {r.patch_id: r.px for r in detect.base_sized(df, 8, 8).collect()}
    assert got == {1: a.ravel().tolist(), 2: resample.resize_array(b.astype(float), 8, 8, "bicubic").ravel().tolist()}
    assert detect.leaf_verdicts(df, parse_cascade(XML)).count() == 2


def test_three_points(spark):
    t = "struct<x:double,y:double>"
    pts = [(3.0, 4.0), (11.0, 5.0), (7.5, 13.0)]
    df = spark.createDataFrame([tuple(pts)], f"a {t}, b {t}, c {t}")
    cols, dst = [F.col(c) for c in "abc"], [(15.0, 18.0), (33.0, 18.0), (24.0, 38.0)]
    two, same, three = df.select(G.similarity(cols[0], cols[1], (dst[0], dst[1])), G.similarity_of(cols[:2], dst[:2]), G.similarity_of(cols, dst)).first()
    assert np.allclose(two, same)
    m = np.array([r for x, y in pts for r in ([x, -y, 1, 0], [y, x, 0, 1])])
    assert np.allclose(three, np.linalg.lstsq(m, np.array(dst).ravel(), rcond=None)[0])


def test_drawing_outlines():
    out = resample.outlined(np.zeros((6, 7), int), np.array([1, 2, 4, 4, -3, -3, 20, 20]))
    assert sorted(map(tuple, np.argwhere(out))) == sorted({(y, x) for y in range(2, 5) for x in range(1, 5) if y in (2, 4) or x in (1, 4)})


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pics")
    rng = np.random.default_rng(3)
    for name in ("2002/a/one", "2002/a/two", "2003/b/three"):
        path = root / "deep" / "originalPics" / f"{name}.png"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(resample.png_bytes(rng.integers(0, 256, (20, 26))))
    (root / "fold.txt").write_text("2002/a/one\n1\n6 6 0 10 10 1\n2002/a/two\n2\n6 6 0 8 8 1\n5 5 0 18 10 1\n2003/b/three\n0\n2002/gone\n1\n5 5 0 9 9 1\n")
    return root


def test_evaluation_from_files(spark, pictures, tmp_path):
    root = images.find_root(spark, str(pictures), "2002", ("originalPics",))
    assert root.endswith("deep/originalPics") and images.find_root(spark, f"{pictures}/deep", "2002", ("originalPics",)).endswith("deep/originalPics")
    with pytest.raises(FileNotFoundError):
        images.find_root(spark, str(pictures), "1999")
    models.save(spark, str(tmp_path / "m"), _model(spark))
    rows = cli.evaluate_images(spark, str(pictures), str(pictures / "fold.txt"), str(tmp_path / "m")).collect()
    assert [r.iou_threshold for r in sorted(rows)] == [0.3, 0.5] and all(r.n_det == r.tp + r.fp > 0 and r["50"] <= r.recall <= 0.75 for r in rows)
    found = cli.detect_images(spark, root + "/2002/a", str(tmp_path / "m"), out=str(tmp_path / "drawn"))
    assert found.count() > 0 and {bytes(r.png[:4]) for r in spark.read.parquet(str(tmp_path / "drawn")).collect()} == {b"\x89PNG"}
    none = cli.detect_images(spark, root + "/2002/a", str(tmp_path / "m"), max_face=4.0)
    assert none.count() == 0


def test_models_and_tables_by_command(spark, sf, tmp_path):
    p = X.patches(spark, sf)
    (tmp_path / "c.xml").write_text(XML)
    assert cli.convert(spark, str(tmp_path / "c.xml"), str(tmp_path / "leaf")).startswith("2 stages")
    bundles.write(p.where("split = 'test'").withColumn("split", F.when(F.col("y") == 1, "test_pos").otherwise("test_neg")).drop("y", "source"), str(tmp_path / "d"))
    models.save(spark, str(tmp_path / "m"), _model(spark))
    both = cli.baseline(spark, str(tmp_path / "d"), f"{tmp_path}/m,{tmp_path}/c.xml").collect()
    n = p.where("split = 'test'").count()
    assert len(both) == 2 and all(r.tp + r.tn + r.fp + r.fn == n for r in both)
    assert cli.parity(spark, str(tmp_path / "d"), str(tmp_path / "m"), str(tmp_path / "m")).first().rate == 1.0
    faces = p.select(F.col("patch_id").alias("id"), F.when(F.col("split") == "test", "test").otherwise("train").alias("split"), "source", F.col("y").alias("label"), "px", F.lit(8).alias("w"))
    faces.write.parquet(str(tmp_path / "faces"))
    assert cli.inspect(spark, str(tmp_path / "faces"), str(tmp_path / "samples"), 3).where("split is null").first().n == p.count()
    assert spark.read.parquet(str(tmp_path / "samples")).groupBy("folder").count().agg(F.max("count")).first()[0] == 3
    assert cli.stats(spark, str(tmp_path / "faces")).count() == 6
    made = cli.prepare_bundle(spark, str(tmp_path / "faces"), str(tmp_path / "faces"), str(tmp_path / "bundle"), "src0,src1", 8, "src0", val_size=10)
    assert {r.split for r in made.collect()} == {"train_pos", "val_pos", "caltech_pool", "test_pos", "test_neg"}
    X.text_images(spark, sf).limit(20).write.parquet(str(tmp_path / "raw"))
    assert cli.mine_raw(spark, str(tmp_path / "raw"), str(tmp_path / "m"), str(tmp_path / "hard"), 10, 4000, 20).count() == 10


def test_ranks_and_quantiles_by_ranges(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([(i, i % 3, float(v)) for i, v in enumerate(values)], "id long, g int, v double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = (F.desc("v"), F.asc("id"))
        parts = ranking.dealt(df, *order)
        assert parts.select(ranking.PART).distinct().count() > 1
        rows = ranking.largest_after(ranking.ranked(parts, *order, sums=("g",)), "v", F.col("rk")).orderBy("rk").collect()
        want = sorted(range(3000), key=lambda i: (-values[i], i))
        assert [r.id for r in rows] == want and [r.cum_g for r in rows] == np.cumsum([i % 3 for i in want]).tolist() and all(r.after == r.v for r in rows)
        got = ranking.quantiles(df, "v", {(k,): (0.0, 0.37, 1.0) for k in range(4)}, "g")
        assert got[3,] == [None] * 3 and all(np.allclose(got[k,], np.quantile(values[k::3], (0.0, 0.37, 1.0))) for k in range(3))
        assert [plain(r.value) for r in metrics.quantiles(df.limit(0), "v").collect()] == [None] * len(metrics.QUANTILES)
        first = mining.first_rows(df, 100, "v", "id").select("id").collect()
        assert sorted(r.id for r in first) == sorted(sorted(range(3000), key=lambda i: (values[i], i))[:100])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stripes_lose_no_pair(spark):
    rng = np.random.default_rng(7)

    def box(i):
        x, y = float(rng.uniform(-50, 300)), float(rng.uniform(0, 90))
        return int(rng.integers(3)), i, 0.5, x, y, x + float(rng.uniform(1, 200)), y + float(rng.uniform(1, 90))

    schema = "image_id long, id long, score double, x1 double, y1 double, x2 double, y2 double"
    det, gt = (spark.createDataFrame([box(i) for i in range(60)], schema) for _ in range(2))
    narrow = {(r.det_id, r.gt_id) for r in evaluation.overlaps(det, gt, 0.2, 16).collect()}
    assert narrow == {(r.det_id, r.gt_id) for r in evaluation.overlaps(det, gt, 0.2, 10_000).collect()} and len(narrow) == evaluation.overlaps(det, gt, 0.2, 16).count()
