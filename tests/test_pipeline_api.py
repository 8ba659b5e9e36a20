"""Bundles to model to report through the commands; resizing, warping, files, kept results, raw mining."""

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stumpwright import cli, storage
from stumpwright import fixtures as X
from stumpwright.functions import resample
from stumpwright.operators import detect, mining
from stumpwright.plans import prepare
from stumpwright.plans.patch_queries import XML, _model
from stumpwright.sources import datasets, images
from stumpwright.sources.xml_cascade import parse_cascade


def test_bundle_to_report(spark, sf, tmp_path):
    p = X.patches(spark, sf)
    faces = p.select(F.col("patch_id").alias("id"), F.when(F.col("split") == "test", "test").otherwise("train").alias("split"), "source", F.col("y").alias("label"), "px")
    pool = p.where("y = 0 and source <> 'src0' and split <> 'test'").select(F.col("patch_id").alias("id"), "px")
    plan = prepare.Plan(("src0", "src1"), "src0", 60, 25, "mixed", 80, augment=False)
    data, model = str(tmp_path / "data"), str(tmp_path / "model")
    bundle = prepare.prepare(faces, pool, plan, 8)
    counts = {r.split: r.n for r in prepare.save(bundle, data, 8).collect()}
    assert counts["val_pos"] == 25 and counts["train_pos"] <= 120 and counts["caltech_pool"] == 80
    ids = {r.split: {x.id for x in bundle.where(F.col("split") == r.split).collect()} for r in bundle.select("split").distinct().collect()}
    assert not ids["val_pos"] & ids["train_pos"]
    opts = {"layer_recall": 0.95, "max_stages": 2, "max_stumps": 2, "target_negatives": 50, "mining_budget": 200, "least_side": 4, "min_cascade_recall": 0.1, "target_stage_fpr": 0.9}
    m = cli.train(spark, data, model, 8, **opts)
    assert cli.test(spark, data, model).first().tp <= counts["test_pos"] and cli.diagnose(spark, data, model).count() == len(m.stages)
    assert cli.score_faces(spark, data, model, f"{data}_scores").count() == counts["train_pos"]
    assert cli.mine(spark, data, model).count() <= 80
    assert len(cli.tune(spark, data, model, str(tmp_path / "tuned"))) == len(m.stages)
    assert len(cli.truncate(spark, model, str(tmp_path / "short"), 1).stages) == 1
    cli.train(spark, data, str(tmp_path / "dropped"), 8, drop=0.5, **{**opts, "max_stages": 1})
    for bad in ({"negatives": "x"}, {"negatives": "mixed", "benchmark": None}):
        with pytest.raises(ValueError):
            prepare.Plan(("a",), **bad)


def test_resizing_and_warping(spark):
    a = np.arange(36).reshape(6, 6) * 7
    for kind in resample.KERNELS:
        assert np.allclose(resample.weights(6, 4, kind).sum(1), 1)
        assert (resample.resize_array(np.full((6, 6), 9.0), 11, 4, kind) == 9).all()
    assert (resample.resize_array(a, 6, 6) == a).all()
    assert (resample.resize_array(np.array([[0.0, 100.0]]), 1, 4) == [[0, 25, 75, 100]]).all()
    assert (resample.warp_array(a.astype(float), (1.0, 0.0, 0.0, 0.0), 6) == a).all()
    assert (resample.warp_array(a.astype(float), (1.0, 0.0, 1.0, 2.0), 6)[2:, 1:] == a[:4, :5]).all()
    df = spark.createDataFrame([(a.ravel().tolist(),)], "px array<int>")
    six = F.lit(6)
    r = df.select(resample.resized("px", six, six, F.lit(3), F.lit(3), F.lit("bilinear")).alias("s"), resample.png("px", six).alias("p"), resample.warped("px", six, six, F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty")), six).alias("w")).first()
    assert r.s == resample.resize_array(a, 3, 3).ravel().tolist() and r.w == a.ravel().tolist()
    assert r.p[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", r.p[16:24]) == (6, 6)
    at = r.p.index(b"IDAT")
    lines = zlib.decompress(r.p[at + 4 : at + 4 + int.from_bytes(r.p[at - 4 : at], "big")])
    assert np.array_equal(np.frombuffer(lines, np.uint8).reshape(6, 7)[:, 1:], a)


def test_jvm_reads_our_png(spark, tmp_path):
    a = np.arange(48, dtype=np.uint8).reshape(6, 8)
    (tmp_path / "a.png").write_bytes(resample.png_bytes(a))
    r = images.read_images(spark, str(tmp_path / "a.png")).first()
    assert (r.h, r.w, r.px) == (6, 8, a.ravel().tolist())


def test_tables_and_kept_results(spark, tmp_path):
    df = spark.createDataFrame([((b"\xff\xd8\xff", "a.jpg"), 1, "cbcl", None), ((b"x", "b"), 0, "caltech", "car")], datasets.IMAGE_SCHEMA)
    datasets.write_shards(df, str(tmp_path / "t"))
    assert datasets.read_labelled(spark, str(tmp_path / "t"), "cbcl", 1).select("image.path").first()[0] == "a.jpg"
    assert datasets.without_source(spark, str(tmp_path / "t"), str(tmp_path / "u"), "cbcl") and not datasets.without_source(spark, str(tmp_path / "u"), str(tmp_path / "v"), "cbcl")
    assert spark.read.parquet(str(tmp_path / "u")).count() == 1
    made = []

    def make(d):
        made.append(1)
        return d.select("label")

    for opts in (1, 1, 2):
        assert datasets.kept(spark, str(tmp_path / "k"), df, opts, make).count() == 2
    datasets.kept(spark, str(tmp_path / "k"), df.limit(1), 1, make)
    assert len(made) == 3


def test_intermediate_tables_are_swept(spark):
    df = storage.kept(spark.range(10))
    folder = storage._folders[-1]
    assert df.count() == 10 and os.path.isdir(folder)
    storage.sweep(spark)
    assert not os.path.exists(folder) and not storage._folders


def test_detectors_agree(spark, sf):
    im, m = X.text_images(spark, sf).orderBy("image_id").limit(6), _model(spark)
    key = lambda d: {(r.image_id, r.x1, r.y1, r.x2, r.y2): round(r.score, 9) for r in d.collect()}
    assert key(detect.detections_arrow(im, m, min_score=0.2)) == key(detect.detections(im, m, 24, 24, min_score=0.2))
    assert detect.detections_arrow(im.limit(0), m).count() == 0
    found = detect.leaf_detections(im, parse_cascade(XML), step=4).collect()
    assert found and all(0 <= r.x1 < r.x2 <= 24.0001 for r in found)
    std = lambda d: {(r.image_id, r.level, r.ox, r.oy): round(r["std"], 9) for r in d.collect()}
    grid = detect.window_grid(detect.with_integrals(im, 24), detect.scales(spark, (8, 8), (24, 24)))
    assert std(detect.window_stds_arrow(im, (8, 8))) == std(detect.window_stds(grid, 24))


def test_images_of_a_size_are_worked_on_together(spark, sf, monkeypatch):
    m, rng = _model(spark), np.random.default_rng(5)
    sizes = [(24, 24), (30, 24), (24, 24), (9, 24), (7, 24), (40, 31)] * 4
    px = [rng.integers(0, 256, h * w) for h, w in sizes]
    batch = pa.RecordBatch.from_pydict({"image_id": list(range(len(px))), "h": [h for h, _ in sizes], "w": [w for _, w in sizes], "px": [p.tolist() for p in px]})
    rows = lambda image, found: {(image[k], *(int(c[k]) for c in found[:4]), float(found[4][k])) for k in range(len(found[4]))}
    alone = set()
    for i, (p, (h, w)) in enumerate(zip(px, sizes)):
        row, *found = detect._stack_windows(p, 1, h, w, m, {})
        assert not row.any()
        alone |= rows([i] * len(row), found)
    for pixels in (1, 1500, 1 << 18):
        monkeypatch.setattr(detect, "STACK_PIXELS", pixels)
        together, seen = set(), []
        for own, p, h, w in detect._stacks(batch):
            assert len(own) == 1 or len(own) * h * w <= pixels
            row, *found = detect._stack_windows(p, len(own), h, w, m, {})
            seen += own.tolist()
            together |= rows(own[row].tolist(), found)
        assert sorted(seen) == list(range(len(px))) and together == alone and alone


def test_raw_mining_counts(spark, sf):
    im, m = X.text_images(spark, sf), _model(spark)
    few = mining.mine_raw(im, m, 24, 10, 10_000, 2, 1).collect()
    more = mining.mine_raw(im, m, 24, 25, 10_000, 2, 1).collect()
    assert len(few) == 10 and len(more) == 25 and {(r.image_id, r["pass"], r.k) for r in few} <= {(r.image_id, r["pass"], r.k) for r in more}
    assert len(mining.mine_raw(im, m, 24, 10**6, 37, 2, 1).collect()) <= 37
    assert mining.mine_raw(im, m, 24, 0, 5, 2).count() == 0
