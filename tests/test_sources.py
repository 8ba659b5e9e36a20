"""Sources and sinks on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stumpwright import fixtures as X
from stumpwright.plans.patch_queries import XML
from stumpwright.sources import annotations, bundles, images, models, xml_cascade
from stumpwright.plans.patch_queries import _model


def test_npy_and_pgm(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", a)
    (tmp_path / "b.pgm").write_bytes(b"P5\n# made\n4 3\n255\n" + a[1].tobytes())
    (tmp_path / "c.pgm").write_text("P2 4 3 255\n" + " ".join(map(str, a[0].ravel())))
    rows = images.read_npy(spark, str(tmp_path / "a.npy")).orderBy("i").collect()
    assert [(r.h, r.w, r.px) for r in rows] == [(3, 4, x.ravel().tolist()) for x in a]
    assert images.read_pgm(spark, str(tmp_path / "b.pgm")).first().px == a[1].ravel().tolist()
    assert images.read_pgm(spark, str(tmp_path / "c.pgm")).first().px == a[0].ravel().tolist()
    assert images.first_existing(spark, str(tmp_path / "no.npy"), str(tmp_path / "a.npy")).endswith("a.npy")
    with pytest.raises(FileNotFoundError):
        images.first_existing(spark, str(tmp_path / "no"))


def test_tree_skips_pointers_and_underscores(spark, tmp_path):
    for name, data in (("cat/a.bin", b"x" * 2000), ("cat/pointer.bin", b"version"), ("dog/_grid.bin", b"y" * 2000), ("dog/b.jpg", b"\xff\xd8\xff\xe0")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {(r.category, r.path.rsplit("/", 1)[1]) for r in images.read_tree(spark, str(tmp_path)).collect()}
    assert got == {("cat", "a.bin"), ("dog", "b.jpg")}


def test_annotation_files(spark, tmp_path):
    (tmp_path / "fold.txt").write_text("2002/a\n2\n10 5 0 50 60 1\n8 4 1.5 20 30 1\n\n2002/b\n0\n")
    rows = annotations.read_ellipses(spark, str(tmp_path / "fold.txt")).orderBy("image", "gt_id").collect()
    assert [(r.image, r.gt_id) for r in rows] == [("2002/a", 0), ("2002/a", 1), ("2002/b", None)]
    assert (rows[0].x1, rows[0].y1, rows[0].x2, rows[0].y2) == (40.0, 55.0, 60.0, 65.0)
    (tmp_path / "lm.txt").write_text("1\nhead\na.jpg 1 2 3 4  5 6 7 8 9 10\n")
    r = annotations.read_landmarks(spark, str(tmp_path / "lm.txt")).first()
    assert r.file == "a.jpg" and tuple(r.left_eye) == (1.0, 2.0) and tuple(r.right_mouth) == (9.0, 10.0)
    doc = {"images": [{"id": 1, "file_name": "a.jpg"}], "annotations": [{"id": i, "image_id": m, "category_id": c, "bbox": b} for i, m, c, b in ((1, 1, 1, [5, 5, 30, 30]), (2, 1, 1, [0, 5, 30, 30]), (3, 1, 1, [5, 5, 3, 30]), (4, 2, 1, [5, 5, 30, 30]), (5, 1, 2, [5, 5, 30, 30]), (6, 1, 1, None))]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    got = {r.ann_id: r.verdict for r in annotations.coco_boxes(annotations.read_coco(spark, str(tmp_path / "c.json"))).collect()}
    assert got == {1: "ok", 2: "bad_bbox", 3: "too_small", 4: "load_fail", 6: "bad_bbox"}


def test_bundles_and_models(spark, sf, tmp_path):
    p = X.patches(spark, sf)
    bundles.write(p, str(tmp_path / "b"))
    bundles.write(p.where("split = 'val' and y = 1"), str(tmp_path / "b"))
    assert bundles.read(spark, str(tmp_path / "b"), "val").count() == p.where("split = 'val' and y = 1").count()
    assert bundles.read(spark, str(tmp_path / "b"), "train").count() == p.where("split = 'train'").count()
    with pytest.raises(ValueError):
        bundles.read(spark, str(tmp_path / "b"), required=("train_pos",))
    with pytest.raises(Exception, match="not 9 x 9"):
        bundles.check_resolution(p, 9).select(F.sum(F.size("px"))).collect()
    m = _model(spark)
    models.save(spark, str(tmp_path / "m"), m)
    assert models.load(spark, str(tmp_path / "m")).stages == m.stages
    assert models.load(spark, str(tmp_path / "m"), 2).stages == m.stages[:2]


def test_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text(XML)
    m = xml_cascade.read_cascade(spark, str(tmp_path / "c.xml"))
    assert (m.width, m.height, len(m.stages), m.stages[1].stumps[0].rects[1]) == (8, 8, 2, (3, 3, 2, 2, 9.0))
    with pytest.raises(ValueError):
        xml_cascade.parse_cascade(XML.replace("<rects>", "<tilted>1</tilted><rects>", 1))
    with pytest.raises(ValueError):
        xml_cascade.parse_cascade(XML.replace("0 -1 0 -0.01", "0 1 0 -0.01 -1 -2 1 0.5", 1))
