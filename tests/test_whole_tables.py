"""Queries over whole tables, against plain Python."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from stumpwright import fixtures as X
from stumpwright.operators import detect
from stumpwright.plans.all_queries import QUERIES
from stumpwright.plans.patch_queries import XML
from stumpwright.sources.xml_cascade import parse_cascade


def _brute(boxes):
    """Fused pairs, and the root of each box."""
    pairs, root = {}, {b.id: b.id for b in boxes}
    images = defaultdict(list)
    for b in sorted(boxes, key=lambda b: b.id):
        images[b.image_id].append(b)
    for own in images.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                inter = max(min(a.x2, b.x2) - max(a.x1, b.x1) + 1, 0) * max(min(a.y2, b.y2) - max(a.y1, b.y1) + 1, 0)
                pa, pb = ((c.x2 - c.x1 + 1) * (c.y2 - c.y1 + 1) for c in (a, b))
                iou, iom = inter / (pa + pb - inter), inter / min(pa, pb)
                if iou > 0.3 or iom > 0.7:
                    pairs[a.image_id, a.id, b.id] = (round(iou, 5), round(iom, 5))
    while True:
        moved = False
        for _, a, b in pairs:
            least = min(root[a], root[b])
            moved |= root[a] != least or root[b] != least
            root[a] = root[b] = least
        if not moved:
            return pairs, root


def test_suppression_over_all_boxes(spark, sf):
    boxes = X.boxes(spark, sf).collect()
    pairs, root = _brute(boxes)
    got = {(r.image_id, r.a, r.b): (round(r.iou, 5), round(r.iom, 5)) for r in QUERIES["nms_pairs"](spark, sf).collect()}
    assert got.keys() == pairs.keys() and all(abs(g - w) < 2e-5 for k in got for g, w in zip(got[k], pairs[k]))
    assert {r.id: r.root for r in QUERIES["nms_components"](spark, sf).collect()} == root
    groups = defaultdict(list)
    for b in boxes:
        groups[b.image_id, root[b.id]].append(b)
    greedy = {(r.image_id, r.root): r for r in QUERIES["nms_greedy"](spark, sf).collect()}
    weighted = {(r.image_id, r.root): r for r in QUERIES["nms_weighted"](spark, sf).collect()}
    assert greedy.keys() == weighted.keys() == groups.keys()
    for k, own in groups.items():
        best = max(own, key=lambda b: (b.score, -b.id))
        corners = ("x1", "y1", "x2", "y2")
        assert tuple(greedy[k][c] for c in corners) == tuple(int(best[c]) for c in corners) and greedy[k].n_boxes == weighted[k].n_boxes == len(own)
        total = sum(b.score for b in own)
        mean = [int(round(sum(b.score * b[c] for b in own) / total if total > 0 else sum(b[c] for b in own) / len(own), 9)) for c in corners]
        assert [weighted[k][c] for c in corners] == mean and abs(weighted[k].score - best.score) < 1e-5


def test_every_landmark_row_is_written_and_parsed(spark, sf):
    want = sorted((f"{r.id}.jpg", round(r.le.x, 3), round(r.le.y, 3), round(r.rm.y, 3)) for r in X.landmarks(spark, sf).collect())
    assert sorted(map(tuple, QUERIES["landmark_list"](spark, sf).collect())) == want


def test_images_hold_whole_documents(spark, sf):
    texts = {r.doc_id: r.text or "" for r in X.table(spark, sf, "documents").collect()}
    got = defaultdict(list)
    for r in X.text_images(spark, sf).orderBy("image_id").collect():
        assert len(r.px) == r.h * r.w and X.IMAGE_HEIGHT <= r.h <= X.IMAGE_MOST
        got[r.image_id // 1_000_000] += r.px
    for k, t in texts.items():
        assert got[k][: len(t)] == [ord(c) % 256 for c in t] and not any(got[k][len(t) :])


def _shrunk(a, h, w):
    """Triangle filter as wide as the shrink factor, pixel by pixel."""

    def row(n_in, n_out, i):
        f = n_in / n_out
        k = [max(1 - abs(j - ((i + 0.5) * f - 0.5)) / f, 0) for j in range(n_in)]
        return [x / sum(k) for x in k]

    if a.shape == (h, w):
        return a
    ys, xs = ([row(n, m, i) for i in range(m)] for n, m in zip(a.shape, (h, w)))
    return np.clip(np.floor(np.array(ys) @ a @ np.array(xs).T + 0.5), 0, 255).astype(np.int64)


def _all_levels(a, model):
    """Detections of one image, window by window, on every level."""
    (height, width), side, scale, out = a.shape, model.width, 1.0, []
    while int(side * scale) <= min(height, width):
        h, w = (max(side, round(n / scale)) for n in (height, width))
        small = _shrunk(a, h, w)
        for y in range(0, h - side + 1, 2):
            for x in range(0, w - side + 1, 2):
                win = small[y : y + side, x : x + side]
                norm = max(float(side * side * (win * win).sum() - win.sum() ** 2), 0.0) ** 0.5
                score = 0.0
                for stage in model.stages:
                    leaves = sum(s.left if sum(k * float(win[ry : ry + rh, rx : rx + rw].sum()) for rx, ry, rw, rh, k in s.rects) < s.threshold * max(norm, 1.0) else s.right for s in stage.stumps)
                    if leaves < stage.threshold:
                        break
                    score += leaves - stage.threshold
                else:
                    out.append((x * width / w, y * height / h, (x + side) * width / w, (y + side) * height / h, score))
        scale *= 1.25
    return out


def test_leaf_detections_on_every_level(spark, sf):
    model, key = parse_cascade(XML), lambda i, d: (i, *(round(float(v), 4) + 0.0 for v in d))
    images = X.text_images(spark, sf).orderBy("image_id").limit(12).collect()
    assert max(r.h for r in images) > 24
    some = {r.image_id for r in images}
    want = sorted(key(r.image_id, d) for r in images for d in _all_levels(np.array(r.px, np.int64).reshape(r.h, r.w), model))
    got = sorted(key(r.image_id, (r.x1, r.y1, r.x2, r.y2, r.score)) for r in QUERIES["xml_cascade_detect"](spark, sf).where(F.col("image_id").isin(some)).collect())
    assert got == want and any(d[3] - d[1] > 20 for d in got)
    a = np.random.default_rng(4).integers(0, 256, (27, 41))
    one = spark.createDataFrame([(1, 27, 41, a.ravel().tolist())], "image_id long, h int, w int, px array<int>")
    assert sorted(key(*(r[0], r[1:])) for r in map(tuple, detect.leaf_detections(one, model).collect())) == sorted(key(1, d) for d in _all_levels(a, model))
