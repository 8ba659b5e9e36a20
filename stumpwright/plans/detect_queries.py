"""Queries over images and boxes: pyramids, windows, detection, suppression, evaluation, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright import fixtures as X
from stumpwright.functions import geometry as G
from stumpwright.operators import detect, evaluation, nms
from stumpwright.operators.haar import signed_cells
from stumpwright.plans import duck as D
from stumpwright.plans.patch_queries import XML, _model, r6
from stumpwright.plans.registry import query
from stumpwright.sources.xml_cascade import parse_cascade

_IMAGE = (X.IMAGE_WIDTH, X.IMAGE_HEIGHT)
_SCALES = """sca AS (
  WITH RECURSIVE g(level, scale) AS (SELECT 0, CAST(1.0 AS DOUBLE) UNION ALL SELECT level + 1, scale * 1.25 FROM g WHERE trunc(8 * scale * 1.25) <= {w})
  SELECT CAST(level AS INTEGER) AS level, scale, CAST(trunc(8 * scale) AS INTEGER) AS win_w, CAST(trunc(8 * scale) AS INTEGER) AS win_h, CAST(greatest(2, trunc(scale)) AS INTEGER) AS step FROM g)"""
_WIN = "win AS (SELECT image_id, level, scale, win_w, CAST(ox AS INTEGER) AS ox, CAST(oy AS INTEGER) AS oy FROM img, sca, unnest(range(0, 24 - win_w + 1, step)) AS a(ox), unnest(range(0, h - win_w + 1, step)) AS b(oy))"
_STD = "sqrt(greatest({b} / (win_w * win_w) - ({a} / (win_w * win_w)) * ({a} / (win_w * win_w)), 0))"
_WSTD = "greatest(" + _STD.format(a=D.rect("ii", "ox", "oy", "ox + win_w", "oy + win_w"), b=D.rect("ii2", "ox", "oy", "ox + win_w", "oy + win_w")) + ", 1.0)"


@query("WITH " + _SCALES.format(w=640) + " SELECT * FROM sca WHERE scale <= 200.0 / 8")
def pyramid_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Scales of an 8 x 8 window in a 640 x 640 image, faces up to 200."""
    return detect.scales(spark, (8, 8), (640, 640), max_face=200)


@query("WITH RECURSIVE g(level, scale) AS (SELECT 0, CAST(1.0 AS DOUBLE) UNION ALL SELECT level + 1, scale * 1.25 FROM g WHERE trunc(24 * scale * 1.25) <= 240) SELECT CAST(level AS INTEGER) AS level, round(scale, 6) AS scale, CAST(greatest(24, round_even(320 / scale, 0)) AS INTEGER) AS w, CAST(greatest(24, round_even(240 / scale, 0)) AS INTEGER) AS h FROM g")
def shrink_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    rows = detect.shrink_levels((320, 240), (24, 24))
    return spark.createDataFrame(rows, "level int, scale double, w int, h int").withColumn("scale", F.round("scale", 6))


@query(f"WITH {D.IMAGE}, {_SCALES.format(w=24)}, {_WIN} SELECT image_id, level, ox, oy FROM win")
def window_grid(spark: SparkSession, sf: str) -> DataFrame:
    images = X.text_images(spark, sf).select("image_id", "h", "w")
    return detect.window_grid(images, detect.scales(spark, (8, 8), _IMAGE)).select("image_id", "level", "ox", "oy")


@query(f"WITH {D.IMAGE_II}, {_SCALES.format(w=24)}, {_WIN} SELECT image_id, level, ox, oy, round({_WSTD}, 6) AS std FROM win JOIN iil USING (image_id)")
def window_std(spark: SparkSession, sf: str) -> DataFrame:
    return detect.window_stds_arrow(X.text_images(spark, sf), (8, 8)).select("image_id", "level", "ox", "oy", *r6("std"))


def _vote_sql(stage: int) -> str:
    own = [s for s in X.STUMPS if s[0] == stage]
    total = sum(s[10] for s in own)
    terms = []
    for _, _, _, kind, x, y, w, h, threshold, polarity, alpha in own:
        at = lambda v, o: f"{o} + CAST(trunc({v} * scale) AS INTEGER)"
        value = " + ".join(
            f"({sign}) * " + D.rect("ii", at(x + dx * w, "ox"), at(y + dy * h, "oy"), at(x + dx * w + w, "ox"), at(y + dy * h + h, "oy")) for dx, dy, sign in signed_cells(kind)
        )
        terms.append(f"CASE WHEN {polarity} * ({value}) < {polarity} * CAST({threshold!r} AS DOUBLE) * scale * scale * std THEN {alpha!r} ELSE 0 END")
    return f"CAST({' + '.join(terms)} AS DOUBLE) / CAST({total!r} AS DOUBLE)"


_T = [t for _, t in X.STAGES]


_DETECTED = f"""WITH {D.IMAGE_II}, {_SCALES.format(w=24)}, {_WIN}, ws AS (SELECT win.*, ii, {_WSTD} AS std FROM win JOIN iil USING (image_id)),
v AS (SELECT image_id, ox, oy, win_w, {_vote_sql(0)} AS a, {_vote_sql(1)} AS b, {_vote_sql(2)} AS c FROM ws)
SELECT image_id, ox AS x1, oy AS y1, ox + win_w AS x2, oy + win_w AS y2, round(a + b + c - {sum(_T)!r}, 6) AS score FROM v WHERE a >= {_T[0]} AND b >= {_T[1]} AND c >= {_T[2]}"""


@query(_DETECTED)
def detect_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The frozen cascade at every scale and place of the text images."""
    return detect.detections_arrow(X.text_images(spark, sf), _model(spark)).select("image_id", "x1", "y1", "x2", "y2", *r6("score"))


@query(f"SELECT * FROM ({_DETECTED}) WHERE score >= 0.75")
def detect_min_score(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of a score of at least 0.75; no score lies within rounding of it."""
    return detect.detections_arrow(X.text_images(spark, sf), _model(spark), min_score=0.75).select("image_id", "x1", "y1", "x2", "y2", *r6("score"))


@query()
def xml_cascade_detect(spark: SparkSession, sf: str) -> DataFrame:
    """The XML model on the text images at every level of the pyramid; the resizing is not SQL."""
    return detect.leaf_detections(X.text_images(spark, sf), parse_cascade(XML)).select("image_id", "x1", "y1", "x2", "y2", *r6("score"))


@query()
def mine_raw_images(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted crops from passes over the text images, 300 at most of 4000 tried."""
    from stumpwright.operators import mining

    return mining.mine_raw(X.text_images(spark, sf), _model(spark), X.IMAGE_WIDTH, 300, 4000, 2, 5)


def _nms_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return X.boxes(spark, sf).select("image_id", "id", "score", "x1", "y1", "x2", "y2")


_PAIR = f"""{D.BOX}, nb AS (SELECT * FROM box),
ov AS (SELECT a.image_id, a.id AS a, b.id AS b,
    greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1, 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1, 0) AS i,
    (a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) AS pa, (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) AS pb
  FROM nb AS a JOIN nb AS b ON a.image_id = b.image_id AND a.id < b.id),
pr AS (SELECT image_id, a, b, i / (pa + pb - i) AS iou, i / least(pa, pb) AS iom FROM ov WHERE i / (pa + pb - i) > 0.3 OR i / least(pa, pb) > 0.7)"""
_COMP = f"""WITH RECURSIVE {_PAIR}, ed AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr),
rc(id, root) AS (SELECT id, id FROM nb UNION SELECT ed.b, rc.root FROM rc JOIN ed ON ed.a = rc.id WHERE rc.root < ed.b),
co AS (SELECT nb.*, r.root FROM nb JOIN (SELECT id, min(root) AS root FROM rc GROUP BY id) AS r USING (id))"""


@query(f"WITH {_PAIR} SELECT image_id, a, b, iou, iom FROM pr")
def nms_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios of whole numbers, as they are: both engines divide alike, but round ties differently."""
    return nms.pairs(_nms_boxes(spark, sf)).select("image_id", "a", "b", "iou", "iom")


@query(f"{_COMP} SELECT image_id, id, root FROM co")
def nms_components(spark: SparkSession, sf: str) -> DataFrame:
    return nms.components(_nms_boxes(spark, sf)).select("image_id", "id", "root")


@query(f"""{_COMP} SELECT image_id, root, {", ".join(f"CAST(trunc(round(CASE WHEN sum(score) > 0 THEN sum(score * {c}) / sum(score) ELSE avg({c}) END, 9)) AS INTEGER) AS {c}" for c in ("x1", "y1", "x2", "y2"))},
round(max(score), 6) AS score, count(*) AS n_boxes FROM co GROUP BY image_id, root""")
def nms_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Corners are rounded at nine digits before truncation only to compare engines."""
    return nms.suppress(_nms_boxes(spark, sf), digits=9).select("image_id", "root", "x1", "y1", "x2", "y2", *r6("score"), "n_boxes")


@query(f"""{_COMP} SELECT image_id, root, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2, round(score, 6) AS score, count(*) OVER (PARTITION BY image_id, root) AS n_boxes
FROM co QUALIFY row_number() OVER (PARTITION BY image_id, root ORDER BY score DESC, id) = 1""")
def nms_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return nms.suppress(_nms_boxes(spark, sf), mode="greedy").select("image_id", "root", "x1", "y1", "x2", "y2", *r6("score"), "n_boxes")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = X.boxes(spark, sf)
    return b.where("side = 'det'"), b.where("side = 'gt'")


def _match_sql(t: float, s: str = "") -> str:
    """Pairs ov{s} at overlap t, greedy picks m{s}, flags fl{s}."""
    return f"""ov{s} AS (
  SELECT * FROM (SELECT d.image_id, d.id AS det_id, g.id AS gt_id, d.score,
      greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0) AS i,
      (d.x2 - d.x1) * (d.y2 - d.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS s
    FROM box AS d JOIN box AS g ON d.image_id = g.image_id AND d.side = 'det' AND g.side = 'gt') WHERE i / (s - i) >= {t}),
cd{s} AS (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rk, cands
  FROM (SELECT image_id, det_id, score, list(gt_id ORDER BY i / (s - i) DESC, gt_id DESC) AS cands FROM ov{s} GROUP BY ALL)),
m{s}(image_id, rk, det_id, gt_id, used) AS (
  SELECT DISTINCT image_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) FROM cd{s}
  UNION ALL
  SELECT c.image_id, c.rk, c.det_id, list_filter(c.cands, lambda x: NOT list_contains(m.used, x))[1],
         list_append(m.used, list_filter(c.cands, lambda x: NOT list_contains(m.used, x))[1])
  FROM m{s} AS m JOIN cd{s} AS c ON c.image_id = m.image_id AND c.rk = m.rk + 1),
fl{s} AS (SELECT d.image_id, d.id AS det_id, d.score, CASE WHEN m.gt_id IS NULL THEN 0 ELSE 1 END AS tp FROM box AS d LEFT JOIN m{s} AS m ON m.det_id = d.id AND m.image_id = d.image_id WHERE d.side = 'det'),
cv{s} AS (SELECT *, (SELECT count(*) FROM box WHERE side = 'gt') AS n_gt, row_number() OVER w AS rk, sum(tp) OVER w AS cum_tp FROM fl{s} WINDOW w AS (ORDER BY score DESC, image_id, det_id)),
en{s} AS (SELECT *, max(cum_tp / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM cv{s}),
su{s} AS (SELECT CAST({t} AS DOUBLE) AS iou_threshold, round(coalesce(sum(env / n_gt) FILTER (tp = 1), 0), 6) AS ap, round(sum(tp) / any_value(n_gt), 6) AS recall, round(sum(tp) / count(*), 6) AS precision,
  count(*) AS n_det, CAST(sum(tp) AS BIGINT) AS tp, CAST(count(*) - sum(tp) AS BIGINT) AS fp FROM en{s})"""


@query(f"""WITH {D.BOX} SELECT * FROM (SELECT d.image_id, d.id AS det_id, g.id AS gt_id, round(i / (s - i), 6) AS iou FROM box AS d JOIN box AS g ON d.image_id = g.image_id AND d.side = 'det' AND g.side = 'gt',
  LATERAL (SELECT greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0) AS i, (d.x2 - d.x1) * (d.y2 - d.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS s) WHERE i / (s - i) >= 0.3)""")
def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.overlaps(*_sides(spark, sf), 0.3).select("image_id", "det_id", "gt_id", *r6("iou"))


@query(f"WITH RECURSIVE {D.BOX}, {_match_sql(0.5)} SELECT image_id, det_id, gt_id FROM m WHERE gt_id IS NOT NULL")
def match_image(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.matched(*_sides(spark, sf), 0.5)


@query(f"WITH RECURSIVE {D.BOX}, {_match_sql(0.5)} SELECT ap, recall, precision, n_det, tp, fp FROM su")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    det, gt = _sides(spark, sf)
    return evaluation.summary(evaluation.flagged(det, gt, 0.5), gt.count()).select(*r6("ap", "recall", "precision"), "n_det", "tp", "fp")


@query(f"""WITH RECURSIVE {D.BOX}, {_match_sql(0.5)}, b(budget) AS (VALUES (50), (100), (284), (500), (1000))
SELECT budget, round(coalesce(arg_min(cum_tp / n_gt, rk) FILTER (rk - cum_tp > budget), max(cum_tp / n_gt)), 6) AS recall FROM b CROSS JOIN cv GROUP BY budget""")
def recall_at_fp(spark: SparkSession, sf: str) -> DataFrame:
    det, gt = _sides(spark, sf)
    return evaluation.recall_at_fp(evaluation.flagged(det, gt, 0.5), gt.count()).select("budget", *r6("recall"))


@query(f"WITH RECURSIVE {D.BOX}, {_match_sql(0.3, '3')}, {_match_sql(0.5, '5')} SELECT * FROM su3 UNION ALL SELECT * FROM su5")
def multi_iou_report(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.report(*_sides(spark, sf), (0.3, 0.5))
    return out.select("iou_threshold", *r6("ap", "recall", "precision"), "n_det", "tp", "fp")


@query(f"WITH {D.BOX} SELECT round(min(score), 6) AS least, round(list_sort(list(score))[count(*) // 2 + 1], 6) AS median, round(max(score), 6) AS most, count(*) AS n FROM box WHERE side = 'det' AND score IS NOT NULL")
def detection_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Least, upper median and greatest score; the median is one row of a sorted scan."""
    det = X.boxes(spark, sf).where("side = 'det' and score is not null").select("score")
    n = det.count()
    median = det.orderBy("score").offset(n // 2).limit(1).select(F.col("score").alias("median"))
    ends = det.agg(F.min("score").alias("least"), F.max("score").alias("most"), F.count("*").alias("n"))
    return ends.crossJoin(F.broadcast(median)).select(*r6("least", "median", "most"), "n")


_ANGLE = "CAST((h1 // 64) % 314 AS DOUBLE) / 100 - 1.57"


@query(f"""WITH {D.BOX}, e AS (SELECT id, size / 2 + 8 AS a, size / 2 AS b, {_ANGLE} AS t, x1 + size / 2 AS cx, y1 + size / 2 AS cy FROM box),
f AS (SELECT id, cx, cy, sqrt(a * a * cos(t) * cos(t) + b * b * sin(t) * sin(t)) AS hw, sqrt(a * a * sin(t) * sin(t) + b * b * cos(t) * cos(t)) AS hh FROM e)
SELECT id, round(cx - hw, 6) AS x1, round(cy - hh, 6) AS y1, round(cx + hw, 6) AS x2, round(cy + hh, 6) AS y2 FROM f""")
def ellipse_bbox(spark: SparkSession, sf: str) -> DataFrame:
    b = X.boxes(spark, sf)
    angle = (F.floor(F.col("h1") / 64).cast("bigint") % 314).cast("double") / 100 - 1.57
    half = F.col("size") / 2
    e = b.select("id", G.ellipse_box(half + 8, half, angle, F.col("x1") + half, F.col("y1") + half).alias("b"))
    return e.select("id", *[F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"""WITH {D.LANDMARK}, a AS (SELECT id, (lex + rex) / 2 AS ex, (ley + rey) / 2 AS ey, (lmx + rmx) / 2 AS mx, (lmy + rmy) / 2 AS my FROM lmk),
b AS (SELECT *, sqrt((mx - ex) * (mx - ex) + (my - ey) * (my - ey)) AS d FROM a)
SELECT id, round((ex + mx) / 2 + (ex - mx) * 0.37, 6) AS cx, round((ey + my) / 2 + (ey - my) * 0.37, 6) AS cy, round(d * 2.63 * 1.1, 6) AS side FROM b WHERE d >= 5""")
def face_bbox(spark: SparkSession, sf: str) -> DataFrame:
    m = X.landmarks(spark, sf).select("id", G.face_square(F.col("le"), F.col("re"), F.col("lm"), F.col("rm")).alias("s"))
    return m.where("s is not null").select("id", *[F.round(f"s.{c}", 6).alias(c) for c in ("cx", "cy", "side")])


_VERDICT = f"""{D.LANDMARK}, a AS (SELECT id, rex - lex AS dx, rey - ley AS dy, sqrt((rex - lex) ** 2 + (rey - ley) ** 2) AS d, nx - (lex + rex) / 2 AS px, ny - (ley + rey) / 2 AS py FROM lmk),
vd AS (SELECT id, CASE WHEN d < 8 THEN 'tiny_eyes' WHEN abs(degrees(atan2(dy, dx))) > 15 THEN 'roll_too_high' WHEN abs((dx * px + dy * py) / d) / d > 0.2 THEN 'profile' ELSE 'ok' END AS verdict FROM a)"""


@query(f"WITH {_VERDICT} SELECT id, verdict FROM vd")
def quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    return X.landmarks(spark, sf).select("id", G.frontal_verdict(F.col("le"), F.col("re"), F.col("nose")).alias("verdict"))


@query(f"WITH {_VERDICT} SELECT verdict, count(*) AS n FROM vd GROUP BY verdict")
def skip_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality_flags(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {D.LANDMARK}, a AS (SELECT id, lex, ley, rex - lex AS sx, rey - ley AS sy, (rex - lex) ** 2 + (rey - ley) ** 2 AS n FROM lmk),
b AS (SELECT id, lex, ley, 18 * sx / n AS ca, -18 * sy / n AS cb, 24 * sx / n AS aa, -24 * sy / n AS ab FROM a)
SELECT id, round(ca, 6) AS clean_a, round(cb, 6) AS clean_b, round(15 - ca * lex + cb * ley, 6) AS clean_tx, round(18 - cb * lex - ca * ley, 6) AS clean_ty,
  round(aa, 6) AS aligned_a, round(ab, 6) AS aligned_b, round(12 - aa * lex + ab * ley, 6) AS aligned_tx, round(10 - ab * lex - aa * ley, 6) AS aligned_ty FROM b""")
def similarity_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Both warps of a face in one row."""
    m = X.landmarks(spark, sf).select("id", G.similarity(F.col("le"), F.col("re"), G.CLEAN_EYES).alias("clean"), G.similarity(F.col("le"), F.col("re"), G.ALIGNED_EYES).alias("aligned"))
    return m.select("id", *[(F.round(f"{k}.{c}", 6) + 0.0).alias(f"{k}_{c}") for k in ("clean", "aligned") for c in ("a", "b", "tx", "ty")])


@query(f"""WITH {D.BOX}, c AS (SELECT id, CAST(greatest(trunc(x1 - size * 0.4), 0) AS INTEGER) AS cx1, CAST(greatest(trunc(y1 - size * 0.4), 0) AS INTEGER) AS cy1,
  CAST(least(trunc(x1 + size + size * 0.4), 160) AS INTEGER) AS cx2, CAST(least(trunc(y1 + size + size * 0.4), 120) AS INTEGER) AS cy2 FROM box)
SELECT id, cx1 AS x1, cy1 AS y1, cx2 AS x2, cy2 AS y2, cx2 - cx1 >= 32 AND cy2 - cy1 >= 32 AS ok FROM c""")
def padded_crop_box(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("size")
    b = X.boxes(spark, sf).select("id", G.padded_crop(F.col("x1"), F.col("y1"), s, s, F.lit(160), F.lit(120)).alias("c"))
    return b.select("id", "c.x1", "c.y1", "c.x2", "c.y2", "c.ok")


