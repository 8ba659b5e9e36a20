"""Queries over dataset preparation, annotations, counts and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright import fixtures as X
from stumpwright.functions.arithmetic import sample_order
from stumpwright.operators import dataset
from stumpwright.plans import duck as D
from stumpwright.plans import prepare
from stumpwright.plans.patch_queries import r6
from stumpwright.plans.registry import query
from stumpwright.sources import annotations, datasets, images, models
from stumpwright.storage import shared_dir

_POS = "pos AS (SELECT * FROM patch WHERE y = 1)"
_VAL = f"va AS (SELECT patch_id FROM pos ORDER BY {D.order('patch_id', 1)}, patch_id LIMIT 40)"


@query(f"""WITH {D.PATCH}, {_POS}, {_VAL} SELECT patch_id, CASE WHEN patch_id IN (SELECT patch_id FROM va) THEN 'val' ELSE 'train' END AS role FROM pos""")
def val_split_no_leak(spark: SparkSession, sf: str) -> DataFrame:
    val, rest = dataset.hold_out(X.patches(spark, sf).where("y = 1").select("patch_id"), 40, "patch_id", 1)
    return val.withColumn("role", F.lit("val")).unionByName(rest.withColumn("role", F.lit("train")))


@query(f"""WITH {D.PATCH}, n AS (SELECT patch_id FROM patch WHERE y = 0 AND source = 'src1' ORDER BY {D.order('patch_id', 2)}, patch_id LIMIT 60)
SELECT patch_id, 1 AS label, 'src0' AS source FROM patch WHERE y = 1 AND source = 'src0' UNION ALL SELECT patch_id, 0, 'src1' FROM n""")
def train_union(spark: SparkSession, sf: str) -> DataFrame:
    p = X.patches(spark, sf)
    pos = p.where("y = 1 and source = 'src0'").select("patch_id", F.lit(1).alias("label"), "source")
    neg = dataset.sample(p.where("y = 0 and source = 'src1'"), 60, "patch_id", 2).select("patch_id", F.lit(0).alias("label"), "source")
    return pos.unionByName(neg)


@query(f"""WITH {D.PATCH} SELECT patch_id, CASE WHEN y = 1 THEN 'test_pos' ELSE 'test_neg' END AS bundle FROM patch WHERE split = 'test' AND coalesce(nullif(source, 'src2'), 'src0') = 'src0'""")
def test_split_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows of the benchmark source; rows without a source count as it."""
    p = X.patches(spark, sf).withColumn("source", F.nullif("source", F.lit("src2")))
    t = p.where((F.col("split") == "test") & (F.coalesce("source", F.lit("src0")) == "src0"))
    return t.select("patch_id", F.when(F.col("y") == 1, "test_pos").otherwise("test_neg").alias("bundle"))


def _crop_sql(x: str, y: str, side: int, width: int = 24) -> str:
    return f"flatten(list_transform(range(0, {side}), lambda r: px[({y} + r) * {width} + {x} + 1 : ({y} + r) * {width} + {x} + {side}]))"


_OFF = lambda s: f"CAST({D.order('image_id', 5 + s)} % 5 AS INTEGER)"


@query(f"""WITH {D.IMAGE}, v AS (SELECT image_id, px, 0 AS variant, 2 AS ox, 2 AS oy FROM img UNION ALL SELECT image_id, px, 1, {_OFF(0)}, {_OFF(1)} FROM img),
c AS (SELECT image_id, variant, ox, oy, {_crop_sql('ox', 'oy', 20)} AS k FROM v)
SELECT image_id, variant, ox, oy, CAST(list_sum(k) AS BIGINT) AS total, CAST(k[1] AS INTEGER) AS first, CAST(k[400] AS INTEGER) AS last FROM c""")
def jitter_crops(spark: SparkSession, sf: str) -> DataFrame:
    c = dataset.jitter_crops(X.text_images(spark, sf), "image_id", X.IMAGE_WIDTH, 20, 2, 5)
    total = F.aggregate("px", F.lit(0).cast("bigint"), lambda a, p: a + p)
    return c.select("image_id", "variant", "ox", "oy", total.alias("total"), F.element_at("px", 1).alias("first"), F.element_at("px", -1).alias("last"))


@query(f"WITH {D.PATCH} SELECT patch_id, 0 AS flipped, px FROM patch UNION ALL SELECT patch_id, 1, flatten(list_transform(range(0, 8), lambda r: list_reverse(px[r * 8 + 1 : r * 8 + 8]))) FROM patch")
def hflip(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.augmented(X.patches(spark, sf), X.SIDE).select("patch_id", "flipped", "px")


_SLOT = "(image_id * 1009 + pass * 31 + k)"


@query(f"""WITH {D.IMAGE}, n AS (SELECT CAST(ceil(1000.0 / (count(*) * 3)) AS BIGINT) AS passes FROM img)
SELECT image_id, CAST(pass AS INTEGER) AS pass, CAST(k AS INTEGER) AS k, CAST({D.order(_SLOT, 9)} % 13 AS INTEGER) AS ox, CAST({D.order(_SLOT, 10)} % (h - 11) AS INTEGER) AS oy
FROM img, n, unnest(range(0, passes)) AS a(pass), range(0, 3) AS b(k) ORDER BY pass, {D.order('image_id', 9)}, image_id, k LIMIT 1000""")
def random_crops(spark: SparkSession, sf: str) -> DataFrame:
    """Crops of 12 x 12, three an image and pass, until there are 1000."""
    images_ = X.text_images(spark, sf).select("image_id", "w", "h")
    return dataset.random_crops(images_, "image_id", 12, 3, 1000, 9)


@query(f"""WITH {D.IMAGE}, o AS (SELECT image_id, px, h, CAST(image_id % 31 - 6 AS INTEGER) AS x, CAST(image_id % 29 - 5 AS INTEGER) AS y FROM img),
c AS (SELECT image_id, x, y, list_transform(range(0, 64), lambda k: px[(h - 1 - abs(h - 1 - (((y + k // 8) % (2 * h - 2) + 2 * h - 2) % (2 * h - 2)))) * 24 + (23 - abs(23 - (((x + k % 8) % 46 + 46) % 46))) + 1]) AS k FROM o)
SELECT image_id, x, y, k AS px FROM c""")
def reflect_crop(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 crops that may stick out of the image."""
    i = X.text_images(spark, sf).select("image_id", "px", "h", (F.col("image_id") % 31 - 6).cast("int").alias("x"), (F.col("image_id") % 29 - 5).cast("int").alias("y"))
    return i.select("image_id", "x", "y", dataset.reflect_crop(F.col("px"), X.IMAGE_WIDTH, F.col("h"), F.col("x"), F.col("y"), 8).alias("px"))


@query(f"WITH {D.PATCH} SELECT coalesce(split, 'all') AS split, coalesce(source, 'all') AS source, coalesce(CAST(y AS VARCHAR), 'all') AS y, count(*) AS n FROM patch GROUP BY ROLLUP (patch.split, patch.source, patch.y)")
def split_counts_rollup(spark: SparkSession, sf: str) -> DataFrame:
    c = dataset.counts(X.patches(spark, sf), "split", "source", "y")
    return c.select(*[F.coalesce(F.col(k).cast("string"), F.lit("all")).alias(k) for k in ("split", "source", "y")], "n")


@query("SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS seq FROM documents QUALIFY seq < 7")
def folder_cap(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.capped(X.table(spark, sf, "documents").select("source", "doc_id"), "source", ["doc_id"], 7).select("source", "doc_id", F.col("seq").cast("int").alias("seq"))


@query(f"WITH {D.PATCH}, t AS (SELECT patch_id, row_number() OVER (ORDER BY {D.order('patch_id', 4)}, patch_id) - 1 AS i FROM patch QUALIFY i < 60) SELECT patch_id, CAST(i // 10 AS INTEGER) AS row, CAST(i % 10 AS INTEGER) AS col, CAST(4 + (i % 10) * 52 AS INTEGER) AS x, CAST(4 + (i // 10) * 52 AS INTEGER) AS y FROM t")
def grid_layout(spark: SparkSession, sf: str) -> DataFrame:
    """A mosaic of 60 sampled patches, ten a row."""
    s = dataset.sample(X.patches(spark, sf).select("patch_id"), 60, "patch_id", 4)
    return dataset.grid_layout(s, [sample_order(F.col("patch_id"), 4), "patch_id"], 10, 48, 4).select("patch_id", "row", "col", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


@query(f"WITH {D.PATCH} SELECT r, c, round(avg(p), 6) AS mean FROM px WHERE y = 1 GROUP BY r, c")
def mean_image(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.mean_image(X.patch_pixels(X.patches(spark, sf)).where("y = 1")).select("r", "c", *r6("mean"))


_K0, _K1 = dataset.BLUR
_TAPS = f"t(d, k) AS (VALUES (-1, CAST({_K0!r} AS DOUBLE)), (0, CAST({_K1!r} AS DOUBLE)), (1, CAST({_K0!r} AS DOUBLE)))"
_FOLD = lambda x, n: f"({n - 1} - abs({n - 1} - ((({x}) % {2 * n - 2} + {2 * n - 2}) % {2 * n - 2})))"


@query(f"""WITH {D.PATCH}, {_TAPS}, mi AS (SELECT r, c, avg(p) AS m FROM px WHERE y = 1 GROUP BY r, c),
up AS (SELECT o.r, o.c, round(sum(i.m * a.k * b.k), 9) AS v FROM mi AS o, t AS a, t AS b JOIN mi AS i ON i.r < 5 WHERE o.r < 5 AND i.r = {_FOLD('o.r + a.d', 5)} AND i.c = {_FOLD('o.c + b.d', 8)} GROUP BY o.r, o.c),
e1 AS (SELECT r, c FROM up ORDER BY v, r, c LIMIT 1),
e2 AS (SELECT up.r, up.c FROM up, e1 WHERE abs(up.c - e1.c) >= 2 ORDER BY v, up.r, up.c LIMIT 1),
ee AS (SELECT r, c FROM e1 UNION ALL SELECT r, c FROM e2),
tp AS (SELECT CAST(trunc(avg(r) + 2) AS INTEGER) AS top FROM ee),
lo AS (SELECT o.r, o.c, round(sum(i.m * a.k * b.k), 9) AS v FROM tp, mi AS o, t AS a, t AS b, mi AS i WHERE o.r >= top AND i.r >= top
  AND i.r - top = (7 - top) - abs((7 - top) - (((o.r - top + a.d) % greatest(1, 2 * (7 - top)) + greatest(1, 2 * (7 - top))) % greatest(1, 2 * (7 - top)))) AND i.c = {_FOLD('o.c + b.d', 8)} GROUP BY o.r, o.c)
SELECT 'left_eye' AS part, r, c FROM (SELECT * FROM ee ORDER BY c LIMIT 1) UNION ALL SELECT 'right_eye', r, c FROM (SELECT * FROM ee ORDER BY c DESC LIMIT 1)
UNION ALL SELECT 'mouth', r, c FROM (SELECT r, c FROM lo WHERE c >= 2 AND c < 5 ORDER BY v, r, c LIMIT 1)""")
def mean_face_parts(spark: SparkSession, sf: str) -> DataFrame:
    m = dataset.mean_image(X.patch_pixels(X.patches(spark, sf)).where("y = 1"))
    return dataset.eyes_and_mouth(m, X.SIDE, X.SIDE)


@query(f"WITH {D.PATCH} SELECT source, split, count(DISTINCT patch_id) AS n, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std FROM px JOIN (SELECT patch_id, source, split FROM patch) USING (patch_id) GROUP BY source, split")
def pixel_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, pixel means and deviations by source and split, from per-patch sums."""
    return dataset.pixel_stats(X.patches(spark, sf), "source", "split").select("source", "split", "n", *r6("mean", "std"))


@query(f"WITH {D.IMAGE} SELECT image_id, count(*) AS n, sum(CAST(floor((299 * r + 587 * g + 114 * b) / 1000) AS BIGINT)) AS gray FROM (SELECT image_id, px[i * 3 + 1] AS r, px[i * 3 + 2] AS g, px[i * 3 + 3] AS b FROM img, unnest(range(0, h * 8)) AS t(i)) GROUP BY image_id".replace("sum(CAST", "CAST(sum(CAST").replace("AS gray", "AS BIGINT) AS gray").replace("AS BIGINT)) AS BIGINT", "AS BIGINT)) AS BIGINT"))
def luma_gray(spark: SparkSession, sf: str) -> DataFrame:
    """Text images read as interleaved RGB and turned to gray."""
    g = X.text_images(spark, sf).select("image_id", images.gray(F.col("px")).alias("g"))
    return g.select("image_id", F.size("g").cast("bigint").alias("n"), F.aggregate("g", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("gray"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 1 THEN 'face' ELSE 'other' END AS category FROM events")
def json_annotations(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("j"))
    return e.select("event_id", F.col("j.k").alias("k"), F.when(F.col("j.k") % 10 == 1, "face").otherwise("other").alias("category"))


@query("SELECT category, count(*) AS n FROM (SELECT lang || CASE doc_id % 5 WHEN 0 THEN '-Faces' WHEN 1 THEN '-people' WHEN 2 THEN '-humans' ELSE '-car' END AS category FROM documents) WHERE category NOT ILIKE '%face%' AND category NOT ILIKE '%people%' AND category NOT ILIKE '%human%' GROUP BY category")
def category_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 5
    category = F.concat("lang", F.when(k == 0, "-Faces").when(k == 1, "-people").when(k == 2, "-humans").otherwise("-car"))
    d = X.table(spark, sf, "documents").select(category.alias("category"))
    return d.where(dataset.excludes_keywords(F.col("category"))).groupBy("category").agg(F.count("*").alias("n"))


_ANN = f"""{D.BOX}, an AS (SELECT id, image_id, CAST(h1 % 3 AS INTEGER) AS category_id, CASE WHEN h2 % 11 = 0 THEN NULL ELSE [x1, y1, size - CASE WHEN h3 % 5 = 0 THEN 20 ELSE 0 END, size] END AS bbox FROM box),
im AS (SELECT DISTINCT image_id, 'img' || image_id || '.jpg' AS file_name FROM box WHERE image_id % 9 <> 0),
vd AS (SELECT id AS ann_id, an.image_id, file_name, bbox, CASE WHEN bbox IS NULL OR list_contains(bbox, 0.0) THEN 'bad_bbox' WHEN least(bbox[3], bbox[4]) < 24 THEN 'too_small' WHEN file_name IS NULL THEN 'load_fail' ELSE 'ok' END AS verdict
  FROM an LEFT JOIN im ON an.image_id = im.image_id WHERE category_id = 1)"""


def _coco(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation documents in the JSON format's shape, one per image, as the reader gives them."""
    b = X.boxes(spark, sf)
    box = F.when(F.col("h2") % 11 != 0, F.array("x1", "y1", F.col("size") - F.when(F.col("h3") % 5 == 0, 20).otherwise(0), "size"))
    ann = F.struct("id", "image_id", (F.col("h1") % 3).cast("int").alias("category_id"), box.alias("bbox"))
    g = b.groupBy("image_id").agg(F.collect_list(ann).alias("annotations"))
    file = F.struct(F.col("image_id").alias("id"), F.concat(F.lit("img"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"))
    return g.select(F.when(F.col("image_id") % 9 != 0, F.array(file)).otherwise(F.array().cast("array<struct<id:bigint,file_name:string>>")).alias("images"), "annotations")


@query(f"WITH {_ANN} SELECT ann_id, image_id, file_name, verdict FROM vd")
def annotation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.coco_boxes(_coco(spark, sf)).select("ann_id", "image_id", "file_name", "verdict")


@query(f"WITH {_ANN} SELECT verdict, count(*) AS n FROM vd GROUP BY verdict")
def annotation_skips(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.coco_boxes(_coco(spark, sf)).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {D.BOX}, e AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY id) - 1 AS gt_id, size / 2 + 8 AS a, size / 2 AS b, 0.5 AS t, x1 AS cx, y1 AS cy FROM box WHERE side = 'gt')
SELECT 'img' || image_id AS image, CAST(gt_id AS INTEGER) AS gt_id, round(cx - sqrt(a * a * cos(t) * cos(t) + b * b * sin(t) * sin(t)), 6) AS x1, round(cy + sqrt(a * a * sin(t) * sin(t) + b * b * cos(t) * cos(t)), 6) AS y2 FROM e""")
def ellipse_list(spark: SparkSession, sf: str) -> DataFrame:
    """Ellipse lists written as text, a fold per ten images, and parsed again."""
    g = X.boxes(spark, sf).where("side = 'gt'")
    line = F.concat_ws(" ", F.col("size") / 2 + 8, F.col("size") / 2, F.lit(0.5), F.col("x1"), F.col("y1"), F.lit(" 1"))
    blocks = g.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]).alias("ls"))
    text = F.concat(F.lit("img"), F.col("image_id").cast("string"), F.lit("\n"), F.size("ls").cast("string"), F.lit("\n"), F.array_join("ls", "\n"), F.lit("\n"))
    folds = blocks.groupBy(F.floor(F.col("image_id") / 10).alias("fold")).agg(F.array_join(F.collect_list(text), "").alias("value"))
    return annotations.ellipses(folds).select("image", "gt_id", *r6("x1", "y2"))


@query(f"WITH {D.LANDMARK} SELECT id || '.jpg' AS file, round(lex, 3) AS lex, round(ley, 3) AS ley, round(rmy, 3) AS rmy FROM lmk")
def landmark_list(spark: SparkSession, sf: str) -> DataFrame:
    """Landmark lists written as text, parsed again."""
    m = X.landmarks(spark, sf)
    line = F.concat_ws("  ", F.concat(F.col("id").cast("string"), F.lit(".jpg")), *[F.col(f"{p}.{a}") for p in ("le", "re", "nose", "lm", "rm") for a in ("x", "y")])
    lists = m.groupBy((F.col("id") % 16).alias("k")).agg(F.concat(F.lit("n\nheader\n"), F.array_join(F.collect_list(line), "\n")).alias("value"))
    p = annotations.landmarks(lists)
    return p.select("file", F.round("left_eye.x", 3).alias("lex"), F.round("left_eye.y", 3).alias("ley"), F.round("right_mouth.y", 3).alias("rmy"))


@query(f"WITH {D.PATCH} SELECT patch_id, source, 'a' AS part FROM patch WHERE source <> 'src1' AND EXISTS (SELECT 1 FROM patch WHERE source = 'src1')")
def drop_source(spark: SparkSession, sf: str) -> DataFrame:
    """A table rewritten without one source; where the source is absent nothing is written."""
    path, new = shared_dir(spark), shared_dir(spark)
    X.patches(spark, sf).select("patch_id", "source").write.parquet(path)
    if not datasets.without_source(spark, path, new, "src1"):
        return spark.createDataFrame([], "patch_id long, source string, part string")
    return spark.read.parquet(new).select("patch_id", "source", F.lit("a").alias("part"))


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def distinct_sources(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))


@query("SELECT source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std FROM documents GROUP BY source, lang")
def source_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.value_stats(X.table(spark, sf, "documents"), "n_chars", "source", "lang").select("source", "lang", "n", *r6("mean", "std"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'jpg' WHEN doc_id % 3 = 1 THEN 'png' ELSE 'bin' END AS ext FROM documents")
def magic_sniff(spark: SparkSession, sf: str) -> DataFrame:
    """File types by leading bytes, of contents made from documents."""
    k = F.col("doc_id") % 3
    head = F.when(k == 0, F.unhex(F.lit("FFD8FFE0"))).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("00")))
    d = X.table(spark, sf, "documents").select("doc_id", F.concat(head, F.to_binary("text", F.lit("utf-8"))).alias("content"))
    return d.select("doc_id", images.extension(F.col("content")).alias("ext"))


@query("SELECT user_id % 7 AS run, arg_max('weights_' || event_id || '.parquet', (ts, event_id)) AS path FROM events GROUP BY user_id % 7")
def latest_model(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events").select((F.col("user_id") % 7).alias("run"), F.concat(F.lit("weights_"), F.col("event_id").cast("string"), F.lit(".parquet")).alias("path"), "ts", "event_id")
    return models.latest(e, "run", F.struct("ts", "event_id"))


@query(f"WITH {D.PATCH} SELECT patch_id, CAST(list_sum(px) AS BIGINT) AS clean, CAST(list_sum(flatten(list_transform(range(0, 8), lambda r: list_reverse(px[r * 8 + 1 : r * 8 + 8])))[1:32]) AS BIGINT) AS aligned FROM patch")
def paired_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Two forms of a patch in one row, so no join by position is needed."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    p = X.patches(spark, sf)
    return p.select("patch_id", total("px").alias("clean"), total(F.slice(dataset.hflip(F.col("px"), X.SIDE), 1, 32)).alias("aligned"))


@query("SELECT doc_id, length(text) >= 576 AS usable FROM documents")
def patch_too_small(spark: SparkSession, sf: str) -> DataFrame:
    """Documents too short for an image are told apart before any decoding."""
    return X.table(spark, sf, "documents").select("doc_id", (F.length("text") >= X.IMAGE_WIDTH * X.IMAGE_HEIGHT).alias("usable"))


@query("SELECT CASE WHEN doc_id % 4 = 0 THEN 'v_' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS file_name FROM documents")
def merged_splits(spark: SparkSession, sf: str) -> DataFrame:
    d = X.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file_name"))
    return annotations.merged_splits(d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0")).select("file_name")


_FACES = f"""{D.PATCH}, fc AS (SELECT patch_id AS id, CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS split, source, y FROM patch),
va AS (SELECT id FROM fc WHERE split = 'train' AND y = 1 AND source = 'src0' ORDER BY {D.order('id', 42)}, id LIMIT 30),
tr AS (SELECT id FROM fc WHERE split = 'train' AND y = 1 AND source IN ('src0', 'src1') AND id NOT IN (SELECT id FROM va)
       QUALIFY row_number() OVER (PARTITION BY source ORDER BY {D.order('id', 42)}, id) <= 40)"""


@query(f"""WITH {_FACES}
SELECT 'val_pos' AS split, id FROM va UNION ALL SELECT 'train_pos', id FROM tr, range(0, 4) UNION ALL
SELECT 'neg_seed', id FROM fc, range(0, 2) WHERE split = 'train' AND y = 0 AND source = 'src0' UNION ALL
SELECT 'caltech_pool', id FROM (SELECT id FROM fc WHERE y = 0 AND source = 'src2' ORDER BY {D.order('id', 42)}, id LIMIT 50) UNION ALL
SELECT CASE WHEN y = 1 THEN 'test_pos' ELSE 'test_neg' END, id FROM fc WHERE split = 'test' AND source = 'src0'""")
def prepare_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """A whole bundle: 6 x 6 patches, jitter 1, mirror images, mixed negatives."""
    p = X.patches(spark, sf)
    split = F.when(F.col("split") == "test", "test").otherwise("train")
    faces = p.select(F.col("patch_id").alias("id"), split.alias("split"), "source", F.col("y").alias("label"), "px")
    pool = p.where("y = 0 and source = 'src2'").select(F.col("patch_id").alias("id"), dataset.crop(F.col("px"), X.SIDE, F.lit(1), F.lit(1), 6, 6).alias("px"))
    plan = prepare.Plan(("src0", "src1"), "src0", 40, 30, "mixed", 50, jitter=1)
    return prepare.prepare(faces, pool, plan, 6).select("split", "id")


@query(f"WITH {D.PATCH} SELECT split, count(*) AS n, CAST(sum(len(px)) AS BIGINT) AS pixels, 8 AS resolution FROM patch GROUP BY split")
def bundle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of a bundle written by split and read back."""
    from stumpwright.sources import bundles

    return bundles.roundtrip_manifest(X.patches(spark, sf), X.SIDE)


