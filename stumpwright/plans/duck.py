"""DuckDB definitions of the derived test inputs, independent of the Spark ones."""

from __future__ import annotations

from stumpwright.fixtures import STAGES, STUMPS

_M = 2147483648


def rows(data) -> str:
    return ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) for v in r) + ")" for r in data)


def chain(x: str, steps: int, seed: int = 0) -> str:
    out = f"(((({x}) % {_M} + {seed}) % {_M}) * 1103515245 + 12345) % {_M}"
    for _ in range(steps - 1):
        out = f"(({out}) * 69069 + 1) % {_M}"
    return f"({out})"


def order(x: str, seed: int = 0) -> str:
    return f"({chain(x, 3, seed)} // 64)"


PATCH = """patch AS (
  SELECT CAST(vec_id AS BIGINT) AS patch_id, CAST(label < 5 AS INTEGER) AS y,
         CASE vec_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, 'src' || (vec_id % 3) AS source,
         list_transform(embedding, lambda v: least(255, greatest(0, CAST(floor((CAST(v AS DOUBLE) + 0.6) * 212.5) AS INTEGER)))) AS px
  FROM embeddings),
px AS (SELECT patch_id, y, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c, px[i] AS p FROM patch, range(1, 65) AS g(i)),
pstd AS (SELECT patch_id, greatest(stddev_pop(p), 1.0) AS std FROM px GROUP BY patch_id)"""

CELLS = """cell(kind, dx, dy, sign) AS (VALUES ('2h', 0, 0, -1), ('2h', 1, 0, 1), ('2v', 0, 1, -1), ('2v', 0, 0, 1),
  ('3h', 0, 0, -1), ('3h', 2, 0, -1), ('3h', 1, 0, 1), ('3v', 0, 0, -1), ('3v', 0, 2, -1), ('3v', 0, 1, 1),
  ('4', 0, 0, -1), ('4', 1, 1, -1), ('4', 0, 1, 1), ('4', 1, 0, 1))"""


def bank(least: int, side: int = 8) -> str:
    return f"""{CELLS},
bank AS (
  SELECT CAST(row_number() OVER (ORDER BY w, h, x, y, k) - 1 AS INTEGER) AS feature_id, kind, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h
  FROM range({least}, {side + 1}) AS a(w), range({least}, {side + 1}) AS b(h), range(0, {side}) AS c(x), range(0, {side}) AS d(y),
       (VALUES (0, '2h', 2, 1), (1, '2v', 1, 2), (2, '3h', 3, 1), (3, '3v', 1, 3), (4, '4', 2, 2)) AS e(k, kind, cw, ch)
  WHERE x + w * cw <= {side} AND y + h * ch <= {side}),
frect AS (SELECT feature_id, x + dx * w AS rx, y + dy * h AS ry, w, h, sign FROM bank JOIN cell USING (kind))"""


#: Feature values by adding up pixels.
FVAL = """fval AS (
  SELECT patch_id, y, feature_id,
         CAST(sum(sign * list_sum(list_transform(range(ry, ry + h), lambda r: list_sum(px[r * 8 + rx + 1 : r * 8 + rx + w])))) AS BIGINT) AS val
  FROM patch, frect GROUP BY patch_id, y, feature_id)"""

MODEL = f"""stump(stage, t, feature_id, kind, x, y, w, h, threshold, polarity, alpha) AS (VALUES {rows(STUMPS)}),
stg(stage, threshold) AS (VALUES {rows(STAGES)})"""

SCORES = f"""{PATCH}, {CELLS}, {MODEL},
mval AS (
  SELECT patch_id, stage, t, CAST(sum(sign * list_sum(list_transform(range(s.y + dy * h, s.y + dy * h + h), lambda r: list_sum(px[r * 8 + x + dx * w + 1 : r * 8 + x + dx * w + w])))) AS DOUBLE) AS val
  FROM patch, stump AS s JOIN cell USING (kind) GROUP BY patch_id, stage, t),
sc AS (
  SELECT patch_id, p.y, split, source, stage, any_value(g.threshold) AS threshold,
         sum(CASE WHEN polarity * val < polarity * m.threshold * std THEN alpha ELSE 0 END) / sum(alpha) AS score
  FROM mval JOIN stump AS m USING (stage, t) JOIN stg AS g USING (stage) JOIN pstd USING (patch_id) JOIN patch AS p USING (patch_id)
  GROUP BY patch_id, p.y, split, source, stage),
ver AS (SELECT patch_id, y, split, source, sum(score - threshold) AS margin, bool_and(score >= threshold) AS passed FROM sc GROUP BY patch_id, y, split, source)"""

BOX = f"""box AS (
  SELECT CAST(user_id AS BIGINT) AS image_id, CAST(event_id AS BIGINT) AS id, CASE WHEN event_type = 'signup' THEN 'gt' ELSE 'det' END AS side, value AS score,
         x1, y1, x1 + size AS x2, y1 + size AS y2, h1, h2, h3, size
  FROM (SELECT *, CAST((h1 // 64) % 160 AS DOUBLE) AS x1, CAST((h2 // 64) % 120 AS DOUBLE) AS y1, CAST(24 + (h3 // 64) % 72 AS DOUBLE) AS size
        FROM (SELECT *, {chain("event_id", 1)} AS h1, {chain("event_id", 2)} AS h2, {chain("event_id", 3)} AS h3 FROM events)))"""

LANDMARK = f"""{BOX},
lmk AS (
  SELECT id, x1, y1, size, x1 + size * 0.375 AS lex, y1 + size * 0.375 + ((h1 // 128) % 17 - 8.0) AS ley,
         x1 + size * 0.625 AS rex, y1 + size * 0.375 + ((h2 // 128) % 17 - 8.0) AS rey,
         x1 + size * 0.5 + ((h3 // 128) % 15 - 7.0) AS nx, y1 + size * 0.5 AS ny,
         x1 + size * 0.375 + ((h1 // 128) % 5 - 2.0) AS lmx, y1 + size * 0.75 AS lmy,
         x1 + size * 0.625 AS rmx, y1 + size * 0.75 + ((h2 // 128) % 5 - 2.0) AS rmy
  FROM box)"""

IMAGE = """img AS (
  SELECT image_id, h, list_concat(list_transform(string_split(t, ''), lambda c: ascii(c) % 256), list_transform(range(length(t), h * 24), lambda i: 0)) AS px
  FROM (SELECT *, greatest(24, CAST(ceil(length(t) / 24.0) AS INTEGER)) AS h
        FROM (SELECT doc_id * 1000000 + k AS image_id, substring(text, CAST(k * 2304 + 1 AS BIGINT), 2304) AS t
              FROM documents, unnest(range(0, CAST(ceil(length(text) / 2304.0) AS BIGINT))) AS g(k))))"""

IMAGE_II = f"""{IMAGE},
ipx AS (SELECT image_id, (i - 1) // 24 AS r, (i - 1) % 24 AS c, CAST(px[i] AS BIGINT) AS p FROM img, unnest(range(1, h * 24 + 1)) AS g(i)),
irow AS (SELECT image_id, r, c, sum(p) OVER w AS a, sum(p * p) OVER w AS b FROM ipx WINDOW w AS (PARTITION BY image_id, r ORDER BY c)),
icell AS (
  SELECT image_id, r + 1 AS r, c + 1 AS c, CAST(sum(a) OVER w AS BIGINT) AS a, CAST(sum(b) OVER w AS BIGINT) AS b FROM irow WINDOW w AS (PARTITION BY image_id, c ORDER BY r)
  UNION ALL SELECT image_id, 0, c, 0, 0 FROM img, range(0, 25) AS g(c)
  UNION ALL SELECT image_id, r, 0, 0, 0 FROM img, unnest(range(1, h + 1)) AS g(r)),
iil AS (SELECT image_id, list(a ORDER BY r, c) AS ii, list(b ORDER BY r, c) AS ii2 FROM icell GROUP BY image_id)"""


def rect(ii: str, x1: str, y1: str, x2: str, y2: str, width: int = 25) -> str:
    at = lambda x, y: f"{ii}[({y}) * {width} + ({x}) + 1]"
    return f"({at(x2, y2)} - {at(x2, y1)} - {at(x1, y2)} + {at(x1, y1)})"


def rounded(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
