"""Scalar geometry of boxes, ellipses and facial landmarks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the face-crop rule.
CENTER_SHIFT, EYE_MOUTH_TO_HEIGHT, MARGIN, MIN_EYE_MOUTH = 0.37, 2.63, 0.1, 5.0
# Fixed values of the frontal-face rule.
MIN_EYE_DISTANCE, MAX_ROLL, MAX_YAW = 8.0, 15.0, 0.20
# Fixed target eye positions in a 48 x 48 crop.
CLEAN_EYES, ALIGNED_EYES = ((15.0, 18.0), (33.0, 18.0)), ((12.0, 10.0), (36.0, 10.0))
# Fixed padding of a detection crop and the least side of a usable one.
CROP_PAD, MIN_CROP = 0.4, 32


def _sides(a: Column, b: Column, extra: float) -> tuple[Column, Column]:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + extra
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + extra
    return F.greatest(w, F.lit(0.0)), F.greatest(h, F.lit(0.0))


def _area(a: Column, extra: float) -> Column:
    return (a["x2"] - a["x1"] + extra) * (a["y2"] - a["y1"] + extra)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of continuous boxes (structs x1, y1, x2, y2); 0 without overlap."""
    w, h = _sides(a, b, 0.0)
    inter = w * h
    return F.when(inter > 0, inter / (_area(a, 0.0) + _area(b, 0.0) - inter)).otherwise(F.lit(0.0))


def pixel_overlaps(a: Column, b: Column) -> tuple[Column, Column]:
    """(IoU, intersection over the smaller area) of pixel boxes, whose sides are x2 - x1 + 1."""
    w, h = _sides(a, b, 1.0)
    inter, pa, pb = w * h, _area(a, 1.0), _area(b, 1.0)
    union, least = pa + pb - inter, F.least(pa, pb)
    return (
        F.when(union > 0, inter / union).otherwise(F.lit(0.0)),
        F.when(least > 0, inter / least).otherwise(F.lit(0.0)),
    )


def fuses(iou_: Column, iom: Column, metric: str = "hybrid", threshold: float = 0.3, iom_threshold: float = 0.7) -> Column:
    """Whether two boxes belong together; all comparisons are strict."""
    if metric == "iou":
        return iou_ > threshold
    if metric == "iom":
        return iom > threshold
    return (iou_ > threshold) | (iom > iom_threshold)


def ellipse_box(major: Column, minor: Column, angle: Column, cx: Column, cy: Column) -> Column:
    """The box around a rotated ellipse given by its half axes."""
    c, s = F.cos(angle), F.sin(angle)
    hw = F.sqrt(major * major * c * c + minor * minor * s * s)
    hh = F.sqrt(major * major * s * s + minor * minor * c * c)
    return F.struct((cx - hw).alias("x1"), (cy - hh).alias("y1"), (cx + hw).alias("x2"), (cy + hh).alias("y2"))


def _mid(a: Column, b: Column, axis: str) -> Column:
    return (a[axis] + b[axis]) / 2.0


def face_square(le: Column, re: Column, lm: Column, rm: Column) -> Column:
    """Centre and side of the face square from eyes and mouth corners; NULL for degenerate landmarks."""
    ex, ey, mx, my = _mid(le, re, "x"), _mid(le, re, "y"), _mid(lm, rm, "x"), _mid(lm, rm, "y")
    d = F.sqrt((mx - ex) * (mx - ex) + (my - ey) * (my - ey))
    cx = (ex + mx) / 2.0 + (ex - mx) * CENTER_SHIFT
    cy = (ey + my) / 2.0 + (ey - my) * CENTER_SHIFT
    return F.when(d >= MIN_EYE_MOUTH, F.struct(cx.alias("cx"), cy.alias("cy"), (d * EYE_MOUTH_TO_HEIGHT * (1.0 + MARGIN)).alias("side")))


def frontal_verdict(le: Column, re: Column, nose: Column) -> Column:
    """'tiny_eyes', 'roll_too_high', 'profile' or 'ok', the first that applies."""
    dx, dy = re["x"] - le["x"], re["y"] - le["y"]
    d = F.hypot(dx, dy)
    along = (dx * (nose["x"] - _mid(le, re, "x")) + dy * (nose["y"] - _mid(le, re, "y"))) / d
    return (
        F.when(d < MIN_EYE_DISTANCE, "tiny_eyes")
        .when(F.abs(F.degrees(F.atan2(dy, dx))) > MAX_ROLL, "roll_too_high")
        .when(F.abs(along) / d > MAX_YAW, "profile")
        .otherwise("ok")
    )


def similarity(le: Column, re: Column, eyes: tuple[tuple[float, float], tuple[float, float]]) -> Column:
    """The 2 x 3 similarity that maps two eyes onto targets: struct(a, b, tx, ty) of
    x' = a x - b y + tx, y' = b x + a y + ty; a + ib is the complex ratio of the eye vectors."""
    (ax, ay), (bx, by) = eyes
    sx, sy, dx, dy = re["x"] - le["x"], re["y"] - le["y"], bx - ax, by - ay
    n = sx * sx + sy * sy
    a, b = (sx * dx + sy * dy) / n, (sx * dy - sy * dx) / n
    t = F.struct(a.alias("a"), b.alias("b"), (ax - a * le["x"] + b * le["y"]).alias("tx"), (ay - b * le["x"] - a * le["y"]).alias("ty"))
    return F.when(n > 0, t)


def similarity_of(points: list[Column], targets: list[tuple[float, float]]) -> Column:
    """The 2 x 3 similarity that maps points (structs x, y) onto targets with the least squared error: struct(a, b,
    tx, ty) as in ``similarity``, which it equals for two points; NULL for points that all coincide."""
    n = float(len(points))
    mean = lambda axis: sum((p[axis] for p in points[1:]), points[0][axis]) / n
    mx, my, ux, uy = mean("x"), mean("y"), sum(x for x, _ in targets) / n, sum(y for _, y in targets) / n
    size, same, turned = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for p, (tx, ty) in zip(points, targets, strict=True):
        sx, sy, dx, dy = p["x"] - mx, p["y"] - my, tx - ux, ty - uy
        size, same, turned = size + sx * sx + sy * sy, same + sx * dx + sy * dy, turned + sx * dy - sy * dx
    a, b = same / size, turned / size
    return F.when(size > 0, F.struct(a.alias("a"), b.alias("b"), (ux - a * mx + b * my).alias("tx"), (uy - b * mx - a * my).alias("ty")))


def padded_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box padded by CROP_PAD of its size, truncated and clipped to the image; ok if both sides reach MIN_CROP."""
    x1 = F.greatest((x - w * CROP_PAD).cast("int"), F.lit(0))
    y1 = F.greatest((y - h * CROP_PAD).cast("int"), F.lit(0))
    x2 = F.least((x + w + w * CROP_PAD).cast("int"), width.cast("int"))
    y2 = F.least((y + h + h * CROP_PAD).cast("int"), height.cast("int"))
    ok = (x2 - x1 >= MIN_CROP) & (y2 - y1 >= MIN_CROP)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), ok.alias("ok"))


def reflected(i: Column, n: Column | int) -> Column:
    """Index i folded into 0..n-1 by reflection without repeating the edge, as often as needed."""
    size = n if isinstance(n, Column) else F.lit(n)
    k = F.pmod(i, F.greatest(2 * (size - 1), F.lit(1)))
    return F.when(k < size, k).otherwise(2 * (size - 1) - k)
