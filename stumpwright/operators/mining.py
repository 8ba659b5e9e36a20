"""Hard-negative mining: what a cascade still accepts, under a target and a scan budget."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpwright.functions.arithmetic import chain, sample_order
from stumpwright.operators.cascade import Cascade, accepted
from stumpwright.operators.dataset import crop
from stumpwright.storage import kept


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by the order's columns, where they are: the n-th row's values come from a top-k of
    these columns alone, and then bound a filter. The order has to be total."""
    last = rows.select(*order).orderBy(*order).limit(n).agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("m")).first()
    if last.n < n:
        return rows
    kinds = [rows.schema[c].dataType for c in order]
    return rows.where(F.struct(*order) <= F.struct(*[F.lit(last.m[c]).cast(k).alias(c) for c, k in zip(order, kinds)]))


def mine(pool: DataFrame, model: Cascade, target: int, budget: int, seed: int = 0) -> DataFrame:
    """The first ``target`` accepted patches among the first ``budget`` of the pool in a hashed order.

    The scanned part is a filter on (hash, patch_id), so the cascade runs on it where it lies; only
    accepted patches take part in the last top-k.
    """
    if target <= 0 or budget <= 0:
        return pool.limit(0)
    h = "__order"
    scanned = first_rows(pool.withColumn(h, sample_order(F.col("patch_id"), seed)), budget, h, "patch_id")
    return accepted(scanned, model).orderBy(h, "patch_id").limit(target).drop(h)


def mine_all(pool: DataFrame, model: Cascade) -> DataFrame:
    """Every patch of the pool that the cascade accepts; a narrow plan."""
    return accepted(pool, model)


def mine_stratified(pool: DataFrame, model: Cascade, target: int, budget: int, seed_pool: DataFrame | None = None, reserve: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Half of the target from seed_pool, the rest and any shortfall from pool, what is then missing
    from reserve. A column ``pool`` names the origin. Counts of the parts are small jobs between."""
    parts: list[DataFrame] = []
    have = 0

    def take(source: DataFrame, name: str, want: int, scan: int) -> None:
        nonlocal have
        if want > 0 and scan > 0:
            part = mine(source, model, want, scan, seed).withColumn("pool", F.lit(name))
            part = kept(part)
            have += part.count()
            parts.append(part)

    main_target, main_budget = target, budget
    n_seed = seed_pool.count() if seed_pool is not None else 0
    if n_seed:
        want = target // 2
        # the seed pool is scanned once at most; the allowance for two scans is what the main pool loses
        scan = min(budget // 2, 2 * n_seed)
        take(seed_pool, "seed", want, min(scan, n_seed))
        main_target, main_budget = target - have, budget - scan
    take(pool, "main", main_target, main_budget)
    if reserve is not None and have < target:
        take(reserve, "reserve", target - have, reserve.count())
    if not parts:
        return pool.limit(0).withColumn("pool", F.lit(""))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mine_raw(images: DataFrame, model: Cascade, width: int, target: int, budget: int, per_image: int, seed: int = 0) -> DataFrame:
    """Accepted crops from passes over images, fresh places each pass, until target or budget.

    images: image_id, px, h, w, all of one width. Passes run in growing batches, each one job over
    the images; the crops count in the order (pass, hashed image, crop), so batching changes nothing.
    Returns image_id, pass, k, ox, oy, px.
    """
    side = model.width
    big = images.where((F.col("w") >= side) & (F.col("h") >= side)).select("image_id", "px", "w", "h")
    per_pass = big.count() * per_image
    if not per_pass or target <= 0 or budget <= 0:
        return _raw_crops(big, width, side, per_image, seed, 0, 0).limit(0)
    last, first, have, parts = math.ceil(budget / per_pass), 0, 0, []
    size = 1
    while first < last and have < target:
        stop = min(last, first + size)
        crops = _raw_crops(big, width, side, per_image, seed, first, stop - 1)
        order = ["pass", sample_order(F.col("image_id"), seed), "image_id", "k"]
        left = budget - first * per_pass
        if left < (stop - first) * per_pass:
            crops = first_rows(crops.withColumn("__order", order[1]), left, "pass", "__order", "image_id", "k").drop("__order")
        part = kept(accepted(crops.withColumn("patch_id", F.col("image_id")), model).orderBy(*order).limit(target - have).drop("patch_id"))
        have += part.count()
        parts.append(part)
        first, size = stop, size * 2
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _raw_crops(images: DataFrame, width: int, side: int, per_image: int, seed: int, first: int, last: int) -> DataFrame:
    """A crop per image, pass first..last and k; places are hashes of (image, pass, k)."""
    c = images.withColumn("pass", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_image - 1))))
    slot = F.col("image_id") * 1009 + F.col("pass") * 31 + F.col("k")
    place = lambda s, span: (F.floor(chain(slot, 3, seed + s) / 64) % (span - side + 1)).cast("int")
    c = c.withColumn("ox", place(0, F.col("w"))).withColumn("oy", place(1, F.col("h")))
    return c.select("image_id", "pass", "k", "ox", "oy", crop(F.col("px"), width, F.col("ox"), F.col("oy"), side, side).alias("px"))
