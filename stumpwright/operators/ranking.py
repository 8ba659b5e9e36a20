"""Ranks and running sums over all rows of a table, without a task that sees them all.

Rows are dealt by ranges of the order and written; the ranges' totals, a row per partition, pass
through the driver, and each range is numbered by itself from what lies before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stumpwright.storage import kept

PART = "__part"


def dealt(rows: DataFrame, *order: Column) -> DataFrame:
    """rows by ranges of the order, with the range's number in PART; a table in the shared folder.

    The ranges' bounds come from a pass of their own, so rows are written first and computed once."""
    return kept(kept(rows).repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def ranked(parts: DataFrame, *order: Column, sums: tuple[str, ...] = ()) -> DataFrame:
    """parts (of ``dealt``) with rk from 1 and cum_<column> of each column in sums; the order has to be total."""
    totals = parts.groupBy(PART).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]).orderBy(PART).collect()
    before, rows = [0] * (1 + len(sums)), []
    for t in totals:
        rows.append((t[PART], *before))
        before = [a + (b or 0) for a, b in zip(before, (t["n"], *(t[c] for c in sums)))]
    names = ["__n", *(f"__{c}" for c in sums)]
    offsets = parts.sparkSession.createDataFrame(rows, ", ".join([f"{PART} int", *(f"{c} long" for c in names)]))
    w = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(offsets), PART)
    out = out.withColumn("rk", F.row_number().over(Window.partitionBy(PART).orderBy(*order)) + F.col("__n"))
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(w) + F.col(f"__{c}"))
    return out.drop(*names)


def largest_after(parts: DataFrame, value: str, order: Column) -> DataFrame:
    """parts with after: the largest value from the row on in the order, which has to agree with the ranges' numbers."""
    tops = parts.groupBy(PART).agg(F.max(value).alias("m")).orderBy(F.desc(PART)).collect()
    later, rows = None, []
    for t in tops:
        rows.append((t[PART], later))
        later = t["m"] if later is None else max(later, t["m"])
    offsets = parts.sparkSession.createDataFrame(rows, f"{PART} int, __later double")
    # a running maximum from the end: a frame that reaches forward is recomputed per row
    w = Window.partitionBy(PART).orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(F.broadcast(offsets), PART).withColumn("after", F.greatest(F.max(value).over(w), "__later")).drop("__later")


def quantiles(rows: DataFrame, value: str, wanted: dict[tuple, tuple[float, ...]], *groups: str) -> dict[tuple, list[float | None]]:
    """Exact linear quantiles of the value per group (a tuple of the groups' values). Two rows a quantile reach the driver."""
    rows = rows.where(F.col(value).isNotNull()).select(*groups, value, F.monotonically_increasing_id().alias("__row"))
    order = [F.col(c) for c in (*groups, value, "__row")]  # the row number lets equal values go to several ranges
    parts = dealt(rows, *order)
    sizes = {tuple(r[c] for c in groups): r["count"] for r in (parts.groupBy(*groups).count() if groups else parts.agg(F.count("*").alias("count"))).collect()}
    before, first = 0, {}
    for g in sorted(sizes):
        first[g], before = before, before + sizes[g]
    at = {g: [first[g] + q * (sizes[g] - 1) for q in qs] for g, qs in wanted.items() if sizes.get(g)}
    needed = sorted({k + 1 for xs in at.values() for x in xs for k in (math.floor(x), math.ceil(x))})
    got = {r.rk: float(r[value]) for r in ranked(parts, *order).where(F.col("rk").isin(needed)).select("rk", value).collect()} if needed else {}

    def one(x: float) -> float:
        lo, hi = got[math.floor(x) + 1], got[math.ceil(x) + 1]
        return lo + (hi - lo) * (x - math.floor(x))

    return {g: [one(x) for x in at[g]] if g in at else [None] * len(qs) for g, qs in wanted.items()}
