"""Golden values of integral images, rectangle sums and feature banks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stumpwright.functions.integral import integral_arrow, integral_long, integral_wide, region_sum
from stumpwright.operators import haar

IMAGE = [5, 2, 5, 2, 3, 6, 3, 6, 5, 2, 5, 2, 3, 6, 3, 6]
SUMS = [0, 0, 0, 0, 0, 0, 5, 7, 12, 14, 0, 8, 16, 24, 32, 0, 13, 23, 36, 46, 0, 16, 32, 48, 64]
SQUARES = [0, 0, 0, 0, 0, 0, 25, 29, 54, 58, 0, 34, 74, 108, 148, 0, 59, 103, 162, 206, 0, 68, 148, 216, 296]


def test_integral_images(spark):
    df = spark.createDataFrame([(1, IMAGE)], "patch_id long, px array<int>")
    row = df.select(integral_wide(F.col("px"), 4).alias("a"), integral_wide(F.col("px"), 4, 2).alias("b"), integral_arrow("px", F.lit(4)).alias("c")).first()
    assert row.a == SUMS and row.b == SQUARES and row.c == SUMS
    px = df.select("patch_id", F.posexplode("px").alias("i", "p")).select("patch_id", F.floor(F.col("i") / 4).cast("int").alias("r"), (F.col("i") % 4).alias("c"), "p")
    for power, want in ((1, SUMS), (2, SQUARES)):
        assert [r.v for r in integral_long(px, power).orderBy("r", "c").collect()] == want


@pytest.mark.parametrize("rect,ox,oy,want", [((0, 0, 1, 1), 0, 0, 5), ((0, 0, 2, 2), 0, 0, 16), ((0, 0, 3, 3), 0, 0, 36), ((1, 1, 1, 1), 0, 0, 6), ((1, 1, 2, 2), 0, 0, 16), ((0, 0, 1, 2), 0, 0, 8), ((0, 0, 2, 1), 0, 0, 7), ((0, 0, 1, 1), 1, 1, 6)])
def test_region_sums(spark, rect, ox, oy, want):
    df = spark.createDataFrame([(SUMS, rect)], "ii array<bigint>, rect struct<x:int,y:int,w:int,h:int>")
    assert df.select(region_sum(F.col("ii"), 4, F.col("rect"), 1.0, ox, oy)).first()[0] == want


@pytest.mark.parametrize("least,n", [(4, 31), (2, 753), (1, 2056)])
def test_bank_sizes(spark, least, n):
    assert haar.bank(spark, 8, 8, least, least).count() == n


@pytest.mark.parametrize("side,n", [(19, 17268), (24, 60153)])
def test_production_bank_sizes(spark, side, n):
    assert haar.bank(spark, side, side).count() == n


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6))
def test_integral_of_ones_is_area(spark, w, h):
    row = spark.createDataFrame([([1] * (w * h),)], "px array<int>").select(integral_wide(F.col("px"), w).alias("a")).first()
    assert row.a == np.outer(np.arange(h + 1), np.arange(w + 1)).ravel().tolist()
