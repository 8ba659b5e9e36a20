"""Results that hang on the last bit of a double, against the SQL of the query."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import same_rows
from stumpwright.functions.integral import sample_std, sample_stds
from stumpwright.plans.all_queries import ORACLE, QUERIES


def _patches(folder, px):
    """A table of embeddings that give these pixels, and a connection to it."""
    n = len(px)
    kinds = {"vec_id": pa.int64(), "label": pa.int32(), "embedding": pa.list_(pa.float32())}
    data = {"vec_id": list(range(n)), "label": [i % 10 for i in range(n)], "embedding": ((px + 0.5) / 212.5 - 0.6).tolist()}
    pq.write_table(pa.table({c: pa.array(data[c], k) for c, k in kinds.items()}), f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return con


def test_equal_ratios_of_value_and_deviation_sort_as_in_the_sql(spark, tmp_path):
    px = np.random.default_rng(3).integers(0, 256, (400, 64))
    px[200:] = px[:200, ::-1] // 2 * 2  # values and deviations that often have equal ratios
    px[300:] = px[200:300].reshape(100, 8, 8).transpose(0, 2, 1).reshape(100, 64)
    con = _patches(tmp_path, px)
    same_rows(QUERIES["sort_index"](spark, str(tmp_path)), con, ORACLE["sort_index"])


def test_both_forms_of_the_deviation_are_one(spark):
    px = np.random.default_rng(4).integers(0, 256, (50, 30))
    df = spark.createDataFrame([(p.tolist(),) for p in px] + [([7] * 30,), ([1, None],), (None,)], "px array<int>")
    got = [r[0] for r in df.coalesce(1).select(sample_std(F.col("px"))).collect()]
    assert got == [*sample_stds(px.T).tolist(), 1.0, 1.0, 1.0]


def test_halves_of_resized_pixels_round_as_in_the_sql(spark, tmp_path):
    con = _patches(tmp_path, np.random.default_rng(5).integers(0, 4, (4000, 64)) * 64)
    same_rows(QUERIES["bicubic_resize"](spark, str(tmp_path)), con, ORACLE["bicubic_resize"])
