import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(sf)):
        table = name.removesuffix(".parquet")
        path = f"{sf}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf}/{name}") else "")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    """A value in a form that both engines share."""
    import numpy as np

    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return ("num", v + 0.0)
    if isinstance(v, int) and not isinstance(v, bool):
        return ("num", float(v))
    return v


def same_rows(df, con, sql):
    names = sorted(df.columns)
    got = sorted((tuple(repr(plain(r[c])) for c in names) for r in df.collect()))
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    want = sorted(tuple(repr(plain(r[i])) for i in at) for r in cur.fetchall())
    assert got == want
