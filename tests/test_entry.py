"""The driver's contract."""

import __spark_entry__ as entry


def test_registry(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90 and all(callable(f) for f in q.values())
    assert {"confusion_metrics", "detect_windows", "nms_weighted", "train_cascade"} <= set(q)
    df = entry.entry(spark)
    assert df.count() == 1 and df.columns[:4] == ["tp", "tn", "fp", "fn"]
