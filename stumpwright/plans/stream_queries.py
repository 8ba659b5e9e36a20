"""Queries that run a stream to its end, and a small training run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpwright import fixtures as X
from stumpwright.operators import cascade, metrics
from stumpwright.plans import duck as D
from stumpwright.plans import trainer
from stumpwright.plans.patch_queries import _model, r6
from stumpwright.plans.registry import query
from stumpwright.storage import shared_dir
from stumpwright.streaming import streams


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL".replace("date_trunc('day', ts)", "CAST(date_trunc('day', ts) AS TIMESTAMP)"))
def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows over the events as a stream."""
    out = streams.completed(streams.event_windows(streams.read_parquet_stream(spark, f"{sf}/events.parquet")))
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""WITH {D.SCORES} SELECT patch_id FROM (SELECT patch_id, row_number() OVER (ORDER BY o, patch_id) AS k FROM (
  SELECT patch_id, {D.order("patch_id", 11)} AS o, passed, row_number() OVER (ORDER BY {D.order("patch_id", 11)}, patch_id) AS rn FROM ver) WHERE rn <= 200 AND passed) WHERE k <= 70""")
def stream_mining(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted patches of a stream of embeddings, 70 at most of 200 scanned."""
    e = streams.read_parquet_stream(spark, f"{sf}/embeddings.parquet")
    p = e.select(F.col("vec_id").cast("bigint").alias("patch_id"), F.transform("embedding", X._pixel).alias("px"))
    return streams.mine_stream(p, _model(spark), 70, 200, 11).select("patch_id")


@query()
def train_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """A cascade trained on the training patches, judged on the test patches."""
    p = X.patches(spark, sf)
    t = p.where("split = 'train'")
    opts = trainer.Options(max_stages=2, max_stumps=4, layer_recall=0.95, target_negatives=150, mining_budget=400, least_side=2)
    model, _ = trainer.train(spark, t.where("y = 1"), t.where("y = 0"), shared_dir(spark), X.SIDE, X.SIDE, opts, p.where("split = 'val' and y = 1"))
    test = cascade.verdicts(cascade.stage_scores(p.where("split = 'test'"), model), model)
    return metrics.confusion(test).select("tp", "tn", "fp", "fn", *r6("recall", "specificity")).withColumn("stages", F.lit(len(model.stages)))
