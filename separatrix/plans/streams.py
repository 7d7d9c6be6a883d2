"""Queries: the event table replayed as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from separatrix.operators.models import LinearModel
from separatrix.plans import fixtures as fx
from separatrix.plans.learning import STREAM_ETA, global_fold_sql, sample_fold_sql
from separatrix.plans.registry import query, rounded
from separatrix.storage import fresh_path
from separatrix.streaming import online

with_sql = fx.with_sql

SCORER = LinearModel(["x"], [-0.4, 1.25])


def _stream(spark, folder):
    # The star makes the path a glob: a table may be one file or a folder.
    events = online.read_stream(spark, f"{folder}/events.parquet*", fx.SCHEMAS["events"])
    return fx.as_samples(events)


@query("K1", global_fold_sql((0.0, 0.0)))
def online_model(spark, folder):
    """Weights of the global online model after the whole stream."""
    path = fresh_path(spark, "online-model")
    weights = online.WeightTable(spark, f"{path}/weights", 2)
    stream = _stream(spark, folder)
    run = online.learn_stream(stream, ["x"], "y", ["ts", "event_id"], STREAM_ETA, weights, f"{path}/state")
    run.awaitTermination()
    table = weights.read()
    last = table.agg(F.max("batch_id")).scalar()
    return rounded(table.filter(F.col("batch_id") == last).select("idx", "value"))


@query(
    "K2",
    with_sql(
        "samples",
        f"""WITH f AS (SELECT user_id, count(*) AS seen, {sample_fold_sql((0.0, 0.0))} AS m FROM samples GROUP BY user_id)
        SELECT user_id, seen, round(m.w0, 6) AS w0, round(m.w1, 6) AS w1 FROM f""",
    ),
)
def online_model_per_user(spark, folder):
    """Weights of every user's own online model after the whole stream."""
    path = fresh_path(spark, "online-users")
    table = online.KeyedWeights(spark, f"{path}/models", "user_id", "long")
    run = online.learn_keyed_state(
        _stream(spark, folder), "user_id", ["x"], "y", ["ts", "event_id"], STREAM_ETA, table, f"{path}/state"
    )
    run.awaitTermination()
    weights = [F.get("w", F.lit(j)).alias(f"w{j}") for j in range(2)]
    return rounded(online.newest(table).select("user_id", "seen", *weights))


@query(
    "K3",
    with_sql(
        "samples",
        """SELECT event_id, round(-0.4::DOUBLE + 1.25::DOUBLE * x, 6) + 0.0::DOUBLE AS score,
        CASE WHEN -0.4::DOUBLE + 1.25::DOUBLE * x >= 0 THEN 1 ELSE -1 END AS prediction FROM samples""",
    ),
)
def scored_stream(spark, folder):
    """Every event of the stream with its score and class."""
    path = fresh_path(spark, "scored-stream")
    scored = online.score_stream(_stream(spark, folder), SCORER).select("event_id", "score", "prediction")
    run = (
        scored.writeStream.format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    stored = spark.read.schema("event_id long, score double, prediction int").parquet(f"{path}/rows")
    return rounded(stored)
