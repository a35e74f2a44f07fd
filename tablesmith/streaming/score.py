"""Batch and stream scoring, inference logging, streaming A/B metrics.

Streams use Structured Streaming's file source with a fixed schema, a
checkpoint folder per query (under the cluster's shared checkpoint folder)
and append-only sinks, so a restarted query resumes where it stopped and a
replayed micro-batch rewrites the same output instead of duplicating it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablesmith.operators.abtest import ab_assign_sticky


def batch_score(spark: SparkSession, model_path: str, table: DataFrame, out_path: str,
                keep: Sequence[str] = (), model_version: str = "1", run_id: str | None = None) -> DataFrame:
    """B1: load a saved pipeline, score a table, append the predictions; returns this run's rows.

    Each run has a folder ``run_id=...`` of its own, written with overwrite: a retry under
    the same ``run_id`` (the default: a digest of the model's path and version) replaces its rows, and other runs stay.
    """
    from pyspark.ml import PipelineModel
    run_id = run_id or hashlib.md5(f"{model_path}|{model_version}".encode()).hexdigest()
    m = PipelineModel.load(model_path)
    scored = m.transform(table).select(*keep, F.col("prediction").cast("double").alias("prediction"),
                                       F.lit(model_version).alias("model_version"))
    folder = f"{out_path}/run_id={run_id}"
    scored.write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def udf_score(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], cols: Sequence[str],
              out: str = "prediction") -> DataFrame:
    """B2: a Python model as a column function over ``struct(*cols)``; Arrow
    batches go to the model, never one row at a time."""
    @F.pandas_udf("double")
    def score(batch: pd.DataFrame) -> pd.Series:
        return predict(batch).astype("float64")
    return df.withColumn(out, score(F.struct(*[F.col(c) for c in cols])))


def linear_score(coefficients: dict[str, float], intercept: float) -> Column:
    """B2, JVM-side path for a linear model: the score as a column expression."""
    expr = F.lit(float(intercept))
    for c, w in coefficients.items():
        expr = expr + F.col(c) * F.lit(float(w))
    return expr


def stream_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # only the declared columns (folder partition columns are not part of the record)
    return r.load(path).select(*[F.col(f"`{n}`") for n in schema.fieldNames()])


def stream_score(spark: SparkSession, model, source_path: str, schema: StructType, sink_path: str,
                 checkpoint: str, keep: Sequence[str] = (), available_now: bool = True):
    """Score arriving files with a fitted pipeline; parquet sink with checkpoint.

    ``available_now`` processes what is there and stops (tests, catch-up runs);
    otherwise the query keeps running and is returned.
    """
    src = stream_files(spark, source_path, schema)
    scored = model.transform(src).select(*keep, F.col("prediction").cast("double").alias("prediction"))
    w = scored.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        q.awaitTermination()
    return q


def once(stream: DataFrame, request_id: str | Sequence[str], ts: str, watermark: str) -> DataFrame:
    """Each request once: a repeat within the watermark of its first arrival is dropped (state goes with the watermark)."""
    ids = [request_id] if isinstance(request_id, str) else list(request_id)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(ids)


def late_rows(query) -> int:
    """Rows that the query's stateful operators have dropped as later than the watermark (of the progress it remembers)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def state_rows(query) -> int:
    """Rows in the state of the query's operators after its last batch."""
    last = query.lastProgress
    return sum(op["numRowsTotal"] for op in last["stateOperators"]) if last else 0


def end_stream(spark: SparkSession, source_path: str, schema: StructType, ts: str, at, folder: str = "") -> None:
    """Put an end mark into a stream's folder (its partition ``folder``, if it has such): a row with the time ``at``
    and nothing else.

    Time that has passed ``at`` less the watermark closes every window before it; the mark itself counts nowhere,
    as operators leave rows without a key out.  For replays that end; a live stream moves on by itself.
    """
    row = spark.range(1).select(*[F.lit(at if f.name == ts else None).cast(f.dataType).alias(f.name) for f in schema.fields])
    row.coalesce(1).write.mode("append").parquet(f"{source_path.rstrip('/')}/{folder}")


def inference_log(spark: SparkSession, model, source_path: str, schema: StructType, log_path: str,
                  checkpoint: str, keep: Sequence[str], model_version: str = "1", available_now: bool = True,
                  request_id: str | Sequence[str] | None = None, ts: str | None = None, watermark: str = "1 day"):
    """Keep every request with its prediction, model version, stream and batch id.

    With ``request_id`` (and event time ``ts``) a request that arrives again within the watermark is logged once.

    A micro-batch is known by (stream id, batch id).  The stream id is a digest of the stream's checkpoint folder
    and model version, so it is the same after a restart and differs between streams that share a log.
    Each batch goes to its own ``stream_id=.../batch_id=N`` folder with overwrite: a replayed batch (after a
    failure) replaces its output.  A new checkpoint is a new stream; it logs what it reads again.
    """
    stream_id = hashlib.md5(f"{checkpoint}|{model_version}".encode()).hexdigest()[:16]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = model.transform(batch).select(
            *keep, F.col("prediction").cast("double").alias("prediction"),
            F.lit(model_version).alias("model_version"), F.current_timestamp().alias("logged_at"))
        out.write.mode("overwrite").parquet(f"{log_path}/stream_id=s{stream_id}/batch_id={batch_id}")

    src = stream_files(spark, source_path, schema)
    if request_id is not None:
        src = once(src, request_id, ts, watermark)
    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        q.awaitTermination()
    return q


def ab_metrics_stream(spark: SparkSession, source_path: str, schema: StructType, sink_path: str,
                      checkpoint: str, ts: str, user_id: str, prediction: Column, truth: Column,
                      shares: dict, experiment: str, window: str = "1 day", watermark: str = "1 day",
                      available_now: bool = True, request_id: str | Sequence[str] | None = None):
    """Per variant and event-time window: n and accuracy.

    Event time is cast to ``timestamp`` before the watermark (a watermark on
    timestamp_ntz is refused).  Append mode emits a window once the watermark
    passes its end and forgets it, so the state holds the windows of the watermark's span alone; rows later than
    the watermark are dropped and counted (``late_rows``).  The last windows of a replay that ends are closed by
    ``end_stream``.  With ``request_id`` repeats count once.  Rows without a user count nowhere.
    """
    src = stream_files(spark, source_path, schema).withColumn(ts, F.col(ts).cast("timestamp"))
    late = once(src, request_id, ts, watermark) if request_id is not None else src.withWatermark(ts, watermark)
    # the condition names the event time, so that it stays above the watermark and end marks still move it
    late = late.where(F.col(user_id).isNotNull() | F.col(ts).isNull())
    assigned = ab_assign_sticky(late, user_id, shares, experiment)
    correct = (prediction == truth).cast("double")
    agg = (assigned.groupBy(F.window(ts, window).alias("w"), "variant")
           .agg(F.count(F.lit(1)).alias("n"), F.sum(correct).alias("n_correct"))
           .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "variant", "n",
                   (F.col("n_correct") / F.col("n")).alias("accuracy")))
    w = agg.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        q.awaitTermination()
    return q


def feedback_join_stream(spark: SparkSession, requests_path: str, requests_schema: StructType,
                         feedback_path: str, feedback_schema: StructType, sink_path: str, checkpoint: str,
                         key: str, request_ts: str, feedback_ts: str, max_delay: str = "1 day",
                         watermark: str = "1 day", available_now: bool = True):
    """B8 (join part): each logged request joined to its later feedback.

    A stream-stream inner join on the request key, bounded in time
    (``request_ts <= feedback_ts <= request_ts + max_delay``) so that both
    sides' state is dropped once the watermarks pass; append-only parquet sink.
    """
    req = stream_files(spark, requests_path, requests_schema) \
        .withColumn(request_ts, F.col(request_ts).cast("timestamp")).withWatermark(request_ts, watermark)
    fb = stream_files(spark, feedback_path, feedback_schema) \
        .withColumn(feedback_ts, F.col(feedback_ts).cast("timestamp")).withWatermark(feedback_ts, watermark) \
        .withColumnRenamed(key, f"_fb_{key}")
    cond = ((F.col(key) == F.col(f"_fb_{key}")) & (F.col(feedback_ts) >= F.col(request_ts))
            & (F.col(feedback_ts) <= F.col(request_ts) + F.expr(f"INTERVAL {max_delay}")))
    joined = req.join(fb, cond, "inner").drop(f"_fb_{key}")
    w = joined.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        q.awaitTermination()
    return q
