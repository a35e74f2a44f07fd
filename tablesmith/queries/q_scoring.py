"""Queries: scoring, A/B assignment and metrics, streams."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablesmith.functions.columns import round_half_away, sql_hash_bucket
from tablesmith.operators import abtest as AB
from tablesmith.queries import register
from tablesmith.queries import sql_models as Q
from tablesmith.queries.common import T, scratch_path
from tablesmith.streaming import score as SC

# fixed values: traffic shares of the experiments
SHARES_90_10 = {"A": 90, "B": 10}
SHARES_70_30 = {"control": 70, "treatment": 30}


def _value_model(events):
    """A small pipeline predicting an event's value from its type and user."""
    return Pipeline(stages=[StringIndexer(inputCol="event_type", outputCol="type_idx"),
                            VectorAssembler(inputCols=["type_idx", "user_id"], outputCol="features"),
                            LinearRegression(featuresCol="features", labelCol="value", maxIter=20)]).fit(events)


def _event_files(spark, sf):
    """Events rewritten as one folder per day: the arriving files of a stream (a busy day in several files)."""
    e = T(spark, sf, "events")
    path = scratch_path(spark, "events-stream")
    e.withColumn("day", F.to_date("ts")).write.option("maxRecordsPerFile", 1_000_000).partitionBy("day").parquet(path)
    return path, e.schema


#: The least-squares model of ``_value_model`` in SQL; ``scored`` has the events with their prediction.
_SCORED_SQL = f"""WITH n AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS i FROM events GROUP BY event_type),
e AS (SELECT events.*, n.i::DOUBLE AS f_0, user_id::DOUBLE AS f_1 FROM events JOIN n USING (event_type)),
{Q.ridge_ctes("e", ["f_0", "f_1"], "value")},
scored AS (SELECT *, round({Q.linear(["f_0", "f_1"], "ls")}, 4) AS prediction FROM e, ls)"""


def _scored(df, *keys):
    return df.select(*keys, round_half_away("prediction", 4).alias("prediction"))


@register("batch_score", _SCORED_SQL + " SELECT event_id, '1' AS model_version, prediction FROM scored")
def q_batch_score(spark, sf):
    """Scored twice into one folder, as after a retry: every event is there once."""
    e = T(spark, sf, "events")
    m = _value_model(e)
    mpath = scratch_path(spark, "model")
    m.write().overwrite().save(mpath)
    out = scratch_path(spark, "scored")
    SC.batch_score(spark, mpath, e, out, keep=["event_id"])
    SC.batch_score(spark, mpath, e, out, keep=["event_id"])
    return _scored(spark.read.parquet(out), "event_id", "model_version")


@register("udf_score", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem)
        + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity, 4) AS prediction
FROM lineitem""")
def q_udf_score(spark, sf):
    """A least-squares price model applied as a pandas UDF over struct(l_quantity)."""
    li = T(spark, sf, "lineitem")
    r = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"),
               F.regr_intercept("l_extendedprice", "l_quantity").alias("a")).collect()[0]
    a, b = float(r["a"]), float(r["b"])

    def predict(batch):
        return a + b * batch["l_quantity"]
    out = SC.udf_score(li, predict, ["l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      round_half_away("prediction", 4).alias("prediction"))


@register("stream_score", _SCORED_SQL + " SELECT event_id, ts, prediction FROM scored")
def q_stream_score(spark, sf):
    path, schema = _event_files(spark, sf)
    m = _value_model(T(spark, sf, "events"))
    sink = scratch_path(spark, "stream-scored")
    SC.stream_score(spark, m, path, schema, sink, scratch_path(spark, "ckpt"), keep=["event_id", "ts"])
    return _scored(spark.read.parquet(sink), "event_id", "ts")


@register("inference_log", _SCORED_SQL + """
SELECT event_id, user_id, v AS model_version, prediction FROM scored, (VALUES ('7'), ('8')) t(v)""")
def q_inference_log(spark, sf):
    """Two streams (champion and challenger) log the same requests into one table."""
    path, schema = _event_files(spark, sf)
    m = _value_model(T(spark, sf, "events"))
    log = scratch_path(spark, "inference-log")
    for version in ("7", "8"):
        SC.inference_log(spark, m, path, schema, log, scratch_path(spark, "ckpt"), keep=["event_id", "user_id"],
                         model_version=version)
    return _scored(spark.read.parquet(log), "event_id", "user_id", "model_version")


@register("ab_assign_random", f"""
SELECT event_id, CASE WHEN {sql_hash_bucket(['event_id'], 100, 'ab')} < 90 THEN 'A' ELSE 'B' END AS variant
FROM events""")
def q_ab_random(spark, sf):
    return AB.ab_assign_random(T(spark, sf, "events").select("event_id"), "event_id", SHARES_90_10, salt="ab")


@register("ab_assign_sticky", f"""
SELECT event_id, user_id,
  CASE WHEN {sql_hash_bucket(['user_id'], 100, 'checkout:')} < 70 THEN 'control' ELSE 'treatment' END AS variant
FROM events""")
def q_ab_sticky(spark, sf):
    return AB.ab_assign_sticky(T(spark, sf, "events").select("event_id", "user_id"), "user_id", SHARES_70_30,
                               "checkout")


def _feedback(spark, sf):
    e = AB.ab_assign_sticky(T(spark, sf, "events"), "user_id", SHARES_70_30, "checkout")
    return e.select("variant", (F.col("value") > 10).cast("int").alias("prediction"),
                    (F.col("event_type") == "purchase").cast("int").alias("ground_truth"))


_FEEDBACK_SQL = f"""(SELECT CASE WHEN {sql_hash_bucket(['user_id'], 100, 'checkout:')} < 70 THEN 'control'
  ELSE 'treatment' END AS variant, CAST(value > 10 AS INTEGER) AS prediction,
  CAST(event_type = 'purchase' AS INTEGER) AS ground_truth FROM events)"""


@register("ab_metrics", f"""
WITH p AS (SELECT variant, count(*) AS n, avg(CAST(prediction = ground_truth AS DOUBLE)) AS accuracy,
                  avg(CAST(prediction AS DOUBLE)) AS mean_prediction FROM {_FEEDBACK_SQL} f GROUP BY variant),
c AS (SELECT n AS n0, accuracy AS p0 FROM p WHERE variant = 'control')
SELECT variant, n, round(accuracy, 6) AS accuracy, round(mean_prediction, 6) AS mean_prediction,
  round(accuracy - p0, 6) AS diff_vs_control,
  round(sqrt(accuracy * (1 - accuracy) / n + p0 * (1 - p0) / n0), 6) AS se_vs_control FROM p, c""")
def q_ab_metrics(spark, sf):
    m = AB.ab_metrics(_feedback(spark, sf), control="control")
    return m.withColumns({c: round_half_away(c, 6) for c in
                          ("accuracy", "mean_prediction", "diff_vs_control", "se_vs_control")})


_SCORED_FEEDBACK_SQL = _FEEDBACK_SQL.replace("FROM events", ", value FROM events")


@register("ab_evaluate", f"""
WITH f AS (SELECT * FROM {_SCORED_FEEDBACK_SQL} q),
k AS (SELECT variant, c, sum(CAST(ground_truth = c AS INTEGER)) AS s, sum(CAST(prediction = c AS INTEGER)) AS p,
        sum(CAST(ground_truth = c AND prediction = c AS INTEGER)) AS t FROM f, (VALUES (0), (1)) v(c) GROUP BY 1, 2),
w AS (SELECT variant, sum(t) / sum(s) AS accuracy, sum(CASE WHEN s + p > 0 THEN 2.0 * t / (s + p) ELSE 0 END * s) / sum(s) AS weighted_f1,
        sum(s)::BIGINT AS n FROM k GROUP BY 1),
e AS (SELECT variant, sqrt(avg((ground_truth - prediction) ^ 2)) AS rmse, avg(abs(ground_truth - prediction)) AS mae,
        1 - sum((ground_truth - prediction) ^ 2) / (var_pop(ground_truth) * count(*)) AS r2 FROM f GROUP BY 1),
r AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY value)
        + (count(*) OVER (PARTITION BY variant, value) - 1) / 2.0 AS rk FROM f),
a AS (SELECT variant, count(*) FILTER (ground_truth = 1) AS n_pos, count(*) FILTER (ground_truth <> 1) AS n_neg,
        sum(rk) FILTER (ground_truth = 1) AS sr FROM r GROUP BY 1)
SELECT variant, round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS weighted_f1, n, round(rmse, 6) AS rmse,
  round(mae, 6) AS mae, round(r2, 6) AS r2, round((sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) AS auc, n_pos, n_neg
FROM w JOIN e USING (variant) JOIN a USING (variant)""")
def q_ab_evaluate(spark, sf):
    """Per variant: F1, RMSE and AUC of the event value as a score."""
    e = AB.ab_assign_sticky(T(spark, sf, "events"), "user_id", SHARES_70_30, "checkout")
    f = e.select("variant", "value", (F.col("value") > 10).cast("int").alias("prediction"),
                 (F.col("event_type") == "purchase").cast("int").alias("ground_truth"))
    m = AB.ab_evaluate(f, score="value")
    return m.withColumns({c: round_half_away(c, 6) for c in ("accuracy", "weighted_f1", "rmse", "mae", "r2", "auc")})


@register("ab_metrics_stream", f"""
WITH f AS (SELECT ts, CASE WHEN {sql_hash_bucket(['user_id'], 100, 'checkout:')} < 70 THEN 'control' ELSE 'treatment' END AS variant,
  CAST(CAST(value > 10 AS INTEGER) = CAST(event_type = 'purchase' AS INTEGER) AS DOUBLE) AS correct FROM events)
SELECT CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS day, variant, count(*) AS n, round(avg(correct), 6) AS accuracy
FROM f GROUP BY 1, 2""")
def q_ab_metrics_stream(spark, sf):
    """Daily windows per variant over the whole replay; an end mark closes the last ones."""
    path, schema = _event_files(spark, sf)
    sink, checkpoint = scratch_path(spark, "ab-stream"), scratch_path(spark, "ckpt")
    last = T(spark, sf, "events").agg(F.max("ts")).first()[0]
    for end in (False, True):
        if end:
            SC.end_stream(spark, path, schema, "ts", last + dt.timedelta(days=3), f"day={last:%Y-%m-%d}")
        SC.ab_metrics_stream(spark, path, schema, sink, checkpoint, "ts", "user_id",
                             (F.col("value") > 10).cast("int"), (F.col("event_type") == "purchase").cast("int"),
                             SHARES_70_30, "checkout", window="1 day", request_id="event_id")
    day = F.date_format("window_start", "yyyy-MM-dd")
    return spark.read.parquet(sink).select(day.alias("day"), "variant", "n", round_half_away("accuracy", 6).alias("accuracy"))


@register("ab_metrics_stream_open", f"""
WITH f AS (SELECT ts, CASE WHEN {sql_hash_bucket(['user_id'], 100, 'checkout:')} < 70 THEN 'control' ELSE 'treatment' END AS variant,
  CAST(CAST(value > 10 AS INTEGER) = CAST(event_type = 'purchase' AS INTEGER) AS DOUBLE) AS correct FROM events)
SELECT CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS day, variant, count(*) AS n, round(avg(correct), 6) AS accuracy
FROM f GROUP BY 1, 2 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)""")
def q_ab_metrics_stream_open(spark, sf):
    """The same as an endless stream: a window appears once the watermark (a day behind the latest event) has passed it."""
    path, schema = _event_files(spark, sf)
    sink = scratch_path(spark, "ab-stream")
    SC.ab_metrics_stream(spark, path, schema, sink, scratch_path(spark, "ckpt"), "ts", "user_id",
                         (F.col("value") > 10).cast("int"), (F.col("event_type") == "purchase").cast("int"),
                         SHARES_70_30, "checkout", window="1 day", watermark="1 day")
    day = F.date_format("window_start", "yyyy-MM-dd")
    return spark.read.parquet(sink).select(day.alias("day"), "variant", "n", round_half_away("accuracy", 6).alias("accuracy"))


@register("inference_log_once", _SCORED_SQL + " SELECT event_id, user_id, '7' AS model_version, prediction FROM scored")
def q_inference_log_once(spark, sf):
    """Every request is sent twice, the second time an hour later in event time; the log has it once."""
    e = T(spark, sf, "events")
    path = scratch_path(spark, "events-twice")
    for later in (0, 1):
        e.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {later} HOUR")).write.mode("append").parquet(path)
    log = scratch_path(spark, "inference-log")
    SC.inference_log(spark, _value_model(e), path, e.schema, log, scratch_path(spark, "ckpt"), keep=["event_id", "user_id"],
                     model_version="7", request_id="event_id", ts="ts")
    return _scored(spark.read.parquet(log), "event_id", "user_id", "model_version")


@register("force_variant", f"""
SELECT event_id, coalesce(CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 10 THEN 'B' END,
  CASE WHEN {sql_hash_bucket(['event_id'], 100, 'ab')} < 90 THEN 'A' ELSE 'B' END) AS variant FROM events""")
def q_force_variant(spark, sf):
    e = AB.ab_assign_random(T(spark, sf, "events").select("event_id", "props"), "event_id", SHARES_90_10, salt="ab")
    requested = F.when(F.get_json_object("props", "$.k").cast("int") < 10, F.lit("B"))
    return AB.force_variant(e, requested).select("event_id", "variant")


_AB_METRICS_SQL = f"""
WITH p AS (SELECT variant, count(*) AS n, avg(CAST(prediction = ground_truth AS DOUBLE)) AS accuracy,
                  avg(CAST(prediction AS DOUBLE)) AS mean_prediction FROM {_FEEDBACK_SQL} f GROUP BY variant),
c AS (SELECT n AS n0, accuracy AS p0 FROM p WHERE variant = 'control')
SELECT variant, n, round(accuracy, 6) AS accuracy, round(mean_prediction, 6) AS mean_prediction,
  round(accuracy - p0, 6) AS diff_vs_control,
  round(sqrt(accuracy * (1 - accuracy) / n + p0 * (1 - p0) / n0), 6) AS se_vs_control FROM p, c"""


@register("feedback_join_stream", _AB_METRICS_SQL)
def q_feedback_join_stream(spark, sf):
    """Logged predictions (request stream) joined to ground truth arriving one
    hour later (feedback stream), then accuracy per variant from the joined rows:
    every request finds its feedback, so the result is B7's on all events."""
    e = AB.ab_assign_sticky(T(spark, sf, "events"), "user_id", SHARES_70_30, "checkout")
    req = e.select("event_id", "ts", "variant", (F.col("value") > 10).cast("int").alias("prediction"))
    fb = e.select("event_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("feedback_ts"),
                  (F.col("event_type") == "purchase").cast("int").alias("ground_truth"))
    rpath, fpath = scratch_path(spark, "requests"), scratch_path(spark, "feedback")
    req.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(rpath)
    fb.withColumn("day", F.to_date("feedback_ts")).write.partitionBy("day").parquet(fpath)
    sink = scratch_path(spark, "joined")
    SC.feedback_join_stream(spark, rpath, req.schema, fpath, fb.schema, sink, scratch_path(spark, "ckpt"),
                            "event_id", "ts", "feedback_ts", max_delay="1 day", watermark="1 day")
    m = AB.ab_metrics(spark.read.parquet(sink), control="control")
    return m.withColumns({c: round_half_away(c, 6) for c in
                          ("accuracy", "mean_prediction", "diff_vs_control", "se_vs_control")})


@register("linear_score", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem)
        + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity, 4) AS prediction
FROM lineitem""")
def q_linear_score(spark, sf):
    """B2, JVM-side path: the same least-squares model as a column expression."""
    li = T(spark, sf, "lineitem")
    r = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"),
               F.regr_intercept("l_extendedprice", "l_quantity").alias("a")).collect()[0]
    pred = SC.linear_score({"l_quantity": float(r["b"])}, float(r["a"]))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     round_half_away(pred, 4).alias("prediction"))
