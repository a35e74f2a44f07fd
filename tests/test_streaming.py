"""Streams: file source with availableNow; results equal the batch answer."""

from pyspark.sql import functions as F

from conftest import SMALL
from tablesmith.queries.common import T, scratch_path
from tablesmith.queries.q_scoring import SHARES_70_30, _event_files, _value_model
from tablesmith.streaming import score as SC


def test_stream_score_equals_batch(spark):
    path, schema = _event_files(spark, SMALL)
    m = _value_model(T(spark, SMALL, "events"))
    sink = scratch_path(spark, "s")
    SC.stream_score(spark, m, path, schema, sink, scratch_path(spark, "c"), keep=["event_id"])
    got = {r[0]: r[1] for r in spark.read.parquet(sink).collect()}
    want = {r[0]: r[1] for r in m.transform(T(spark, SMALL, "events")).select("event_id", "prediction").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_stream_restart_does_not_duplicate(spark):
    path, schema = _event_files(spark, SMALL)
    m = _value_model(T(spark, SMALL, "events"))
    sink, ckpt = scratch_path(spark, "s"), scratch_path(spark, "c")
    SC.stream_score(spark, m, path, schema, sink, ckpt, keep=["event_id"])
    SC.stream_score(spark, m, path, schema, sink, ckpt, keep=["event_id"])   # restart: nothing new
    assert spark.read.parquet(sink).count() == T(spark, SMALL, "events").count()


def test_windowed_ab_metrics_closed_windows_match_batch(spark):
    path, schema = _event_files(spark, SMALL)
    sink = scratch_path(spark, "ab")
    SC.ab_metrics_stream(spark, path, schema, sink, scratch_path(spark, "c"), "ts", "user_id",
                         (F.col("value") > 10).cast("int"), (F.col("event_type") == "purchase").cast("int"),
                         SHARES_70_30, "checkout")
    got = spark.read.parquet(sink)
    from tablesmith.operators.abtest import ab_assign_sticky
    e = ab_assign_sticky(T(spark, SMALL, "events"), "user_id", SHARES_70_30, "checkout")
    batch = (e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "variant")
             .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "variant", "n"))
    j = got.join(batch, ["window_start", "variant"])
    assert j.count() == got.count() > 0
    assert j.where(got["n"] != batch["n"]).count() == 0


def test_feedback_join_keeps_every_request(spark):
    from tablesmith.queries.q_scoring import q_ab_metrics, q_feedback_join_stream
    got = {r["variant"]: (r["n"], r["accuracy"]) for r in q_feedback_join_stream(spark, SMALL).collect()}
    want = {r["variant"]: (r["n"], r["accuracy"]) for r in q_ab_metrics(spark, SMALL).collect()}
    assert got == want


def _events(spark, path, rows):
    spark.createDataFrame(rows, "id int, user int, ts timestamp, value double").coalesce(1).write.mode("append").parquet(path)


def test_windows_close_late_rows_count_and_state_stays_small(spark):
    """Forty days in batches: repeats and late rows, then an end mark."""
    import datetime as dt
    path, sink, checkpoint = (scratch_path(spark, n) for n in ("src", "ab", "c"))
    start = dt.datetime(2024, 1, 1, 12)
    schema = spark.createDataFrame([], "id int, user int, ts timestamp, value double").schema
    late, states = 0, []

    def run():
        nonlocal late
        q = SC.ab_metrics_stream(spark, path, schema, sink, checkpoint, "ts", "user", (F.col("value") > 0.5).cast("int"), F.lit(1),
                                 SHARES_70_30, "checkout", watermark="1 day", request_id="id")
        late += SC.late_rows(q)
        states.append(SC.state_rows(q))
    for batch in range(4):
        rows = [(100 * d + i, i, start + dt.timedelta(days=d), float(i % 2)) for d in range(10 * batch, 10 * batch + 10) for i in range(6)]
        rows += rows[-6:]  # sent again
        if batch == 2:
            rows += [(9000 + i, i, start, 1.0) for i in range(5)]  # of a day long closed
        _events(spark, path, rows)
        run()
    SC.end_stream(spark, path, schema, "ts", start + dt.timedelta(days=60))
    run()
    got = spark.read.parquet(sink).groupBy("window_start").agg(F.sum("n").alias("n")).collect()
    assert len(got) == 40 and {r.n for r in got} == {6} and late == 5
    assert max(states) <= 3 * 8 and states[-1] <= 2


def test_a_request_that_comes_again_is_logged_once(spark):
    path, schema = _event_files(spark, SMALL)
    m = _value_model(T(spark, SMALL, "events"))
    log, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "c")
    kw = {"keep": ["event_id"], "request_id": "event_id", "ts": "ts", "watermark": "400 days"}
    SC.inference_log(spark, m, path, schema, log, checkpoint, **kw)
    T(spark, SMALL, "events").withColumn("day", F.lit("2100-01-01")).write.mode("append").partitionBy("day").parquet(path)
    SC.inference_log(spark, m, path, schema, log, checkpoint, **kw)  # a later batch brings all of them again
    out = spark.read.parquet(log)
    assert out.count() == out.select("event_id").distinct().count() == T(spark, SMALL, "events").count()
