"""Missing values and clashing column names in single operators."""

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import abtest, clean, evaluate, forecast, profile, split

NAN = float("nan")


def test_helper_names_may_be_column_names(spark):
    names = ["_n", "_h", "_r", "_rn", "_off", "_cnt", "_group_n", "_last", "k"]
    df = spark.createDataFrame([(i % 3, i % 2, *[i] * 7) for i in range(60)], ", ".join(f"{c} int" for c in names))
    assert profile.min_group_size(df, "_n", 20).count() == 60 and profile.min_group_size(df, ["_n", "_h"], 11).count() == 0
    out = split.split_stratified(df, ["_n", "_h"], ["_last", "k"], 0.8)
    assert out.columns == [*names, "split"]
    per = out.groupBy("_n", "_h").agg(F.sum((F.col("split") == "train").cast("int")).alias("t"), F.count(F.lit(1)).alias("c")).collect()
    assert len(per) == 6 and all(r.t == 8 and r.c == 10 for r in per)
    again = split.split_stratified(out, "_n", ["k"], 0.5)  # the split column itself is replaced
    assert again.columns == out.columns and again.where("split = 'train'").count() == 30


def test_rows_with_one_key_stay_together(spark):
    df = spark.createDataFrame([(1, i % 10) for i in range(100)], "s int, k int")
    out = split.split_stratified(df, "s", ["k"], 0.83)
    assert out.groupBy("k").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert out.where("split = 'train'").count() == 90


def test_nan_is_missing_in_flags_bins_and_ranges(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, "b"), (None, "c"), (5.0, "d")], "x double, name string")
    assert [r.f for r in clean.threshold_flag(df, "f", "x", ">", 0.5).collect()] == [1, None, None, 1]
    assert [r.f for r in clean.threshold_flag(df, "f", "name", "==", "b").collect()] == [0, 1, 0, 0]
    assert [r.b for r in clean.case_bins(df, "b", "x", [2.0], ["low", "high"]).collect()] == ["low", None, None, "high"]
    assert [r.b for r in clean.case_bins(df, "b", "x", [2.0], ["high", "low"], descending=True).collect()] == ["low", None, None, "high"]
    assert clean.filter_range(df, {"x": (0.0, None)}).count() == 2 and clean.filter_range(df, {"x": (None, 9.0)}).count() == 2
    assert clean.filter_range(df, {"x": (2.0, None)}, keep_missing=True).count() == 3
    inner = df.select(F.struct("x").alias("s"))
    assert [r.f for r in clean.threshold_flag(inner, "f", "s.x", ">", 0.5).collect()] == [1, None, None, 1]


def test_incomplete_rows_count_nowhere(spark):
    rows = [("a", 1.0, 1.0), ("a", 0.0, 1.0), ("a", None, 1.0), ("a", 1.0, NAN), ("b", NAN, 0.0)]
    df = spark.createDataFrame(rows, "v string, label double, prediction double")
    assert evaluate.eval_multiclass(df).first().n == 2 and evaluate.eval_multiclass(df).first().accuracy == 0.5
    assert evaluate.eval_smape(df).first().n == 2 and evaluate.eval_smape(df).first().smape == pytest.approx(1.0)
    got = abtest.ab_metrics(df, "v", "prediction", "label").collect()
    assert [(r.v, r.n, r.accuracy, r.mean_prediction) for r in got] == [("a", 2, 0.5, 1.0)]
    assert {r.v: r.n for r in profile.group_avg_sorted(df.withColumn("x", F.col("label")), "v", "x").collect()} == {"a": 4, "b": 1}
    shape = {r["column"]: r.non_null for r in profile.table_shape(df).collect()}
    assert shape == {"v": 5, "label": 3, "prediction": 4}


def days(spark, rows):
    return spark.createDataFrame(rows, "id string, day string, y double").withColumn("day", F.to_date("day"))


def test_regression_finds_breaks_seasons_and_holidays(spark):
    import datetime as dt
    import math
    start = dt.date(2024, 1, 1)

    def value(i):
        d = start + dt.timedelta(days=i)
        number = (d - dt.date(1970, 1, 1)).days
        return 10 + 0.5 * i - 0.8 * max(0, i - 80) + 3 * math.sin(2 * math.pi * (number % 7) / 7) + (25 if d.day == 1 else 0)
    rows = [("s", str(start + dt.timedelta(days=i)), NAN if i == 17 else value(i)) for i in range(201) if i % 29 or not i]
    rows += [("one", "2024-01-05", 7.0), ("two", "2024-01-05", 1.0), ("two", "2024-01-06", 3.0), ("gap", "2024-02-01", None)]
    calendar = spark.createDataFrame([("first", str(dt.date(2024, m, 1))) for m in range(1, 13)] + [("first", "2024-03-01")], "name string, day string")
    design = forecast.Design(breaks=1, weekly=1, holidays=("first",), break_penalty=1e-9, season_penalty=1e-9)
    got = {(r.id, r.day): r.forecast for r in forecast.forecast_regression(days(spark, rows), 20, design, calendar).collect()}
    for i in range(201, 221):  # the break is planted where the design has it: at 0.4 of the first 200 days
        assert got["s", start + dt.timedelta(days=i)] == pytest.approx(value(i), abs=0.05)
    assert got["one", dt.date(2024, 1, 6)] == pytest.approx(7.0, abs=0.5) and len([k for k in got if k[0] == "two"]) == 20
    assert not [k for k in got if k[0] == "gap"]


def test_regression_competes(spark):
    rows = [("s", f"2024-01-{d:02d}", 2.0 * d + (10 if d % 7 == 1 else 0)) for d in range(1, 32)]
    design = forecast.Design(breaks=0, weekly=3, season_penalty=1e-9)
    out = {r.model: r for r in forecast.forecast_select(days(spark, rows), 7, 7, with_holt=False, design=design).collect()}
    assert len(out) == 6 and out["regression"].best == 1 and out["regression"].smape < 0.01
