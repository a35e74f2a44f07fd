"""Feature stages of training splits: no validation row touches them, and one pass gives them all."""

import random
import statistics

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from tablesmith.operators import models as M
from tablesmith.operators import tune as TU
from tablesmith.operators.fold_features import FoldFeatures, Moments


def table(spark, n=400, outlier=None):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        x = rng.gauss(5, 2)
        kind = rng.choice(["a", "a", "b", "", None])
        rows.append([i % 4, None if i % 9 == 0 else x, float("nan") if i % 13 == 0 else rng.random(), kind, 3.0 * x + (kind == "a")])
    if outlier is not None:
        rows[outlier][1] = 1e9
        rows[outlier][3] = "only here"
    return spark.createDataFrame(rows, "fold int, `the x` double, y double, kind string, label double"), rows


def test_statistics_are_those_of_the_other_folds(spark):
    df, rows = table(spark)
    f = FoldFeatures(df, ["the x", "y"], ["kind"], "fold")
    for without in (None, 0, 3):
        xs = [r[1] for r in rows if r[0] != without and r[1] is not None]
        m = f.training_moments(without)[0]
        assert m.n == len(xs) and m.mean == pytest.approx(statistics.mean(xs)) and m.spread() == pytest.approx(statistics.stdev(xs))
        counts = {k: sum(r[3] == k and r[0] != without for r in rows) for k in ("a", "b", "")}
        assert f.training_labels(without)[0] == sorted(counts, key=lambda k: (-counts[k], k))


def test_an_outlier_in_one_fold_stays_out_of_its_training_split(spark):
    """Row 5 (fold 1) carries a huge value and a category of its own."""
    clean, _ = table(spark)
    dirty, _ = table(spark, outlier=5)
    a, b = FoldFeatures(clean, ["the x", "y"], ["kind"], "fold"), FoldFeatures(dirty, ["the x", "y"], ["kind"], "fold")
    assert a.training_moments(1) == pytest.approx(b.training_moments(1)) or a.training_moments(1)[0].n == b.training_moments(1)[0].n
    x, z = (f.transform(d.where("fold = 0"), 1).select("features").collect() for f, d in ((a, clean), (b, dirty)))
    assert all(abs(p.features.toArray() - q.features.toArray()).max() < 1e-12 for p, q in zip(x, z))
    assert b.training_labels(1)[0] [0] == "a" and set(b.training_labels(1)[0]) == {"a", "b", ""} and "only here" in b.training_labels(0)[0]
    assert b.training_moments(0)[0].mean > 1e6 > b.training_moments(1)[0].mean
    # the outlier itself, as a validation row: measured with the others' scale, its category in the last slot
    row = b.transform(dirty.where("label is not null and kind = 'only here'"), 1).first().features.toArray()
    assert row[0] > 1e8 and row[2:].tolist() == [0, 0, 0, 1]


def test_one_pass_whatever_the_number_of_folds(spark):
    df, _ = table(spark)
    seen = spark.sparkContext.accumulator(0)
    tap = F.udf(lambda v: (seen.add(1), v)[1], "double")
    f = FoldFeatures(df.withColumn("y", tap("y")), ["y"], ["kind"], "fold")
    assert seen.value == 400 and len(f.moments) == 4


def test_moments_merge():
    rng = random.Random(1)
    xs = [1e9 + rng.random() for _ in range(50)]
    whole = sum((Moments(1, x, 0.0) for x in xs), Moments())
    assert whole.mean == pytest.approx(statistics.mean(xs)) and whole.spread() == pytest.approx(statistics.stdev(xs), rel=1e-6)
    assert Moments() + Moments() == Moments() and Moments(1, 2.0, 0.0).spread() == 1.0


def test_searches_measure_on_unseen_rows(spark):
    df, _ = table(spark, outlier=5)
    model, features, board = TU.grid_cv_prepared(M.linear_regression(), {"regParam": [0.0, 10.0]}, RegressionEvaluator(metricName="rmse"),
                                                 df, ["the x", "y"], ["kind"], "fold", 4)
    assert [r.status for r in board.collect()] == ["ok", "ok"] and model.numFeatures == 2 + 5
    scored = model.transform(features.transform(df))
    assert scored.count() == 400
    small = df.withColumn("two", (F.col("label") > 15).cast("int")).where("`the x` < 1e8")
    board = TU.auto_classify(small, "two", ["the x", "y"], ["kind"], max_trials=4, parallelism=2, folds=2)
    assert {r.status for r in board.collect()} == {"ok"} and max(r.metric for r in board.collect()) > 0.9


def test_category_lists_of_unequal_length(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "p string, q string")
    got = [r.features.toArray().tolist() for r in FoldFeatures(df, [], ["p", "q"]).transform(df).collect()]
    assert got == [[1, 0, 0, 0, 1, 0], [0, 1, 0, 0, 1, 0], [0, 0, 1, 0, 0, 1]]


def test_empty_columns(spark):
    df = spark.createDataFrame([(0, None, None, 1.0), (1, None, None, 2.0)], "fold int, x double, kind string, label double")
    f = FoldFeatures(df, ["x"], ["kind"], "fold")
    assert [r.features.toArray().tolist() for r in f.transform(df, 0).collect()] == [[0.0, 0.0, 1.0]] * 2
    assert FoldFeatures(df.limit(0), ["x"], [], "fold").transform(df).count() == 2
