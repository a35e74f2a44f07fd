"""Regression trees from cells against trees from rows."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablesmith.operators import models as M
from tablesmith.plans.cells import CellFit, cells_of
from tablesmith.plans.trees import TreeModel

NAMES = ["a", "b", "c"]


def rows_of(spark, n=4000):
    """Features of 7, 5 and 3 values, and a label that follows them with noise of its own per row."""
    h = F.pmod(F.xxhash64("id"), F.lit(1009)).cast("double")
    df = spark.range(n).select("id", (F.col("id") % 7 * 1.5).alias("a"), (F.col("id") % 5 - 2.25).alias("b"), (F.col("id") % 3 + 0.0).alias("c"), h.alias("h"))
    df = df.withColumn("label", F.col("a") * F.col("b") + 10 * F.col("c") + F.when(F.col("a") > 4, 25).otherwise(0) + F.col("h") / 100)
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)


@pytest.mark.parametrize("make", [lambda: M.decision_tree_regressor(max_depth=4), lambda: M.gbt_regressor(max_iter=4, max_depth=3)])
def test_cells_give_the_tree_of_the_rows(spark, make):
    df = rows_of(spark)
    cells, rows = CellFit(make()).fit(df), make().fit(df)
    assert cells.featureImportances.toArray() == pytest.approx(rows.featureImportances.toArray(), abs=1e-9)
    both = rows.transform(df).select("id", "features", *NAMES, F.col("prediction").alias("want"))
    got = cells.transform(both).withColumn("mine", TreeModel(cells, NAMES).prediction())
    assert got.where((F.abs(F.col("prediction") - F.col("want")) > 1e-9) | (F.col("mine") != F.col("prediction"))).count() == 0
    assert got.columns == [*both.columns, "prediction", "mine"]


def test_what_a_fit_reads_does_not_grow_with_the_rows(spark):
    est = M.gbt_regressor()
    small, large = (cells_of(rows_of(spark, n), est).frame for n in (2000, 8000))
    assert small.count() == large.count() == 7 * 5 * 3
    assert large.agg(F.sum("_weight")).first()[0] == 8000


def test_many_values_are_cut_at_quantiles_and_raw_rows_scored_alike(spark):
    df = spark.range(5000).select("id", (F.pmod(F.xxhash64("id"), F.lit(100003)) / 1000.0).alias("x"))
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.withColumn("label", F.when(F.col("x") > 50, 1.0).otherwise(-1.0)))
    est = M.decision_tree_regressor(max_depth=5)
    cells = cells_of(df, est)
    assert 32 < cells.frame.count() <= 64 and len(cells.cuts[0]) < 64
    out = cells.fit(est).transform(df)
    assert out.agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0] < 0.05


def test_odd_input(spark):
    est = M.decision_tree_regressor()
    df = rows_of(spark, 50)
    with pytest.raises(ValueError, match="null nor NaN"):
        CellFit(est).fit(df.withColumn("label", F.when(F.col("id") != 3, F.col("label"))))
    with pytest.raises(ValueError, match="no rows"):
        CellFit(est).fit(df.limit(0))
    with pytest.raises(ValueError, match="draws rows"):
        CellFit(M.random_forest_regressor())
    assert CellFit(est).fit(df.where("id = 1")).transform(df).where("prediction IS NULL").count() == 0  # a single leaf


def test_grid_search_measures_each_named_fold_on_its_rows(spark):
    """Four folds, settings fitted to cells: the metrics are those of trees fitted to the rows."""
    from pyspark.ml.evaluation import RegressionEvaluator

    from tablesmith.operators import tune
    df, est, ev = rows_of(spark, 1200).withColumn("part", F.col("id") % 4), M.decision_tree_regressor(), RegressionEvaluator(metricName="rmse")
    model, table = tune.grid_cv(est, {"maxDepth": [1, 3]}, ev, df, fold_col="part")
    want = []
    for depth in (1, 3):
        found = [ev.evaluate(est.copy({est.maxDepth: depth}).fit(df.where(F.col("part") != f)).transform(df.where(F.col("part") == f)))
                 for f in range(4)]
        want.append(sum(found) / 4)
    assert model.avgMetrics == pytest.approx(want, abs=1e-9)
    assert [r.metric for r in table.collect()] == pytest.approx(sorted(want), abs=1e-9)
    assert ev.evaluate(model.transform(df)) < want[0]


@pytest.mark.parametrize("name", ["run_log", "grid_cv"])
def test_searches_fit_cells(spark, monkeypatch, name):
    from conftest import SMALL
    from pyspark.ml.regression import DecisionTreeRegressor

    from tablesmith import queries
    seen, fit = [], DecisionTreeRegressor._fit
    monkeypatch.setattr(DecisionTreeRegressor, "_fit", lambda self, df: (seen.append(df.columns), fit(self, df))[1])
    assert queries.queries()[name](spark, SMALL).count() in (1, 4)
    assert seen and all("_cell" in c for c in seen)


def test_a_forest_gets_partitions_of_bounded_rows(spark):
    from tablesmith.operators import select
    df = spark.range(1000).coalesce(1)
    parts = select.bounded_partitions(df, 300)
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 1000
    assert select.bounded_partitions(spark.range(0, 1000, 1, 8), 300).rdd.getNumPartitions() == 8
    assert select.bounded_partitions(df.limit(0)).count() == 0
