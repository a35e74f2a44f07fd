"""Boosted trees on cells: Spark ML's importances, and the rule for equal gains."""

import os

import pytest
from conftest import SMALL
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tablesmith import queries
from tablesmith.plans import boosting
from tablesmith.session import ensure_checkpoint_dir
from test_cells import rows_of


def test_tree_importance_boosts_all_rounds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("tablesmith.operators.select.boosted_importances",
                        lambda df, est: (seen.append((df.count(), est.getMaxIter(), est.getMaxDepth())), [0.25] * 4)[1])
    assert queries.queries()["tree_importance"](spark, SMALL).count() == 4
    assert seen == [(spark.read.parquet(f"{SMALL}/lineitem.parquet").count(), 50, 5)]
    sql = queries.oracle_sql()["tree_importance"]
    assert all(f"t{r}_b{d} AS" in sql for r in range(50) for d in range(5))


@pytest.mark.parametrize("per_task", [50_000, 20])
def test_importances_are_those_of_trees_fitted_to_the_rows(spark, monkeypatch, per_task):
    monkeypatch.setattr(boosting, "CELLS_PER_TASK", per_task)  # 105 cells: one task, six tasks
    df, est = rows_of(spark, 3000), GBTRegressor(maxIter=5, maxDepth=3, stepSize=0.2)
    assert boosting.boosted_importances(df, est) == pytest.approx(est.fit(df).featureImportances.toArray(), abs=1e-9)


def test_of_equal_gains_the_first_feature_wins(spark):
    """The last two features part the rows as the first two do, from the other end."""
    df = rows_of(spark, 700).withColumns({"d": -F.col("a"), "e": 100 - F.col("b")}).drop("features")
    for names in (["a", "b", "c", "d", "e"], ["d", "e", "c", "a", "b"]):
        vec = VectorAssembler(inputCols=names, outputCol="features").transform(df)
        got = boosting.boosted_importances(vec, GBTRegressor(maxIter=4, maxDepth=4))
        assert got[3:] == [0.0, 0.0] and min(got[:3]) > 0 and sum(got) == pytest.approx(1)


def test_nothing_to_split_and_settings_that_draw_rows(spark):
    df = rows_of(spark, 50)
    assert boosting.boosted_importances(df.withColumn("label", F.lit(0.1)), GBTRegressor(maxIter=3)) == [0.0] * 3
    with pytest.raises(ValueError, match="draws rows"):
        boosting.boosted_importances(df, GBTRegressor(subsamplingRate=0.5))


def test_rounds_leave_no_tables(spark):
    where = os.path.join(ensure_checkpoint_dir(spark), "tablesmith-tables")
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    boosting.boosted_importances(rows_of(spark, 100), GBTRegressor(maxIter=3, maxDepth=2))
    assert set(os.listdir(where)) == before
