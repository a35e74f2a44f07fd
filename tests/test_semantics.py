"""Semantic rules of SURVEY section 1.1 and the reference's defects (section 1.2)."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from conftest import SMALL
from tablesmith.functions import columns as C
from tablesmith.operators import abtest, clean, features, impute, outliers, profile, select, split
from tablesmith.queries.common import T


def test_d2_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(C.safe_div("a", "b")).collect()] == [None, 2.0]


def test_d10_null_stays_null_in_bins(spark):
    df = spark.createDataFrame([(None,), (10.0,), (50.0,)], "x double")
    got = [r[0] for r in df.select(C.case_bins("x", [15, 30], ["a", "b", "c"])).collect()]
    assert got == [None, "a", "c"]


def test_d9_cut_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,)], "x double")
    right = [r[0] for r in df.select(C.cut("x", [0, 1, 2], ["a", "b"], "right")).collect()]
    low = [r[0] for r in df.select(C.cut("x", [0, 1, 2], ["a", "b"], "right", include_lowest=True)).collect()]
    left = [r[0] for r in df.select(C.cut("x", [0, 1, 2], ["a", "b"], "left")).collect()]
    assert right == [None, "a", "b", None] and low == ["a", "a", "b", None] and left == ["a", "b", None, None]


def test_d13_mode_ignores_null_smallest_wins(spark):
    df = spark.createDataFrame([(None,), (None,), (None,), ("b",), ("a",), ("b",), ("a",)], "c string")
    assert impute.fit_mode(df, ["c"]).values == {"c": "a"}


def test_d16_numeric_columns_include_bigint(spark):
    kinds = clean.columns_by_type(T(spark, SMALL, "orders"))
    assert "o_orderkey" in kinds["numeric"] and "o_totalprice" in kinds["numeric"]


def test_d5_zero_spread_column_skipped(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (100.0, 5.0)] + [(2.0, 5.0)] * 20, "x double, c double")
    kept = outliers.outlier_zscore(df, ["x", "c"], threshold=3.0)
    assert kept.count() == 22


def test_d3_sequential_iqr_depends_on_order(spark):
    """Sequential bounds are measured on what the columns before left; simultaneous ones on all rows."""
    rows = [(float(i), float(i % 7)) for i in range(40)] + [(1e6, 500.0), (2.0, 60.0)]
    df = spark.createDataFrame(rows, "x double, y double")

    def brute(order):
        left = rows
        for k in order:
            v = sorted(r[k] for r in left)
            q1, q3 = (np.quantile(v, q) for q in (0.25, 0.75))
            left = [r for r in left if q1 - 1.5 * (q3 - q1) <= r[k] <= q3 + 1.5 * (q3 - q1)]
        return sorted(left)
    for cols, order in ((["x", "y"], (0, 1)), (["y", "x"], (1, 0))):
        assert sorted(map(tuple, outliers.outlier_iqr(df, cols).collect())) == brute(order)


def test_d6_missing_dropped_unless_kept(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (3.0,)], "x double")
    assert outliers.outlier_percentile(df, ["x"], 0.0, 1.0).count() == 3
    assert outliers.outlier_percentile(df, ["x"], 0.0, 1.0, keep_missing=True).count() == 4


def test_d14_split_independent_of_partitioning(spark):
    li = T(spark, SMALL, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a = split.split_random(li.repartition(1), key).groupBy("split").count().collect()
    b = split.split_random(li.repartition(7), key).groupBy("split").count().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_stratified_split_exact_shares(spark):
    o = T(spark, SMALL, "orders")
    s = split.split_stratified(o, "o_orderpriority", ["o_orderkey"], 0.8)
    for r in s.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"),
                                              F.sum((F.col("split") == "train").cast("int")).alias("t")).collect():
        assert r["t"] == int(r["n"] * 0.8 + 0.5)


def test_d12_one_hot_wide_drops_first_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "c string")
    out = features.one_hot_wide(df, "c")
    assert out.columns == ["c", "c_b", "c_c"]
    assert out.where(F.col("c").isNull()).select("c_b", "c_c").first() == (0, 0)


def test_duplicate_named_feature_kept_once(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.warns(UserWarning):
        out = clean.ratio_features(df, ratios={"r": ("a", "b")}, products={"r": ("a", "b")})
    assert out.columns.count("r") == 1


def test_sticky_assignment_per_user(spark):
    e = abtest.ab_assign_sticky(T(spark, SMALL, "events"), "user_id", {"A": 50, "B": 50}, "exp")
    assert e.groupBy("user_id").agg(F.countDistinct("variant").alias("k")).where("k > 1").count() == 0


def test_rating_distribution_sums_to_100(spark):
    from tablesmith.queries.q_clean import SURVEY_COLS, survey_answers
    r = profile.rating_distribution(survey_answers(spark, SMALL), SURVEY_COLS)
    for row in r.groupBy("column").agg(F.sum("pct").alias("p")).collect():
        assert abs(row["p"] - 100.0) < 0.1


def test_learner_beats_constant(spark):
    from pyspark.ml.feature import VectorAssembler
    from tablesmith.operators import evaluate, models
    li = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(
        T(spark, SMALL, "lineitem")).withColumnRenamed("l_extendedprice", "label")
    _, pred = models.fit_predict(models.decision_tree_regressor(max_depth=4), li)
    r2 = evaluate.eval_regression(pred).first()["r2"]
    assert r2 > 0.0


def test_tree_importances_sum_to_one(spark):
    imp = select.tree_importance(T(spark, SMALL, "lineitem"), ["l_quantity", "l_discount", "l_tax"],
                                 "l_extendedprice", "forest", num_trees=5, max_depth=4)
    assert abs(sum(r["importance"] for r in imp.collect()) - 1.0) < 1e-9


def test_saved_model_predicts_the_same(spark):
    from tablesmith.queries.common import scratch_path
    from tablesmith.sources import files
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    li = T(spark, SMALL, "lineitem")
    m = Pipeline(stages=[VectorAssembler(inputCols=["l_quantity"], outputCol="features"),
                         LinearRegression(labelCol="l_extendedprice")]).fit(li)
    p = scratch_path(spark, "m")
    files.save_model(m, p)
    a = m.transform(li).select("prediction").collect()
    b = files.load_model(p).transform(li).select("prediction").collect()
    assert a == b


def test_numeric_type_helper(spark):
    assert all(isinstance(f.dataType, NumericType) for f in T(spark, SMALL, "part").select(
        *profile.numeric_columns(T(spark, SMALL, "part"))).schema.fields)
