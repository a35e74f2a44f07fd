"""Edge cases of single operators: gaps, ties, constants, odd names, failures, restarts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import SMALL
from tablesmith.operators import abtest, evaluate, features, forecast, impute, models, profile, select, split, tune
from tablesmith.queries.common import T, scratch_path
from tablesmith.queries.q_scoring import _event_files, _value_model
from tablesmith.streaming import score

NAN = float("nan")


# --- statistics with gaps and constants ----------------------------------------

def test_missing_values_leave_mutual_information_alone(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in rng.standard_normal((300, 2))]
    gaps = rows + [(None, 1.0), (NAN, 2.0), (3.0, None), (4.0, NAN)]
    plain, holed = (select.mutual_information(spark.createDataFrame(r, "x double, y double"), ["x"], "y", 5, 5).first()["mi"]
                    for r in (rows, gaps))
    assert holed == pytest.approx(plain, abs=0.02)
    wide = [(10.0 ** i, float(i)) for i in range(10)] * 3                  # quantile bins see every decade
    assert select.mutual_information(spark.createDataFrame(wide, "x double, y double"), ["x"], "y", 10, 10).first()["mi"] \
        == pytest.approx(np.log(10), abs=1e-9)


def test_perfect_and_flat_features_in_the_f_test(spark):
    df = spark.createDataFrame([(float(i), 5.0, float(i % 3), 2.0 * i) for i in range(20)], "a double, flat double, b double, y double")
    got = {r["feature"]: r for r in select.select_k_best_f(df, ["flat", "a", "b"], "y", k=2).collect()}
    assert got["a"]["f_score"] == float("inf") and got["a"]["rank"] == 1
    assert got["flat"]["f_score"] is None and got["flat"]["rank"] == 3 and got["flat"]["selected"] == 0


def test_evaluation_of_constants_and_missing_predictions(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, score double")
    assert evaluate.eval_auc(one).first()["auc"] is None
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "label double, prediction double")
    r = evaluate.eval_regression(flat).first()
    assert r["r2"] is None and r["rmse"] == 1.0 and r["n"] == 2
    some = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (9.0, None), (7.0, NAN)], "label double, prediction double")
    r = evaluate.eval_regression(some).first()
    assert r["n"] == 2 and r["r2"] == pytest.approx(1 - 4 / 0.5)


def test_correlations_are_pairwise_and_take_one_column(spark):
    rows = [(1.0, 1.0, 5.0), (2.0, 3.0, None), (3.0, 2.0, 7.0), (4.0, 5.0, NAN), (NAN, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    for fn in (profile.corr_matrix_pearson, profile.corr_matrix_spearman, profile.corr_matrix_kendall):
        two = {(r["x"], r["y"]): r["r"] for r in fn(df, ["x", "y"]).collect()}
        three = {(r["x"], r["y"]): r["r"] for r in fn(df, ["x", "y", "z"]).collect()}
        assert three["x", "y"] == pytest.approx(two["x", "y"])
        assert [tuple(r) for r in fn(df, ["x"]).collect()] == [("x", "x", 1.0)]
    tiny = spark.createDataFrame([(1e-12,), (3e-12,)], "v double")
    assert profile.profile_report(tiny, ["v"], with_rank_corr=False)["columns"].first()["mean"] == pytest.approx(2e-12)


def test_nan_is_missing_in_bins(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, NAN), (NAN, 3.0), (3.0, 2.0)], "x double, y double")
    assert profile.scatter_bins(df, "x", "y", 2).agg(F.sum("n")).first()[0] == 2
    both = profile.pair_bins(df, ["x", "y"], 2).where("x = 'x' and y = 'y'")
    assert both.agg(F.sum("n")).first()[0] == 2


def test_mode_keeps_large_integers(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big,), (big,), (big - 1,), (None,)], "v long")
    assert impute.fit_mode(df, ["v"]).values["v"] == big
    assert [r[0] for r in impute.impute_mode(df, ["v"]).collect()].count(big) == 3


# --- splits ---------------------------------------------------------------------

def test_shares_finer_than_a_percent(spark):
    n = spark.range(20_000)
    test = split.split_random(n, ["id"], 0.995).where("split = 'test'").count()
    assert 60 < test < 140


@pytest.mark.parametrize("parts", [1, 7])
def test_missing_strata_are_split_too(spark, parts):
    rows = [(None if i % 3 == 0 else "ab"[i % 2], i) for i in range(90)] + [("tiny", 1000)]
    df = spark.createDataFrame(rows, "s string, k long").repartition(parts)
    got = split.split_stratified(df, "s", ["k"], 0.7).collect()
    assert len(got) == 91
    for s in (None, "a", "b", "tiny"):
        own = [r.split for r in got if r.s == s]
        assert own.count("train") == int(len(own) * 0.7 + 0.5)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, split.split_stratified(
        df.repartition(3, "k"), "s", ["k"], 0.7).collect()), key=repr)


def test_missing_time_belongs_to_no_side(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in range(1, 11)] + [(None,)], "t timestamp")
    got = [r.split for r in split.split_chronological(df, "t", 0.5).collect()]
    assert got.count(None) == 1 and got.count("train") == 5


# --- features -------------------------------------------------------------------

def test_names_with_blanks(spark):
    df = spark.createDataFrame([(1.0, 2.0, "u"), (2.0, 5.0, "v"), (4.0, 1.0, "u")], "`a b` double, `c d` double, k string")
    pipe = features.feature_pipeline(["a b", "c d"], ["k"], impute=["a b"], derived={"x y": ("a b", "c d")})
    assert pipe.fit(df).transform(df).count() == 3
    assert features.scale_standard_wide(df, ["a b"]).columns[-1] == "a b_std"
    assert profile.column_means(df, ["a b"]).first()[0] == pytest.approx(7 / 3)


def test_vectorizers_shuffle_no_documents(spark):
    docs = T(spark, SMALL, "documents")
    counts, vocab = features.count_vectorize(docs, "doc_id", "text", 10)
    wide = features.count_vectorize_wide(docs, "doc_id", "text", 10, 2)
    for df in (counts, wide):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert len(vocab.terms) == 10


# --- searches -------------------------------------------------------------------

def _labelled(spark, n=120):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(a + 0.5 * b > 0)) for i, (a, b) in enumerate(rng.standard_normal((n, 2)))]
    return spark.createDataFrame(rows, "k long, x double, y double")


@pytest.mark.parametrize("parallelism", [1, 4])
def test_every_family_is_tried_whatever_the_parallelism(spark, parallelism):
    log = tune.RunLog(spark, scratch_path(spark, "runs"))
    board = tune.auto_classify(_labelled(spark, 60), "y", ["x"], [], max_trials=4, folds=2, parallelism=parallelism,
                               key=["k"], log=log, experiment="search").collect()
    assert {r["family"] for r in board} == {"logistic_regression", "decision_tree", "random_forest", "gbt"}
    assert all(r["status"] == "ok" for r in board)
    assert log.runs().where("experiment = 'search'").count() == 4
    late = tune.auto_classify(_labelled(spark, 60), "y", ["x"], [], max_trials=2, timeout_minutes=0, key=["k"]).collect()
    assert [r["status"] for r in late] == ["not run"] * 2


def test_scores_do_not_depend_on_the_layout_and_failures_are_ranked_last(spark):
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(_labelled(spark)).withColumnRenamed("y", "label")
    lr, space = models.logistic_regression(), {"regParam": tune.Space("uniform", 0.0, 1.0)}
    boards = [[tuple(r) for r in tune.random_search(lr, space, BinaryClassificationEvaluator(), d, 3, folds=2, key=["k"])[1].collect()]
              for d in (df.coalesce(1), df.repartition(5))]
    assert [b[:2] for b in boards[0]] == [b[:2] for b in boards[1]]
    assert [b[2] for b in boards[0]] == pytest.approx([b[2] for b in boards[1]], abs=1e-6)
    fams = {"good": (lr, {"regParam": [0.1]}), "bad": (models.logistic_regression(features="nowhere"), {"regParam": [0.1]})}
    board, model = tune.model_compare(fams, BinaryClassificationEvaluator(), df, folds=2, key=["k"])
    rows = board.collect()
    assert [r["family"] for r in rows] == ["good", "bad"] and rows[1]["metric"] is None and rows[1]["n_ok"] == 0
    assert model is not None


def test_trees_deeper_than_spark_builds_are_refused(spark):
    with pytest.raises(ValueError):
        models.decision_tree_classifier(max_depth=31)
    with pytest.raises(ValueError):
        tune.draw_param_maps(models.decision_tree_classifier(), {"maxDepth": tune.Space("randint", 2, 40)}, 3)


# --- scoring --------------------------------------------------------------------

def test_two_streams_share_a_log_and_a_restart_adds_nothing(spark):
    path, schema = _event_files(spark, SMALL)
    m, log = _value_model(T(spark, SMALL, "events")), scratch_path(spark, "log")
    n = T(spark, SMALL, "events").count()
    folders = [scratch_path(spark, "c1"), scratch_path(spark, "c2")]
    for version, folder in zip("12", folders):
        score.inference_log(spark, m, path, schema, log, folder, ["event_id"], version)
    score.inference_log(spark, m, path, schema, log, folders[0], ["event_id"], "1")
    got = {r["model_version"]: r["count"] for r in spark.read.parquet(log).groupBy("model_version").count().collect()}
    assert {str(k): v for k, v in got.items()} == {"1": n, "2": n}


def test_control_without_rows_and_per_variant_metrics(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 0, 1, 0.4), ("b", 1, 1, 0.8), ("b", 0, 0, 0.1)],
                               "variant string, prediction int, ground_truth int, score double")
    assert all(r["diff_vs_control"] is None for r in abtest.ab_metrics(df, control="zzz").collect())
    got = {r["variant"]: r for r in abtest.ab_evaluate(df, score="score").collect()}
    assert got["b"]["auc"] == 1.0 and got["a"]["auc"] is None and got["b"]["weighted_f1"] == 1.0
    assert got["a"]["rmse"] == pytest.approx(0.5 ** 0.5)


# --- smoothing ------------------------------------------------------------------

def test_smoothing_steps_all_settings_like_single_ones():
    rng = np.random.default_rng(4)
    y = 20 + 0.5 * np.arange(40) + 5 * np.sin(np.arange(40) * 2 * np.pi / 7) + rng.standard_normal(40)

    def single(a, b):
        level, trend, sse = y[0], y[1] - y[0], 0.0
        for v in y[1:]:
            sse += (v - level - trend) ** 2
            new = a * v + (1 - a) * (level + trend)
            trend, level = b * (new - level) + (1 - b) * trend, new
        return sse, level + trend * np.arange(1, 6)
    best = min((single(a, b) for a in forecast.ALPHAS for b in forecast.BETAS), key=lambda r: r[0])[1]
    assert forecast.smooth(y, 5) == pytest.approx(best)
    truth = 20 + 0.5 * np.arange(40, 47) + 5 * np.sin(np.arange(40, 47) * 2 * np.pi / 7)
    assert np.abs(forecast.smooth(y, 7, 7) - truth).mean() < np.abs(forecast.smooth(y, 7) - truth).mean()
    assert np.isnan(forecast.smooth(np.array([]), 2)).all() and list(forecast.smooth(np.array([3.0]), 2)) == [3.0, 3.0]
