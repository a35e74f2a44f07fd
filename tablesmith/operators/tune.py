"""Tuning, comparison, automatic search and run logging.

A trial is one setting of one family, fitted and measured on folds that a hash of
the row's key names, so results do not depend on the layout (D14).  Trials are
Spark ML jobs; ``parallelism`` driver threads keep several in flight.  A trial that
fails is recorded and ranked last; one whose turn comes after the deadline is recorded as not
run.  Result tables are small DataFrames (one row per setting / family / run).
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import (BinaryClassificationEvaluator, MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.columns import hash_unit, quoted
from tablesmith.operators import models as M
from tablesmith.operators.fold_features import FoldFeatures
from tablesmith.plans.cells import cells_of, fits_cells
from tablesmith.session import cut_lineage


def _param_text(pm) -> str:
    return json.dumps({p.name: (v if isinstance(v, (int, float, str, bool)) else str(v))
                       for p, v in sorted(pm.items(), key=lambda kv: kv[0].name)}, sort_keys=True)


def _results(spark: SparkSession, maps, metrics, larger_better: bool, family: str = "") -> DataFrame:
    rows = [(family, _param_text(pm), float(m)) for pm, m in zip(maps, metrics)]
    df = spark.createDataFrame(rows, "family string, params string, metric double")
    order = F.col("metric").desc() if larger_better else F.col("metric").asc()
    return df.orderBy(order, "params")


def grid(estimator, values: Mapping[str, Sequence]):
    b = ParamGridBuilder()
    for name, vs in values.items():
        b = b.addGrid(estimator.getParam(name), list(vs))
    return b.build()


def grid_cv_prepared(estimator, values: Mapping[str, Sequence], evaluator, df: DataFrame, numeric: Sequence[str],
                     categorical: Sequence[str], fold_col: str, folds: int, label: str = "label", parallelism: int = 4):
    """V5 over raw columns: gaps filled, values scaled and categories numbered inside each fold's training rows.

    Returns (best estimator's model over all rows, its ``FoldFeatures``, table of params and mean metric).  ``fold_col``
    holds 0..folds-1; one pass gives the statistics of all splits.
    """
    narrow = df.select(F.col(quoted(fold_col)).alias("_fold"), F.col(quoted(label)).cast("double").alias("label"),
                       *[F.col(quoted(c)).alias(f"n{i}") for i, c in enumerate(numeric)],
                       *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(categorical)])
    narrow = narrow.where(F.col("label").isNotNull() & ~F.isnan("label"))
    features = FoldFeatures(narrow, [f"n{i}" for i in range(len(numeric))], [f"c{i}" for i in range(len(categorical))], "_fold")
    trials = [Trial(type(estimator).__name__, estimator, m) for m in grid(estimator, values)]
    run_trials(narrow, trials, evaluator, folds, parallelism=parallelism, fold_col="_fold", features=features)
    larger = evaluator.isLargerBetter()
    best = best_trial(trials, larger)
    model = best.estimator.copy(best.setting).fit(features.transform(narrow.drop("_fold"))) if best else None
    return model, features.renamed(numeric, categorical), board_of(df.sparkSession, trials, larger)


def grid_cv(estimator, values: Mapping[str, Sequence], evaluator, df: DataFrame, folds: int = 5,
            fold_col: str | None = None, parallelism: int = 4, seed: int = 42):
    """V5: grid x k folds; returns (CrossValidatorModel, table of params and mean metric).

    With ``fold_col`` the folds are a hash of a key (layout-free, L4).  A tree regressor that fits cells is fitted to
    the folds' cells, which one grouping of the rows gives for all settings; it is measured on the rows.
    """
    maps = grid(estimator, values)
    if fold_col and fits_cells(estimator) and all(fits_cells(estimator.copy(m)) for m in maps):
        return _grid_cv_cells(estimator, maps, evaluator, df, fold_col, parallelism)
    kw = dict(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, parallelism=parallelism, seed=seed)
    cv = CrossValidator(foldCol=fold_col, **kw) if fold_col else CrossValidator(numFolds=folds, **kw)
    m = cv.fit(df)
    return m, _results(df.sparkSession, maps, m.avgMetrics, evaluator.isLargerBetter())


def _grid_cv_cells(estimator, maps, evaluator, df: DataFrame, fold_col: str, parallelism: int):
    needed = {estimator.getFeaturesCol(), estimator.getLabelCol(), fold_col}
    needed |= {evaluator.getOrDefault(p) for p in evaluator.params if p.name in ("labelCol", "weightCol") and evaluator.isDefined(p)}
    needed |= {estimator.getWeightCol()} if estimator.isDefined("weightCol") else set()
    data = cut_lineage(df.select(*[quoted(c) for c in df.columns if c in needed]))  # every measurement reads it
    cells = cells_of(data, estimator, [fold_col], max(estimator.copy(m).getMaxBins() for m in maps))
    fold = F.col(quoted(fold_col))
    folds = sorted(r[0] for r in cells.frame.select(fold).distinct().collect())  # a handful
    if len(folds) < 2:
        raise ValueError(f"{fold_col} names fewer than two folds")

    def one(trial) -> float:
        setting, f = trial
        model = cells.fit(estimator, fold != F.lit(f), setting)
        return evaluator.evaluate(model.transform(data.where(fold == F.lit(f))))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        trials = [(m, f) for m in maps for f in folds]
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(one), trials))
    metrics = [sum(found[i:i + len(folds)]) / len(folds) for i in range(0, len(found), len(folds))]
    larger = evaluator.isLargerBetter()
    best = (max if larger else min)(range(len(maps)), key=metrics.__getitem__)
    model = CrossValidatorModel(cells.fit(estimator, extra=maps[best]), metrics)
    return model, _results(df.sparkSession, maps, metrics, larger)


@dataclass
class Space:
    """One search dimension: kind in uniform, quniform, loguniform, randint, choice."""
    kind: str
    low: float | None = None
    high: float | None = None
    q: float | None = None
    options: Sequence | None = None

    def draw(self, rng: random.Random):
        if self.kind == "uniform":
            return rng.uniform(self.low, self.high)
        if self.kind == "quniform":
            return round(rng.uniform(self.low, self.high) / self.q) * self.q
        if self.kind == "loguniform":
            return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        if self.kind == "randint":
            return rng.randint(int(self.low), int(self.high))
        if self.kind == "choice":
            return rng.choice(list(self.options))
        raise ValueError(self.kind)

    def highest(self):
        """The largest value it can draw."""
        return max(self.options) if self.kind == "choice" else self.high


WHOLE_NUMBERS = ("maxDepth", "maxBins", "minInstancesPerNode", "numTrees", "maxIter")


def draw_param_maps(estimator, space: Mapping[str, Space], n: int, seed: int = 42):
    """Seeded random settings; whole-number parameters are rounded.  A space that allows a tree
    deeper than Spark can build is refused."""
    if "maxDepth" in space and space["maxDepth"].highest() > M.MAX_TREE_DEPTH:
        raise ValueError(f"maxDepth up to {space['maxDepth'].highest()}: Spark's trees go to {M.MAX_TREE_DEPTH}")
    rng = random.Random(seed)
    maps = []
    for _ in range(n):
        drawn = {name: s.draw(rng) for name, s in space.items()}
        maps.append({estimator.getParam(name): int(round(v)) if name in WHOLE_NUMBERS else v for name, v in drawn.items()})
    return maps


# --- trials -------------------------------------------------------------------

@dataclass
class Trial:
    family: str
    estimator: object
    setting: dict
    metric: float | None = None
    status: str = "not run"
    seconds: float = 0.0


def fold_number(df: DataFrame, folds: int, key: Sequence[str] | None, salt: str) -> Column:
    """Fold 0..folds-1 by a hash of the key, or of all columns without one (equal rows then share a fold)."""
    def text(c: str) -> Column:
        x = F.col(quoted(c))
        x = vector_to_array(x).cast("string") if isinstance(df.schema[c].dataType, VectorUDT) else x.cast("string")
        return F.coalesce(x, F.lit(""))
    return F.pmod(hash_unit([text(c) for c in (key or df.columns)], salt), F.lit(folds)).cast("int")


def run_trials(df: DataFrame, trials: Sequence[Trial], evaluator, folds: int = 3, key: Sequence[str] | None = None,
               measured_folds: int | None = None, parallelism: int = 4, deadline: float | None = None,
               fold_col: str | None = None, salt: str = "trial", features: FoldFeatures | None = None) -> list[Trial]:
    """Fit and measure each trial on the folds (the first ``measured_folds`` of them, default all).

    With ``features`` the rows are raw, and each split's feature vector comes from its training rows alone.
    """
    if fold_col is None:
        df = df.withColumn("_fold", fold_number(df, folds, key, salt))
    data = df.withColumnRenamed(fold_col, "_fold") if fold_col else df
    data = data.persist()

    def one(t: Trial) -> None:
        if deadline is not None and time.time() >= deadline:
            return
        began = time.time()
        try:
            found = []
            for f in range(measured_folds or folds):
                split = features.transform(data, f) if features else data
                model = t.estimator.copy(t.setting).fit(split.where(F.col("_fold") != f).drop("_fold"))
                found.append(evaluator.evaluate(model.transform(split.where(F.col("_fold") == f))))
            t.metric = float(sum(found) / len(found))
            t.status = "ok" if math.isfinite(t.metric) else "failed: metric is not finite"
            t.metric = t.metric if t.status == "ok" else None
        except Exception as e:  # the trial's own failure: the search goes on
            t.status = f"failed: {type(e).__name__}: {str(e).splitlines()[0][:200]}" if str(e) else f"failed: {type(e).__name__}"
        t.seconds = time.time() - began

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            list(pool.map(inheritable_thread_target(df.sparkSession)(one), trials))
    finally:
        data.unpersist()
    return list(trials)


def board_of(spark: SparkSession, trials: Sequence[Trial], larger: bool) -> DataFrame:
    """family, params, metric, status; best first, then failed trials, then those not run."""
    rows = [(t.family, _param_text(t.setting), t.metric, t.status) for t in trials]
    df = spark.createDataFrame(rows, "family string, params string, metric double, status string")
    metric = F.col("metric").desc_nulls_last() if larger else F.col("metric").asc_nulls_last()
    return df.orderBy(metric, F.col("status") == "not run", "family", "params")


def best_trial(trials: Sequence[Trial], larger: bool) -> Trial | None:
    done = [t for t in trials if t.metric is not None]
    return min(done, key=lambda t: (-t.metric if larger else t.metric, t.family, _param_text(t.setting)), default=None)


def log_trials(log: RunLog | None, experiment: str, trials: Sequence[Trial], metric: str) -> None:
    if log is not None:
        log.log_many(experiment, [(f"{t.family}-{i}", json.loads(_param_text(t.setting)),
                                   {"seconds": t.seconds} | ({metric: t.metric} if t.metric is not None else {}),
                                   {"family": t.family, "status": t.status}) for i, t in enumerate(trials)])


def random_search(estimator, space: Mapping[str, Space], evaluator, df: DataFrame, n_trials: int = 10,
                  train_ratio: float = 0.8, folds: int | None = None, parallelism: int = 4, seed: int = 42,
                  key: Sequence[str] | None = None, log: RunLog | None = None, experiment: str = "random_search"):
    """V6: draw N settings, fit each on Spark, rank -> (best model refitted on all rows, table).

    With ``folds`` each setting is measured on all of them; without, on one fold of about
    ``1 - train_ratio`` of the rows.  Folds are a hash of ``key``.
    """
    trials = [Trial(type(estimator).__name__, estimator, m) for m in draw_param_maps(estimator, space, n_trials, seed)]
    parts = folds or max(2, round(1 / max(1e-9, 1 - train_ratio)))
    run_trials(df, trials, evaluator, parts, key, None if folds else 1, parallelism)
    larger = evaluator.isLargerBetter()
    log_trials(log, experiment, trials, evaluator.getMetricName())
    best = best_trial(trials, larger)
    return (best.estimator.copy(best.setting).fit(df) if best else None), board_of(df.sparkSession, trials, larger)


def model_compare(families: Mapping[str, tuple], evaluator, df: DataFrame, folds: int = 3, parallelism: int = 4,
                  seed: int = 42, refit: bool = True, key: Sequence[str] | None = None,
                  log: RunLog | None = None, experiment: str = "model_compare"):
    """V7: tune each family (grid dict or Space dict + trials), choose the best,
    refit it on all rows with ``estimator.copy(best)``.

    ``families``: name -> (estimator, grid values) or (estimator, space, n_trials).
    Returns (leaderboard with each family's best, best refitted model or None).
    """
    trials = []
    for name, spec in families.items():
        maps = grid(spec[0], spec[1]) if len(spec) == 2 else draw_param_maps(spec[0], spec[1], spec[2], seed)
        trials += [Trial(name, spec[0], m) for m in maps]
    run_trials(df, trials, evaluator, folds, key, parallelism=parallelism)
    log_trials(log, experiment, trials, evaluator.getMetricName())
    larger = evaluator.isLargerBetter()
    board = []
    for name in families:
        own = [t for t in trials if t.family == name]
        top = best_trial(own, larger) or own[0]
        board.append((name, _param_text(top.setting), top.metric, len(own), sum(t.status == "ok" for t in own)))
    lb = df.sparkSession.createDataFrame(board, "family string, params string, metric double, n_settings int, n_ok int")
    lb = lb.orderBy(F.col("metric").desc_nulls_last() if larger else F.col("metric").asc_nulls_last(), "family")
    best = best_trial(trials, larger)
    return lb, (best.estimator.copy(best.setting).fit(df) if refit and best else None)


def train_validate(train: DataFrame, val: DataFrame, features: Sequence[str], label: str = "label",
                   min_instances: int = 1, max_bins: int = 32, max_depth: int = 5):
    """V8: fit assembler + tree on train, weighted F1 on validation -> (model, f1)."""
    from pyspark.ml.feature import VectorAssembler
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"),
                            M.decision_tree_classifier(max_depth, max_bins, min_instances, label=label)])
    m = pipe.fit(train)
    f1 = MulticlassClassificationEvaluator(labelCol=label, metricName="f1").evaluate(m.transform(val))
    return m, f1


def _auto(df: DataFrame, label: str, numeric, categorical, families, evaluator, max_trials: int,
          timeout_minutes: float, parallelism: int, seed: int, folds: int, key, log, experiment: str) -> DataFrame:
    """Shared body of V9 / V10: random search over the families in turn, so every family is tried whatever
    ``parallelism`` is, until trials or time run out.  Feature stages are fitted on each split's training rows."""
    deadline = time.time() + timeout_minutes * 60
    named = df.withColumn("_fold", fold_number(df, folds, key or [*numeric, *categorical, label], "auto"))
    data = named.select("_fold", F.col(quoted(label)).cast("double").alias("label"),
                        *[F.col(quoted(c)).alias(f"n{i}") for i, c in enumerate(numeric)],
                        *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(categorical)]).where(F.col("label").isNotNull() & ~F.isnan("label"))
    features = FoldFeatures(data, [f"n{i}" for i in range(len(numeric))], [f"c{i}" for i in range(len(categorical))], "_fold")
    names = list(families)
    drawn = {f: draw_param_maps(*families[f], -(-max_trials // len(names)), seed + i) for i, f in enumerate(names)}
    trials = [Trial(f, families[f][0], drawn[f][i // len(names)])
              for i in range(max_trials) for f in [names[i % len(names)]]]
    run_trials(data, trials, evaluator, folds, parallelism=parallelism, deadline=deadline, fold_col="_fold", features=features)
    log_trials(log, experiment, trials, evaluator.getMetricName())
    return board_of(df.sparkSession, trials, evaluator.isLargerBetter())


def auto_classify(df: DataFrame, label: str, numeric, categorical, max_trials: int = 30,
                  timeout_minutes: float = 60, parallelism: int = 4, metric: str = "areaUnderROC",
                  seed: int = 42, folds: int = 3, key: Sequence[str] | None = None, log: RunLog | None = None,
                  experiment: str = "auto_classify") -> DataFrame:
    """V9: bounded automatic search over logistic regression, tree, forest, boosted trees."""
    S = Space
    fams = {
        "logistic_regression": (M.logistic_regression(), {"regParam": S("loguniform", 1e-4, 1.0),
                                                          "elasticNetParam": S("uniform", 0.0, 1.0)}),
        "decision_tree": (M.decision_tree_classifier(), {"maxDepth": S("randint", 2, 10),
                                                         "minInstancesPerNode": S("randint", 1, 20)}),
        "random_forest": (M.random_forest_classifier(), {"numTrees": S("randint", 10, 50),
                                                         "maxDepth": S("randint", 2, 10)}),
        "gbt": (M.gbt_classifier(), {"maxDepth": S("randint", 2, 6), "stepSize": S("loguniform", 0.01, 0.3)}),
    }
    ev = BinaryClassificationEvaluator(labelCol="label", metricName=metric)
    return _auto(df, label, numeric, categorical, fams, ev, max_trials, timeout_minutes, parallelism, seed, folds,
                 key, log, experiment)


def auto_regress(df: DataFrame, label: str, numeric, categorical, max_trials: int = 30,
                 timeout_minutes: float = 60, parallelism: int = 4, metric: str = "rmse",
                 seed: int = 42, folds: int = 3, key: Sequence[str] | None = None, log: RunLog | None = None,
                 experiment: str = "auto_regress") -> DataFrame:
    """The same over tree, forest, boosted trees and linear regression."""
    S = Space
    fams = {
        "linear_regression": (M.linear_regression(), {"regParam": S("loguniform", 1e-4, 1.0)}),
        "decision_tree": (M.decision_tree_regressor(), {"maxDepth": S("randint", 2, 10)}),
        "random_forest": (M.random_forest_regressor(), {"numTrees": S("randint", 10, 50),
                                                        "maxDepth": S("randint", 2, 10)}),
        "gbt": (M.gbt_regressor(), {"maxDepth": S("randint", 2, 6), "stepSize": S("loguniform", 0.01, 0.3)}),
    }
    ev = RegressionEvaluator(labelCol="label", metricName=metric)
    return _auto(df, label, numeric, categorical, fams, ev, max_trials, timeout_minutes, parallelism, seed, folds,
                 key, log, experiment)


RUN_SCHEMA = ("run_id string, experiment string, run_name string, params map<string,string>, "
              "metrics map<string,double>, tags map<string,string>, logged_at timestamp")


class RunLog:
    """Append-only runs table (params, metrics, tags per run) with best-run lookup.

    Rows go to a parquet folder (the cluster's shared storage) by append; a
    run id makes a retried write recognisable.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self, experiment: str, run_name: str, params: Mapping, metrics: Mapping, tags: Mapping | None = None,
            run_id: str | None = None) -> str:
        return self.log_many(experiment, [(run_name, params, metrics, tags or {})], [run_id or uuid.uuid4().hex])[0]

    def log_many(self, experiment: str, runs: Sequence[tuple[str, Mapping, Mapping, Mapping]],
                 run_ids: Sequence[str] | None = None) -> list[str]:
        """Append several runs (name, params, metrics, tags) in one write."""
        import datetime as dt
        ids = list(run_ids or [uuid.uuid4().hex for _ in runs])
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        rows = [(i, experiment, name, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()},
                 {k: str(v) for k, v in tags.items()}, now) for i, (name, params, metrics, tags) in zip(ids, runs)]
        self.spark.createDataFrame(rows, RUN_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return ids

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(self.path).dropDuplicates(["run_id"])

    def best(self, experiment: str, metric: str, larger_is_better: bool = True) -> DataFrame:
        r = self.runs().where(F.col("experiment") == experiment).withColumn("_m", F.col("metrics")[metric])
        o = F.col("_m").desc_nulls_last() if larger_is_better else F.col("_m").asc_nulls_last()
        return r.orderBy(o, "run_id").limit(1).drop("_m")
