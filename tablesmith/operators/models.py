"""Learners (M1-M9): Spark ML estimators with the reference's settings.

Each builder returns an unfitted estimator; ``fit_predict`` fits it on a
frame with a vector column and returns prediction rows.  Training runs on
the executors (tree aggregation, distributed gradients).
"""

from __future__ import annotations

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame

# fixed values: Spark refuses deeper trees
MAX_TREE_DEPTH = 30
# machines of a one-vs-rest model that are fitted at a time
CLASSES_AT_A_TIME = 8


def _depth(d: int) -> int:
    if int(d) > MAX_TREE_DEPTH:
        raise ValueError(f"tree depth {d}: Spark's trees go to {MAX_TREE_DEPTH}")
    return int(d)


def logistic_regression(max_iter: int = 100, reg: float = 0.0, elastic_net: float = 0.0,
                        features: str = "features", label: str = "label") -> LogisticRegression:
    """M1 (C of a library model ~ 1 / (n * regParam); l1 -> elasticNet 1, l2 -> 0)."""
    return LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter, regParam=reg,
                              elasticNetParam=elastic_net)


def decision_tree_classifier(max_depth: int = 5, max_bins: int = 32, min_instances: int = 1,
                             impurity: str = "gini", features: str = "features", label: str = "label",
                             seed: int = 42) -> DecisionTreeClassifier:
    """M2."""
    return DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=_depth(max_depth), maxBins=max_bins,
                                  minInstancesPerNode=min_instances, impurity=impurity, seed=seed)


def random_forest_classifier(num_trees: int = 20, max_depth: int = 5, features: str = "features",
                             label: str = "label", seed: int = 42) -> RandomForestClassifier:
    """M3."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=num_trees,
                                  maxDepth=_depth(max_depth), seed=seed)


def linear_svc(reg: float = 0.0, max_iter: int = 100, multiclass: bool = True, features: str = "features",
               label: str = "label"):
    """M4: linear SVM (kernel SVMs have no distributed form); one-vs-rest for >2 classes.

    A solver runs hundreds of short jobs one after the other; several classes' machines share the cluster meanwhile.
    """
    svc = LinearSVC(featuresCol=features, labelCol=label, regParam=reg, maxIter=max_iter)
    return OneVsRest(classifier=svc, featuresCol=features, labelCol=label, parallelism=CLASSES_AT_A_TIME) if multiclass else svc


def gbt_classifier(max_iter: int = 20, step_size: float = 0.1, max_depth: int = 5, min_instances: int = 1,
                   subsampling_rate: float = 1.0, feature_subset: str = "all", features: str = "features",
                   label: str = "label", seed: int = 42) -> GBTClassifier:
    """M5."""
    return GBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter, stepSize=step_size,
                         maxDepth=_depth(max_depth), minInstancesPerNode=min_instances,
                         subsamplingRate=subsampling_rate, featureSubsetStrategy=feature_subset, seed=seed)


def decision_tree_regressor(max_depth: int = 5, max_bins: int = 32, features: str = "features",
                            label: str = "label", seed: int = 42) -> DecisionTreeRegressor:
    """M6 (``model.toDebugString`` gives the tree text)."""
    return DecisionTreeRegressor(featuresCol=features, labelCol=label, maxDepth=_depth(max_depth), maxBins=max_bins,
                                 seed=seed)


def random_forest_regressor(num_trees: int = 20, max_depth: int = 5, features: str = "features",
                            label: str = "label", seed: int = 42) -> RandomForestRegressor:
    """M7."""
    return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=num_trees,
                                 maxDepth=_depth(max_depth), seed=seed)


def gbt_regressor(max_iter: int = 20, max_depth: int = 5, step_size: float = 0.1, features: str = "features",
                  label: str = "label", seed: int = 42) -> GBTRegressor:
    """M8."""
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=max_iter, maxDepth=_depth(max_depth),
                        stepSize=step_size, seed=seed)


def linear_regression(reg: float = 0.0, elastic_net: float = 0.0, features: str = "features",
                      label: str = "label") -> LinearRegression:
    """M9 (the one-feature case equals SQL ``regr_slope`` / ``regr_intercept``)."""
    return LinearRegression(featuresCol=features, labelCol=label, regParam=reg, elasticNetParam=elastic_net)


CLASSIFIERS = {"logistic_regression": logistic_regression, "decision_tree": decision_tree_classifier,
               "random_forest": random_forest_classifier, "gbt": gbt_classifier, "linear_svc": linear_svc}
REGRESSORS = {"decision_tree": decision_tree_regressor, "random_forest": random_forest_regressor,
              "gbt": gbt_regressor, "linear_regression": linear_regression}


def fit_predict(estimator, train: DataFrame, score: DataFrame | None = None):
    """Fit on ``train``; return (model, predictions on ``score`` or ``train``)."""
    m = estimator.fit(train)
    return m, m.transform(score if score is not None else train)
