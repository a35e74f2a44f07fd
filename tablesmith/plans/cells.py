"""Regression trees from sums per cell instead of from rows.

A tree with bins asks of its rows only how many lie in each bin of each feature and what their labels add up to.
``cells_of`` cuts every feature into at most ``FINER`` times the estimator's ``maxBins`` pieces and groups the rows by
them once: a cell has its rows' weight and mean label.  Spark ML's estimator then fits the cells with their
weights.  What the labels of a cell spread around their mean cancels in every gain of a variance split and in every
residual of squared loss, so the tree is the one that the rows give; only row-wise draws (bootstrap, subsampling,
absolute loss) are not, and such estimators are refused.

A feature with no more values than pieces keeps each value, and its cuts lie midway between neighbours; one with more
is cut at approximate quantiles.  Cells are as many as combinations that occur: bounded by the pieces for a handful of
features, by the rows for many.  ``CellModel`` scores raw rows by a column expression with the cuts as thresholds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import quoted
from tablesmith.session import cut_lineage

#: Pieces of a feature for each of the estimator's bins: the estimator still chooses among finer cuts than it keeps.
FINER = 2


def fits_cells(estimator) -> bool:
    """Whether cells give the estimator the same tree as their rows."""
    if isinstance(estimator, GBTRegressor):
        return (estimator.getLossType() == "squared" and estimator.getSubsamplingRate() == 1.0 and estimator.getMinInstancesPerNode() == 1
                and not estimator.isDefined("validationIndicatorCol"))
    return isinstance(estimator, DecisionTreeRegressor) and estimator.getMinInstancesPerNode() == 1 and not estimator.isSet("varianceCol")


def _cuts(slots: DataFrame, names: Sequence[str], pieces: int) -> list[list[float]]:
    """Ascending cuts of each slot; a value belongs behind all cuts below it."""
    about = slots.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    few = {c for c in names if about[c] <= 1.2 * pieces}  # the estimate is off by a few hundredths
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    found = slots.agg(*[F.collect_set(c).alias(c) if c in few else F.percentile_approx(c, shares, F.lit(100 * pieces)).alias(c)
                        for c in names]).first()
    values = {c: sorted(set(found[c] or [])) for c in names}
    return [[(a + b) / 2 for a, b in zip(values[c], values[c][1:])] if c in few else values[c] for c in names]


def _number(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def _piece(x: str, cuts: Sequence[float], low: int = 0) -> str:
    """SQL text of the number of cuts below ``x``, by halving."""
    if not cuts:
        return str(low)
    mid = len(cuts) // 2
    return (f"CASE WHEN {x} <= {_number(cuts[mid])} THEN {_piece(x, cuts[:mid], low)} "
            f"ELSE {_piece(x, cuts[mid + 1:], low + mid + 1)} END")


@dataclass
class Cells:
    """``frame`` has a row per cell: the columns it was split by, ``_cell`` (vector of pieces), ``_label`` and ``_weight``."""
    frame: DataFrame
    cuts: list[list[float]]
    features: str

    def fit(self, estimator, where: Column | None = None, extra: dict | None = None) -> CellModel:
        inner = estimator.copy(extra).setFeaturesCol("_cell").setLabelCol("_label").setWeightCol("_weight")
        return CellModel(inner.fit(self.frame if where is None else self.frame.where(where)), self.cuts, self.features,
                         estimator.getPredictionCol())


def cells_of(df: DataFrame, estimator, by: Sequence[str] = (), max_bins: int | None = None) -> Cells:
    """The cells of ``df`` for a tree regressor, apart for each value of the ``by`` columns; two passes for the cuts, one for the sums."""
    features, label = estimator.getFeaturesCol(), F.col(quoted(estimator.getLabelCol())).cast("double")
    weight = F.col(quoted(estimator.getWeightCol())).cast("double") if estimator.isDefined("weightCol") and estimator.getWeightCol() else F.lit(1.0)
    rows = df.select(*[F.col(quoted(c)).alias(f"_by{i}") for i, c in enumerate(by)], label.alias("_y"), weight.alias("_w"),
                     vector_to_array(F.col(quoted(features))).alias("_a"))
    one = rows.select(F.size("_a").alias("n")).first()
    if one is None:
        raise ValueError("no rows to fit")
    names = [f"_x{j}" for j in range(one["n"])]
    slots = rows.select(*[c for c in rows.columns if c != "_a"], *[F.col("_a")[j].alias(c) for j, c in enumerate(names)])
    cuts = _cuts(slots, names, FINER * (max_bins or estimator.getMaxBins()))
    groups = [*[f"_by{i}" for i in range(len(by))], *names]
    binned = slots.select(*groups[:len(by)], "_y", "_w", *[F.expr(_piece(c, cuts[j])).cast("double").alias(c) for j, c in enumerate(names)])
    summed = cut_lineage(binned.groupBy(*groups).agg(
        F.sum("_w").alias("_weight"), F.try_divide(F.sum(F.col("_y") * F.col("_w")), F.sum("_w")).alias("_label"),
        F.count_if(F.col("_y").isNull() | F.isnan("_y")).alias("_bad")))
    if summed.agg(F.sum("_bad").alias("n")).first()["n"]:
        raise ValueError("labels must be neither null nor NaN")
    vec = VectorAssembler(inputCols=names, outputCol="_cell").transform(summed.where(F.col("_weight") > 0))
    frame = vec.select(*[F.col(f"_by{i}").alias(c) for i, c in enumerate(by)], "_cell", "_label", "_weight")
    return Cells(frame, cuts, features)


class CellModel(Model):
    """A tree model fitted to cells, for raw feature vectors."""

    def __init__(self, tree, cuts: list[list[float]], features: str, prediction: str):
        super().__init__()
        self.tree, self.cuts, self.features, self.prediction = tree, cuts, features, prediction

    @property
    def numFeatures(self) -> int:
        return self.tree.numFeatures

    @property
    def featureImportances(self):
        return self.tree.featureImportances

    def threshold(self, feature: int, piece: float) -> float:
        """The raw value that a split between pieces stands for."""
        return self.cuts[feature][math.floor(piece)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from tablesmith.plans.trees import TreeModel
        names = [f"_slot{j}" for j in range(self.numFeatures)]
        parts = dataset.withColumn("_slots", vector_to_array(F.col(quoted(self.features)))).withColumns(
            {c: F.col("_slots")[j] for j, c in enumerate(names)})
        return parts.withColumn(self.prediction, TreeModel(self, names).prediction()).drop("_slots", *names)


class CellFit(Estimator):
    """Fits a tree regressor to the cells of a frame."""

    def __init__(self, inner):
        super().__init__()
        if not fits_cells(inner):
            raise ValueError(f"{type(inner).__name__} with these settings draws rows; fit it to the rows")
        self.inner = inner

    def _fit(self, dataset: DataFrame) -> CellModel:
        return cells_of(dataset, self.inner).fit(self.inner)
