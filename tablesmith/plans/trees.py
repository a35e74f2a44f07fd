"""Fitted tree models as node tables and as column expressions.

``node_table`` reads a fitted Spark ML tree, forest or boosted model through its saved
form: one row per node.  ``TreeModel`` turns the table into ``Column`` expressions over
plain columns (or an array), so a table, a SQL view or a stream is scored without the
vector column, the model object or a Python worker.

Three forms with the same values: nested CASE (compiled; for small models), the same CASE of every tree
under a lambda that adds them up (evaluated as it stands: a compiled method of that size never becomes machine
code), and a walk over literal node arrays, one step per level (for models whose plan would become too large).

Rules: a continuous split goes left when ``x <= threshold``; NaN and null go right (Spark's
model does so with NaN and cannot hold null); a categorical split goes left when the value
is listed.  Class ties go to the smaller class.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.columns import quoted
from tablesmith.plans.cells import CellModel
from tablesmith.session import ensure_checkpoint_dir

#: Up to so many nodes a model becomes nested CASE expressions.
CASE_NODES = 512
#: Up to so many nodes the trees' CASE expressions are added up by a lambda.
SUM_NODES = 8192

NODE_COLUMNS = ("tree int, weight double, node int, feature int, threshold double, categories array<double>, "
                "left int, right int, prediction double, stats array<double>")


def node_table(model) -> DataFrame:
    """One row per node: tree, weight, node, feature, threshold or (left) categories, left, right, prediction, stats.

    Leaves have feature -1.  ``stats`` are a classifier's class weights.
    """
    spark = SparkSession.active()  # also from a search's threads
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablesmith-models/{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*").join(F.broadcast(weights), "tree")  # one row per tree
    else:
        data = data.select(F.lit(0).alias("tree"), F.lit(1.0).alias("weight"), "*")
    leaf = F.col("leftChild") < 0
    some = F.col("split.leftCategoriesOrThreshold")
    continuous = F.col("split.numCategories") < 0
    return data.select(
        "tree", "weight", F.col("id").alias("node"), F.when(leaf, F.lit(-1)).otherwise(F.col("split.featureIndex")).alias("feature"),
        F.when(~leaf & continuous, F.try_element_at(some, F.lit(1))).alias("threshold"), F.when(~leaf & ~continuous, some).alias("categories"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), "prediction", F.col("impurityStats").alias("stats"))


def _number(x: float) -> str:
    return f"{float(x)!r}D" if math.isfinite(x) else f"double('{x}')"


@dataclass
class _Tree:
    weight: float
    nodes: dict[int, tuple] = field(default_factory=dict)  # node -> (feature, threshold, categories, left, right, prediction, stats)

    def depth(self) -> int:
        """Splits on the longest path; counted from the root, as children stand behind their parents."""
        level = {0: 0}
        for i in sorted(self.nodes):
            feature, _, _, left, right, _, _ = self.nodes[i]
            if feature >= 0:
                level[left] = level[right] = level[i] + 1
        return max(level.values())


class TreeModel:
    """A fitted tree model over named columns."""

    def __init__(self, model, features: Sequence[str]):
        cells = model if isinstance(model, CellModel) else None
        model = cells.tree if cells else model
        name = type(model).__name__
        self.classes = int(model.numClasses) if "Classification" in name else 0
        self.boosted, self.forest = name.startswith("GBT"), name.startswith("RandomForest")
        self.features = list(features)
        if len(self.features) != model.numFeatures:
            raise ValueError(f"the model has {model.numFeatures} features, {len(self.features)} columns are named")
        self.trees: dict[int, _Tree] = {}
        for r in node_table(model).collect():  # a fitted model's nodes: bounded by its depth and number of trees
            tree = self.trees.setdefault(r.tree, _Tree(r.weight))
            threshold = cells.threshold(r.feature, r.threshold) if cells and r.threshold is not None else r.threshold
            tree.nodes[r.node] = (r.feature, threshold, r.categories, r.left, r.right, r.prediction, r.stats)
        self.size = sum(len(t.nodes) for t in self.trees.values())

    # --- leaves

    def _leaf(self, node: tuple, k: int | None) -> float:
        """What a leaf adds: its value, or its share of class ``k``."""
        if k is None:
            return node[5]
        return node[6][k] / (sum(node[6]) if self.forest else 1.0)

    def _split(self, node: tuple) -> str:
        x = quoted(self.features[node[0]])
        if node[2] is None:
            return f"{x} <= {_number(node[1])}"
        return f"{x} IN ({', '.join(_number(c) for c in node[2])})" if node[2] else "false"

    def _case(self, tree: _Tree, k: int | None, at: int = 0) -> str:
        node = tree.nodes[at]
        if node[0] < 0:
            return _number(self._leaf(node, k))
        return f"CASE WHEN {self._split(node)} THEN {self._case(tree, k, node[3])} ELSE {self._case(tree, k, node[4])} END"

    def _walk(self, tree: _Tree, k: int | None) -> str:
        """A step per level over the node arrays; a leaf is its own successor."""
        order = sorted(tree.nodes)
        place = {n: i + 1 for i, n in enumerate(order)}
        rows = [tree.nodes[n] for n in order]
        listed = any(r[2] is not None for r in rows)
        feature = ", ".join(str(max(0, r[0]) + 1) for r in rows)
        threshold = ", ".join(_number(r[1]) if r[1] is not None else "double('NaN')" for r in rows)
        left = ", ".join(str(place[r[3]] if r[0] >= 0 else i + 1) for i, r in enumerate(rows))
        right = ", ".join(str(place[r[4]] if r[0] >= 0 else i + 1) for i, r in enumerate(rows))
        values = ", ".join(_number(self._leaf(r, k)) for r in rows)
        x = f"array({', '.join(f'double({quoted(f)})' for f in self.features)})[array({feature})[n - 1] - 1]"
        goes = f"{x} <= array({threshold})[n - 1]"
        if listed:
            sets = ", ".join(f"array({', '.join(map(_number, r[2]))})" if r[2] else "cast(array() AS array<double>)" for r in rows)
            flags = ", ".join(str(r[2] is not None).lower() for r in rows)
            goes = f"CASE WHEN array({flags})[n - 1] THEN array_contains(array({sets})[n - 1], {x}) ELSE {goes} END"
        step = f"CASE WHEN {goes} THEN array({left})[n - 1] ELSE array({right})[n - 1] END"
        last = f"aggregate(sequence(1, {max(1, tree.depth())}), 1, (n, i) -> {step})"
        return f"array({values})[{last} - 1]"

    def _tree(self, tree: _Tree, k: int | None, form: str | None) -> str:
        return self._walk(tree, k) if self._form(form) == "walk" else self._case(tree, k)

    def _form(self, form: str | None) -> str:
        return form or ("case" if self.size <= CASE_NODES else "sum" if self.size <= SUM_NODES else "walk")

    def _added(self, terms: Sequence[str], form: str | None) -> Column:
        """The sum of the trees' terms, in their order in every form."""
        if self._form(form) == "sum":
            return F.expr(f"aggregate(array({', '.join(terms)}), 0.0D, (s, x) -> s + x)")
        return F.expr(" + ".join(terms))

    # --- columns

    def raw(self, form: str | None = None) -> list[Column]:
        """Raw score per class of a classifier (margins of a boosted one)."""
        if self.boosted:
            margin = self.margin(form)
            return [-margin, margin]
        return [self._added([f"({self._tree(t, k, form)})" for t in self.trees.values()], form) for k in range(self.classes)]

    def margin(self, form: str | None = None) -> Column:
        """Weighted sum of the trees' values."""
        return self._added([f"({self._tree(t, None, form)}) * {_number(t.weight)}" for t in self.trees.values()], form)

    def prediction(self, form: str | None = None) -> Column:
        """The model's prediction as a double column."""
        if self.classes and not self.boosted:
            raw = F.array(*self.raw(form))
            return (F.array_position(raw, F.array_max(raw)) - 1).cast("double")
        if self.classes:
            return F.when(self.margin(form) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return self.margin(form) / F.lit(float(len(self.trees))) if self.forest else self.margin(form)

    def probability(self, form: str | None = None) -> list[Column]:
        """Probability per class of a classifier."""
        if self.boosted:
            one = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * self.margin(form)))
            return [F.lit(1.0) - one, one]
        raw = self.raw(form)
        total = sum(raw[1:], raw[0])
        return [F.when(total == 0, F.lit(0.0)).otherwise(r / total) for r in raw]


def tree_score(df: DataFrame, model, features: Sequence[str], out: str = "prediction", form: str | None = None) -> DataFrame:
    """``df`` with the model's prediction as a column, computed from plain columns in the JVM."""
    return df.withColumn(out, TreeModel(model, features).prediction(form))
