"""Boosted regression trees on cells, with a rule for equal gains.

In deep trees a node may hold a few cells that several features part alike.  Their gains are equal but for the last bits
of sums taken in another order, and a learner that takes the largest lets these bits choose: the gain then goes to one
feature or the other by the partitions of the rows.  Here gains count as equal if they differ by less than ``SLACK`` of
the node's mean squared label; of equal gains the first feature's lowest cut wins, and one below the slack is none.
Otherwise the trees are Spark ML's: squared loss, the first tree with weight one, each further one on twice the residuals.

A level of a tree is one grouping of the cells by node, feature and piece; the sums reach the driver (at most
2 ** level * features * pieces rows), the cells stay in a table that each round writes anew with its scores.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.plans.cells import FINER, cells_of, fits_cells
from tablesmith.session import cut_lineage, temporary_tables

#: Share of a node's mean squared label below which two gains are equal: above what sums round off, below what rows give.
SLACK = 1e-12
#: Cells that a task takes at least; as many need no shuffle.
CELLS_PER_TASK = 50_000
_NO_CUT = 2 ** 31 - 1


def _array(values) -> str:
    return f"array({', '.join(f'{v!r}D' if isinstance(v, float) else str(v) for v in values)})"


@dataclass
class _Split:
    feature: int
    piece: int
    worth: float  # gain times rows
    left: float  # mean labels
    right: float


@dataclass
class _Grown:
    """Splits by node (root 1, children 2 n and 2 n + 1); a node without one passes its rows on to 2 n."""
    splits: dict[int, _Split] = field(default_factory=dict)
    means: dict[int, float] = field(default_factory=dict)

    def nodes(self, rows: DataFrame, levels: int) -> DataFrame:
        """``rows`` with ``_node``, their node ``levels`` below the root."""
        size = 2 ** levels
        at = [self.splits.get(n) for n in range(size)]
        feature, cut = _array(s.feature if s else 0 for s in at), _array(s.piece if s else _NO_CUT for s in at)
        rows = rows.selectExpr("*", "1 AS _node")
        for _ in range(levels):
            rows = rows.selectExpr("* EXCEPT (_node)", f"_node * 2 + int(get(_piece, get({feature}, _node)) > get({cut}, _node)) AS _node")
        return rows

    def leaf(self, depth: int) -> Column:
        return F.expr(f"get({_array(self.means.get(n, 0.0) for n in range(2 ** (depth + 1)))}, _node)")


def _best(sums: dict[int, list[tuple]]) -> tuple[_Split | None, float]:
    """The split of a node from its (piece, weight, sum, sum of squares) by feature, and its mean label."""
    any_feature = next(iter(sums.values()))
    n, s, ss = (sum(row[i] for row in any_feature) for i in (1, 2, 3))
    found = []
    for feature in sorted(sums):
        ln = ls = 0.0
        for piece, w, y, _ in sorted(sums[feature])[:-1]:
            ln, ls = ln + w, ls + y
            left, right = ls / ln, (s - ls) / (n - ln)
            found.append(_Split(feature, piece, (left - right) ** 2 * ln * (n - ln) / n, left, right))
    slack = SLACK * ss
    top = max((f.worth for f in found), default=0.0)
    return (next(f for f in found if f.worth >= top - slack) if top > slack else None), s / n


def _grow(rows: DataFrame, depth: int) -> _Grown:
    tree = _Grown()
    for level in range(depth):
        long = tree.nodes(rows, level).selectExpr("_node", "_weight", "_y", "posexplode(_piece) AS (_feature, _at)")
        sums: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for node, feature, *row in long.groupBy("_node", "_feature", "_at").agg(
                F.expr("sum(_weight)"), F.expr("sum(_weight * _y)"), F.expr("sum(_weight * _y * _y)")).collect():  # nodes * features * pieces
            sums[node][feature].append(tuple(row))
        for node, by_feature in sums.items():
            split, mean = _best(by_feature)
            tree.means[2 * node] = mean
            if split:
                tree.splits[node] = split
                tree.means[2 * node], tree.means[2 * node + 1] = split.left, split.right
    return tree


def boosted_importances(df: DataFrame, estimator) -> list[float]:
    """Shares of the features in the gains (times rows) of all splits of a ``GBTRegressor``'s trees; all 0 if nothing splits."""
    if not fits_cells(estimator):
        raise ValueError(f"{type(estimator).__name__} with these settings draws rows; fit it to the rows")
    depth = estimator.getMaxDepth()
    with temporary_tables(df.sparkSession) as tables:
        cells = cells_of(df, estimator, max_bins=max(1, estimator.getMaxBins() // FINER))
        worth = [0.0] * len(cells.cuts)
        tasks = -(-cells.frame.count() // CELLS_PER_TASK)
        rows = cells.frame.select(vector_to_array("_cell").cast("array<int>").alias("_piece"), "_weight", "_label",
                                  F.lit(0.0).alias("_score"), F.col("_label").alias("_y")).coalesce(tasks)
        for done in range(1, estimator.getMaxIter() + 1):
            tree = _grow(rows, depth)
            for split in tree.splits.values():
                worth[split.feature] += split.worth
            if done == estimator.getMaxIter() or not tree.splits:  # labels that never part stay so
                break
            step = 1.0 if done == 1 else estimator.getStepSize()
            rows = cut_lineage(tree.nodes(rows, depth)
                               .withColumn("_score", F.col("_score") + F.lit(step) * tree.leaf(depth))
                               .select("_piece", "_weight", "_label", "_score", (2 * (F.col("_label") - F.col("_score"))).alias("_y"))).coalesce(tasks)
            tables.release(keep=rows)
        tables.release()
    total = sum(worth)
    return [w / total if total > 0 else 0.0 for w in worth]
