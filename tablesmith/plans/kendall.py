"""Exact Kendall tau-b without emitting all pairs.

tau_b = S / sqrt((n0 - n1) (n0 - n2)),  S = sum over pairs of sign(dx) sign(dy).

Rows are first grouped to distinct points (x, y, w).  A point set of any size is cut into
about ``CELLS`` quantile cells on both axes (ties stay in one cell, a cut value has its own).  A pair in different x-cells *and*
different y-cells has a sign known from the cells alone: those are counted from the set's small cell table.
Every other pair shares an x-cell (a "column") or a y-cell (a "row").  Columns and rows are point sets
again, with 1 / ``CELLS`` of the points each, and go through the same step until a set holds at most
``LINE_POINTS`` points; then one ``applyInPandas`` group counts it by a vectorised divide and conquer over key
blocks (``_signed_dominance``).  So no task holds more than that, whatever the data's size; each level
doubles the points and divides the sets by ``CELLS``.  A set with one x or one y has only ties and is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import quoted
from tablesmith.session import cut_lineage

#: Cells per axis of one step, and the points that one group may hold.
CELLS = 256
LINE_POINTS = 100_000

SMALL_SEGMENT = 64             # below this, a segment is finished by one dense comparison


def _signed_dominance(key: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """sum_{i,j: key_j < key_i} w_i w_j sign(y_i - y_j), vectorised.

    Points are sorted by key and split recursively at key-block boundaries;
    every left point has a smaller key than every right point, so the cross
    term is, for each right point, (weight of left points below it) minus
    (weight above it): one sort and two ``searchsorted`` calls.  A segment with
    a single key contributes nothing, so a hot key ends its recursion at once.
    """
    n = len(key)
    if n < 2 or key.min() == key.max() or y.min() == y.max():
        return 0.0            # one key (or one y) in the line: every pair is a tie
    order = np.lexsort((y, key))
    key, y, w = key[order], y[order], w[order]
    total = 0.0
    stack = [(0, n)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2 or key[lo] == key[hi - 1]:
            continue
        if hi - lo <= SMALL_SEGMENT:
            k, yy, ww = key[lo:hi], y[lo:hi], w[lo:hi]
            earlier = k[None, :] < k[:, None]                      # [i, j]: key_j < key_i
            total += float(np.sum(ww[:, None] * ww[None, :] * earlier * np.sign(yy[:, None] - yy[None, :])))
            continue
        seg = key[lo:hi]
        mid_key = seg[(hi - lo) // 2]
        split = lo + int(np.searchsorted(seg, mid_key, "left"))
        if split == lo:
            split = lo + int(np.searchsorted(seg, mid_key, "right"))
        left_y = y[lo:split]
        idx = np.argsort(left_y, kind="stable")
        ys = left_y[idx]
        cw = np.concatenate(([0.0], np.cumsum(w[lo:split][idx])))
        ry, rw = y[split:hi], w[split:hi]
        below = cw[np.searchsorted(ys, ry, "left")]
        above = cw[-1] - cw[np.searchsorted(ys, ry, "right")]
        total += float(np.dot(rw, below - above))
        stack.append((lo, split))
        stack.append((split, hi))
    return total


def kendall_tau_b(df: DataFrame, x: str, y: str) -> float | None:
    return kendall_pairs(df, [(x, y)])[(x, y)]


def kendall_pairs(df: DataFrame, pairs) -> dict:
    """tau-b for every (x, y) pair; all pairs share the same few jobs.

    Rows missing x or y are left out for that pair (pairwise complete).
    """
    pairs = list(pairs)
    parts = [F.struct(F.lit(i).alias("p"), F.col(quoted(a)).cast("double").alias("x"), F.col(quoted(b)).cast("double").alias("y"))
             for i, (a, b) in enumerate(pairs)]
    long = (df.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
            .where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")))
    # distinct points per pair, written once (they feed every step below)
    pts = cut_lineage(long.groupBy("p", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    counts = {r["p"]: r["n"] for r in pts.groupBy("p").agg(F.sum("w").alias("n")).collect()}

    def tie_sum(c):
        g = pts.groupBy("p", c).agg(F.sum("w").alias("t")).groupBy("p") \
            .agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("v"))
        return {r["p"]: r["v"] for r in g.collect()}
    n1, n2 = tie_sum("x"), tie_sum("y")
    s = dominance(pts)
    out = {}
    for i, pair in enumerate(pairs):
        n = counts.get(i, 0.0)
        if n < 2:
            out[pair] = None
            continue
        n0 = n * (n - 1) / 2
        den = math.sqrt((n0 - n1.get(i, 0.0)) * (n0 - n2.get(i, 0.0)))
        out[pair] = None if den == 0 else s.get(i, 0.0) / den
    return out


def _grid_sum(pdf: pd.DataFrame) -> float:
    """The sum over pairs of cells that differ on both axes, from one set's cell table (at most (2 * CELLS) ** 2 rows)."""
    grid = np.zeros((int(pdf["bx"].max()) + 1, int(pdf["by"].max()) + 1))
    grid[pdf["bx"], pdf["by"]] = pdf["w"]
    left = grid.cumsum(axis=0)[:-1]                       # weight in smaller x-cells, by y-cell
    upto = left.cumsum(axis=1)
    below = upto - left
    above = upto[:, -1:] - upto
    return float((grid[1:] * (below - above)).sum())


def _cell(cuts: str, value: str) -> Column:
    """Cell of a value: a cut value has a cell of its own between those of its neighbours, so a hot value
    is alone in its cell and every other cell holds a small share of the points."""
    distinct = F.array_distinct(cuts)
    return F.size(F.filter(distinct, lambda t: t < F.col(value))) + F.size(F.filter(distinct, lambda t: t <= F.col(value)))


def dominance(points: DataFrame, cells: int | None = None, line_points: int | None = None) -> dict[int, float]:
    """S of every ``p`` from its distinct weighted points (p, x, y, w)."""
    cells, line_points = cells or CELLS, line_points or LINE_POINTS
    def grouped(fn):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"p": [int(pdf["p"].iloc[0])], "s": [fn(pdf)]})
        return run

    def line(pdf: pd.DataFrame) -> float:
        return _signed_dominance(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())

    totals: dict[int, float] = {}
    probs = [i / cells for i in range(1, cells)]
    sets = points.select("p", F.col("p").cast("string").alias("part"), "x", "y", "w")
    while True:
        facts = cut_lineage(sets.groupBy("part").agg(
            F.count(F.lit(1)).alias("d"), F.percentile_approx("x", probs, 10000).alias("qx"),
            F.percentile_approx("y", probs, 10000).alias("qy"),
            ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("counts")).where("counts"))
        small, big = facts.where(F.col("d") <= line_points).select("part"), facts.where(F.col("d") > line_points)
        sums = (sets.join(small, "part", "left_semi").groupBy("p", "part").applyInPandas(grouped(line), "p int, s double"))
        more = not big.isEmpty()
        if more:
            placed = cut_lineage(sets.join(big.select("part", "qx", "qy"), "part").select(
                "p", "part", "x", "y", "w", _cell("qx", "x").alias("bx"), _cell("qy", "y").alias("by")))
            tables = placed.groupBy("p", "part", "bx", "by").agg(F.sum("w").alias("w"))
            sums = sums.unionByName(tables.groupBy("p", "part").applyInPandas(grouped(_grid_sum), "p int, s double"))
        for r in sums.groupBy("p").agg(F.sum("s").alias("s")).collect():  # one row per pair of columns
            totals[r["p"]] = totals.get(r["p"], 0.0) + r["s"]
        if not more:
            return totals
        # same x-cell: order by x itself; same y-cell, different x-cells: order by x-cell
        columns = placed.select("p", F.concat("part", F.lit("x"), "bx").alias("part"), "x", "y", "w")
        rows = placed.select("p", F.concat("part", F.lit("y"), "by").alias("part"), F.col("bx").cast("double").alias("x"), "y", "w")
        rows = rows.groupBy("p", "part", "x", "y").agg(F.sum("w").alias("w"))
        sets = cut_lineage(columns.unionByName(rows))
