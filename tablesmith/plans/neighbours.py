"""Nearest-neighbour mutual information of many (feature, target) pairs, exact, without all pairs.

The estimator of Kraskov et al.: eps_i is the distance of point i to its k-th nearest other
point under the maximum norm of the two scaled columns; nx_i and ny_i count the other
points whose single coordinate is closer than eps_i (those equal to it where eps_i is 0);
MI = psi(n) + psi(k) - mean(psi(nx + 1) + psi(ny + 1)), at least 0.

Distances.  Equal points are one point with a weight, so a hot value is one row.  Quantile
cuts in x, then in y within each strip, give boxes of about ``BOX`` points.  A box finds
its points' k nearest inside; where the square of that radius leaves the box, the point
visits the boxes that the square touches, and the k smallest of all answers are final: the
radius from its own box is an upper bound, so no other box can matter.

Counts.  Distinct coordinates with their weights are cut into slices of about ``SLICE``
values.  A point whose interval lies in its slice is counted there by binary search; one
that leaves it asks the slices of its two ends, whose totals below are known.  The lookups of a
slice are dealt out in groups of about ``LOOKUPS``, each with a copy of the slice.

Everything runs in groups of bounded size; only cuts and totals reach the driver, at most
``BOXES`` of them a feature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.columns import nan_to_null, quoted
from tablesmith.session import cut_lineage

# fixed tuning values
BOX = 512
BOXES = 1 << 18
SLICE = 20_000
LOOKUPS = 100_000
STEPS = 1 << 24      # of a scaled value
MAX_CUTS = 4096      # cuts of one strip or one column


def digamma(n: np.ndarray) -> np.ndarray:
    """psi of whole numbers from 1."""
    n = np.asarray(n, dtype=np.float64)
    small = np.array([-0.5772156649015329 + sum(1 / i for i in range(1, j)) for j in range(1, 12)])
    x = np.maximum(n, 11.0)
    far = np.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6) + 1 / (240 * x ** 8)
    return np.where(n < 11, small[np.clip(n.astype(np.int64) - 1, 0, 10)], far)


def _distinct(cuts: Sequence[float] | None) -> np.ndarray:
    return np.unique(np.array([] if cuts is None else cuts, dtype=np.float64))


class Boxes:
    """The boxes of all features: ascending cuts in x, and per strip ascending cuts in y."""

    def __init__(self, x_cuts: dict[int, np.ndarray]):
        self.x_cuts = x_cuts
        self.y_cuts: dict[tuple[int, int], np.ndarray] = {}

    def strips(self, f: int, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.x_cuts[f], x, side="right")

    def cells(self, f: int, strip: int, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.y_cuts.get((f, strip), np.zeros(0)), y, side="right")

    def bounds(self, f: int, strip: int, cell: int) -> tuple[float, float, float, float]:
        """Least and greatest x and y that the box can hold (the greatest excluded)."""
        x, y = self.x_cuts[f], self.y_cuts.get((f, strip), np.zeros(0))

        def ends(cuts: np.ndarray, at: int) -> tuple[float, float]:
            return (cuts[at - 1] if at else -math.inf), (cuts[at] if at < len(cuts) else math.inf)
        return (*ends(x, strip), *ends(y, cell))

    def touched(self, f: int, x: float, y: float, r: float, strip: int, cell: int) -> Iterator[tuple[int, int]]:
        """Boxes that the open square of radius ``r`` touches, without (strip, cell)."""
        for s in range(int(self.strips(f, x - r)), int(self.strips(f, x + r)) + 1):
            for c in range(int(self.cells(f, s, y - r)), int(self.cells(f, s, y + r)) + 1):
                if (s, c) != (strip, cell):
                    yield s, c


def k_nearest(px: np.ndarray, py: np.ndarray, pw: np.ndarray, qx: np.ndarray, qy: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Per query the k smallest distances to the points, a point of weight w counting w times; infinity where there are fewer.

    ``own``: the queries are the points, and one copy of each is itself.
    """
    out = np.full((len(qx), k), np.inf)
    if not len(px):
        return out
    step = max(1, (1 << 21) // len(px))
    for lo in range(0, len(qx), step):
        hi = min(lo + step, len(qx))
        d = np.maximum(np.abs(px[None, :] - qx[lo:hi, None]), np.abs(py[None, :] - qy[lo:hi, None]))
        take = min(k + 1, len(px))
        at = np.argpartition(d, take - 1, axis=1)[:, :take] if take < len(px) else np.broadcast_to(np.arange(len(px)), d.shape)
        near, weight = np.take_along_axis(d, at, axis=1), pw[at].astype(np.int64)
        if own:  # the point itself is at distance 0, so it is among them
            weight = weight - (at == np.arange(lo, hi)[:, None])
        order = np.argsort(near, axis=1, kind="stable")
        near, upto = np.take_along_axis(near, order, axis=1), np.cumsum(np.take_along_axis(weight, order, axis=1), axis=1)
        for c in range(k):
            j = (upto <= c).sum(axis=1)
            has = j < take
            out[lo:hi, c][has] = near[has, j[has]]
    return out


def _with_codes(points: DataFrame, boxes, strips_only: bool) -> DataFrame:
    """``points`` (f, x, y, w) with strip, and with cell."""
    shared = points.sparkSession.sparkContext.broadcast(boxes)
    extra = "strip int" if strips_only else "strip int, cell int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Boxes = shared.value
        for batch in batches:
            f, x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            strip, cell = np.zeros(len(f), dtype=np.int32), np.zeros(len(f), dtype=np.int32)
            for g in np.unique(f).tolist():
                m = np.flatnonzero(f == g)
                strip[m] = b.strips(g, x[m])
                if not strips_only:
                    order = m[np.argsort(strip[m], kind="stable")]
                    s = strip[order]
                    for part in np.split(order, np.flatnonzero(s[1:] != s[:-1]) + 1):
                        cell[part] = b.cells(g, int(strip[part[0]]), y[part])
            made = [pa.array(strip)] if strips_only else [pa.array(strip), pa.array(cell)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *extra.replace(" int", "").split(", ")])
    return points.mapInArrow(run, f"f int, x double, y double, w long, {extra}")


def make_boxes(points: DataFrame, sizes: dict[int, int]) -> Boxes:
    """Cuts from two aggregates of sketches; they only decide who works where."""
    width = {f: max(BOX, m / BOXES) for f, m in sizes.items()}
    strips = {f: min(MAX_CUTS, max(1, math.ceil(math.sqrt(m / width[f])))) for f, m in sizes.items()}
    most = max(strips.values())
    probs = [i / most for i in range(1, most)]
    found = points.groupBy("f").agg(F.percentile_approx("x", probs or [0.5], 10_000).alias("cuts")).collect()
    x_cuts = {}
    for r in found:
        n = strips[r.f]
        x_cuts[r.f] = _distinct([r.cuts[most * i // n - 1] for i in range(1, n)])
    boxes = Boxes(x_cuts)
    per = _with_codes(points, boxes, True).groupBy("f", "strip")
    counts = {(r.f, r.strip): r.n for r in per.agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per strip
    need = {key: min(MAX_CUTS, math.ceil(n / width[key[0]])) for key, n in counts.items()}
    most = max(need.values())
    if most > 1:
        for r in per.agg(F.percentile_approx("y", [i / most for i in range(1, most)], 10_000).alias("cuts")).collect():
            n = need[r.f, r.strip]
            boxes.y_cuts[r.f, r.strip] = _distinct([r.cuts[most * i // n - 1] for i in range(1, n)])
    return boxes


def radii(points: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """(f, x, y, w, eps): every distinct point's distance to its k-th nearest other point."""
    spark = points.sparkSession
    boxes = make_boxes(points, sizes)
    shared = spark.sparkContext.broadcast(boxes)
    placed = cut_lineage(_with_codes(points, boxes, False))

    def inside(key, pdf):
        f, strip, cell = (int(v) for v in key)
        b: Boxes = shared.value
        x, y, w = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy()
        best = k_nearest(x, y, w, x, y, k, own=True)
        x0, x1, y0, y1 = b.bounds(f, strip, cell)
        margin = np.minimum(np.minimum(x - x0, x1 - x), np.minimum(y - y0, y1 - y))
        rows = []
        for i, r in enumerate(best[:, -1].tolist()):
            visits = [] if r <= margin[i] else list(b.touched(f, x[i], y[i], r, strip, cell))
            rows.append(([s for s, _ in visits], [c for _, c in visits]))
        return pd.DataFrame({"f": f, "x": x, "y": y, "w": w, "best": list(best), "strips": [r[0] for r in rows], "cells": [r[1] for r in rows]})

    first = cut_lineage(placed.groupBy("f", "strip", "cell").applyInPandas(
        inside, "f int, x double, y double, w long, best array<double>, strips array<int>, cells array<int>"))
    visits = first.select("f", "x", "y", F.explode(F.arrays_zip("strips", "cells")).alias("to")).select(
        "f", "x", "y", F.lit(0).cast("long").alias("w"), F.col("to.strips").alias("strip"), F.col("to.cells").alias("cell"))

    def visited(key, pdf):
        x, y, w = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy()
        p, q = w > 0, w == 0
        best = k_nearest(x[p], y[p], w[p], x[q], y[q], k, own=False)
        return pd.DataFrame({"f": int(key[0]), "x": x[q], "y": y[q], "best": list(best)})

    wanted = placed.join(visits.select("f", "strip", "cell").distinct(), ["f", "strip", "cell"], "left_semi").select(*visits.columns)
    answers = wanted.unionByName(visits).groupBy("f", "strip", "cell").applyInPandas(visited, "f int, x double, y double, best array<double>")
    everyone = first.select("f", "x", "y", "w", "best").unionByName(answers.withColumn("w", F.lit(0).cast("long")))
    merged = everyone.groupBy("f", "x", "y").agg(F.max("w").alias("w"), F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))
    return merged.select("f", "x", "y", "w", F.col("best")[k - 1].alias("eps"))


def _slices(values: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Cuts of each (feature, axis) into slices of about ``SLICE`` distinct values."""
    sizes = {(r.f, r.axis): r.n for r in values.groupBy("f", "axis").agg(F.count(F.lit(1)).alias("n")).collect()}
    need = {key: min(MAX_CUTS, math.ceil(n / SLICE)) for key, n in sizes.items()}
    most = max(need.values())
    if most == 1:
        return {key: np.zeros(0) for key in sizes}
    cuts = values.groupBy("f", "axis").agg(F.percentile_approx("v", [i / most for i in range(1, most)], 10_000).alias("cuts")).collect()
    return {(r.f, r.axis): _distinct([r.cuts[most * i // need[r.f, r.axis] - 1] for i in range(1, need[r.f, r.axis])]) for r in cuts}


def _in_slice(df: DataFrame, cuts, at: str, out: str) -> DataFrame:
    """The slice of column ``at`` for each row (f, axis, ...)."""
    shared = df.sparkSession.sparkContext.broadcast(cuts)
    names = df.columns
    where = [names.index(c) for c in ("f", "axis", at)]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, axis, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in where)
            made = np.zeros(len(f), dtype=np.int32)
            for key in set(zip(f.tolist(), axis.tolist())):
                m = np.flatnonzero((f == key[0]) & (axis == key[1]))
                made[m] = np.searchsorted(shared.value[key], v[m], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*names, out])
    return df.mapInArrow(run, schema)


def _upto(values: np.ndarray, v: np.ndarray, eps: np.ndarray, upper: bool) -> np.ndarray:
    """How many of the ascending values are within reach to the right (``upper``), or out of reach to the left.

    Decided on the differences themselves, which v + eps and v - eps only approach.
    """
    flat = eps == 0
    if upper:
        at = np.where(flat, np.searchsorted(values, v, side="right"), np.searchsorted(values, v + eps, side="left"))
    else:
        at = np.where(flat, np.searchsorted(values, v, side="left"), np.searchsorted(values, v - eps, side="right"))
    padded = np.concatenate([values, [np.inf]])
    for _ in range(3):  # a rounding error is a neighbouring value or two
        here, before = padded[at], padded[at - 1]
        if upper:
            on, back = ~flat & (here - v < eps), ~flat & (at > 0) & (before - v >= eps)
        else:
            on, back = ~flat & (here <= v) & (v - here >= eps), ~flat & (at > 0) & (v - before < eps)
        if not (on.any() or back.any()):
            break
        at = at + on - (back & ~on)
    return at


def mean_digammas(found: DataFrame) -> dict[int, float]:
    """Per feature the sum over all points of psi(nx + 1) + psi(ny + 1)."""
    sides = F.array(F.struct(F.lit(0).alias("axis"), F.col("x").alias("v")), F.struct(F.lit(1).alias("axis"), F.col("y").alias("v")))
    rows = found.select("f", "w", "eps", F.explode(sides).alias("s")).select("f", "s.axis", "s.v", "w", "eps")
    values = cut_lineage(rows.groupBy("f", "axis", "v").agg(F.sum("w").alias("w")))
    lookups = rows.groupBy("f", "axis", "v", "eps").agg(F.sum("w").alias("times"))
    cuts = _slices(values)
    values = cut_lineage(_in_slice(values, cuts, "v", "slice"))
    lookups = cut_lineage(_in_slice(lookups, cuts, "v", "slice"))
    below: dict[tuple[int, int, int], int] = {}
    totals = {(r.f, r.axis, r.slice): r.w for r in values.groupBy("f", "axis", "slice").agg(F.sum("w").alias("w")).collect()}
    running: dict[tuple[int, int], int] = {}
    for key in sorted(totals):
        below[key] = running.get(key[:2], 0)
        running[key[:2]] = below[key] + totals[key]
    shared = found.sparkSession.sparkContext.broadcast((cuts, below))

    def home(key, pdf):
        f, axis, piece = (int(x) for x in key[:3])
        mine = shared.value[0][f, axis]
        lo = mine[piece - 1] if piece else -math.inf
        hi = mine[piece] if piece < len(mine) else math.inf
        is_value = pdf["times"].to_numpy() == 0
        stock = pdf[is_value].sort_values("v")
        v = stock["v"].to_numpy()
        upto = np.concatenate([[0], np.cumsum(stock["w"].to_numpy())])
        ask = pdf[~is_value]
        av, ae, times = ask["v"].to_numpy(), ask["eps"].to_numpy(), ask["times"].to_numpy()
        local = (av - ae > lo) & (av + ae < hi) | (ae == 0)  # the ends' own neighbourhood is inside, too
        n = upto[_upto(v, av, ae, True)] - upto[_upto(v, av, ae, False)]
        done = float((digamma(n[local]) * times[local]).sum())  # n counts the point itself: psi(others + 1)
        away = ~local
        return pd.DataFrame({"f": f, "axis": axis, "v": [0.0, *av[away]], "eps": [0.0, *ae[away]], "times": [0, *times[away]], "psi": [done] + [0.0] * int(away.sum())})

    stock = values.select("f", "axis", "slice", "v", "w", F.lit(0.0).alias("eps"), F.lit(0).cast("long").alias("times"))
    asks = lookups.select("f", "axis", "slice", "v", F.lit(0).cast("long").alias("w"), "eps", "times")
    got = cut_lineage(_dealt(stock, asks).applyInPandas(home, "f int, axis int, v double, eps double, times long, psi double"))
    away = got.where("times > 0")
    # The k-th neighbour lies exactly at v - eps: a rounding error must not put that place into the slice before it.
    low = F.col("v") - F.col("eps") + (F.abs("v") + F.col("eps")) * F.lit(5e-16)
    ends = F.array(F.struct(F.lit(1).alias("side"), (F.col("v") + F.col("eps")).alias("at")),
                   F.struct(F.lit(-1).alias("side"), low.alias("at")))
    halves = _in_slice(away.select("f", "axis", "v", "eps", "times", F.explode(ends).alias("e")).select("f", "axis", "v", "eps", "times", "e.side", "e.at"),
                       cuts, "at", "slice")

    def end(key, pdf):
        f, axis, piece = (int(x) for x in key[:3])
        is_value = pdf["times"].to_numpy() == 0
        stock = pdf[is_value].sort_values("v")
        v = stock["v"].to_numpy()
        upto = shared.value[1].get((f, axis, piece), 0) + np.concatenate([[0], np.cumsum(stock["w"].to_numpy())])
        ask = pdf[~is_value]
        av, ae, side = ask["v"].to_numpy(), ask["eps"].to_numpy(), ask["side"].to_numpy()
        n = np.where(side > 0, upto[_upto(v, av, ae, True)], -upto[_upto(v, av, ae, False)])
        return pd.DataFrame({"f": f, "axis": axis, "v": av, "eps": ae, "times": ask["times"].to_numpy(), "n": n})

    zero = F.lit(0)
    both = _dealt(stock.withColumn("side", zero), halves.select("f", "axis", "slice", "v", F.lit(0).cast("long").alias("w"), "eps", "times", "side"))
    counted = both.applyInPandas(end, "f int, axis int, v double, eps double, times long, n long")
    per = counted.groupBy("f", "axis", "v", "eps").agg(F.first("times").alias("times"), F.sum("n").alias("n"))

    def psi(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, times, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(digamma(n) * times)], names=["f", "psi"])
    far = per.select("f", "times", "n").mapInArrow(psi, "f int, psi double")
    sums = got.select("f", "psi").unionByName(far).groupBy("f").agg(F.sum("psi").alias("psi"))
    return {r.f: r.psi for r in sums.collect()}  # a row per feature


def _dealt(stock: DataFrame, asks: DataFrame):
    """Groups of one slice's values with some of its lookups: about ``LOOKUPS`` each, however many a slice has."""
    deals = asks.groupBy("f", "axis", "slice").agg(F.ceil(F.count(F.lit(1)) / F.lit(LOOKUPS)).cast("int").alias("deals"))
    deals = F.broadcast(deals)  # one row per slice, at most MAX_CUTS per feature and axis
    dealt = asks.join(deals, ["f", "axis", "slice"]).withColumn("deal", F.pmod(F.xxhash64("v", "eps"), F.col("deals")).cast("int")).drop("deals")
    copies = stock.join(deals, ["f", "axis", "slice"]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    return copies.unionByName(dealt).groupBy("f", "axis", "slice", "deal")


def _stepped(x: Column) -> Column:
    """Rounded to steps of 2^-24; no negative zero."""
    return F.floor(x * F.lit(float(STEPS)) + F.lit(0.5)) / F.lit(float(STEPS)) + F.lit(0.0)


def nearest_mutual_information(df: DataFrame, features: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """Mutual information (nats) between each feature and the target by k nearest neighbours: feature, mi.

    Both columns are divided by their (population) spread over the rows that have both; a column without spread
    is left as it is.  Scaled values are rounded to steps of 2^-24, so that the last bits of a spread do not decide
    which of two equal distances is the smaller.  Rows that miss either (null, NaN) are left out for that feature; with k or fewer rows mi is null.
    Ties keep their distance of 0 (no noise is added), so the result is the same on every run.
    """
    spark = df.sparkSession
    y = nan_to_null(F.col(quoted(target)).cast("double"))
    both = [(nan_to_null(F.col(quoted(c)).cast("double")), y) for c in features]
    stats = df.agg(*[e for i, (a, b) in enumerate(both) for e in (
        F.count(F.when(b.isNotNull(), a)).alias(f"n{i}"), F.stddev_pop(F.when(b.isNotNull(), a)).alias(f"x{i}"),
        F.stddev_pop(F.when(a.isNotNull(), b)).alias(f"y{i}"))]).first()
    use = [i for i in range(len(features)) if stats[f"n{i}"] > k]
    result = {i: None for i in range(len(features))}
    if use:
        pairs = F.array(*[F.struct(F.lit(i).alias("f"), _stepped(both[i][0] / F.lit(stats[f"x{i}"] or 1.0)).alias("x"),
                                   _stepped(both[i][1] / F.lit(stats[f"y{i}"] or 1.0)).alias("y")) for i in use])
        long = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
        points = cut_lineage(long.groupBy("f", "x", "y").agg(F.count(F.lit(1)).alias("w")))
        sizes = {r.f: r.n for r in points.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
        psi = mean_digammas(cut_lineage(radii(points, sizes, k)))
        for i in use:
            n = stats[f"n{i}"]
            result[i] = max(0.0, float(digamma(n) + digamma(k)) - psi[i] / n)
    return spark.createDataFrame([(c, result[i]) for i, c in enumerate(features)], "feature string, mi double")
