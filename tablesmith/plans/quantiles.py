"""Exact and approximate quantiles of many columns without a global value map.

Spark's ``percentile`` keeps a value -> count map per group; for a global
aggregate the final merge of that map runs in one task, which does not hold for
a column with billions of distinct values.  ``exact_quantiles`` instead finds
the k-th smallest values by narrowing, all columns and all wanted ranks in the
same scans:

- A KLL sketch brackets each wanted rank; overlapping brackets merge.
- The brackets' ends (and points between them) cut a column into ascending cells.
  A row finds its cell by binary search (Spark ML's ``Bucketizer``, JVM side) and adds one to
  (column, cell): one row per (row, column), whatever the number of ranks.  In a
  bracket of few rows the value itself is the cell.
- Prefix sums over the cells' counts place every rank, so a bracket that missed its
  rank is no special case: the cell that holds the rank is the next bracket.

With the default sketch two scans are enough up to about ``FETCH_LIMIT`` * 1,000 rows;
beyond that a scan more per factor of a few hundred.  Only cell counts reach the
driver, at most ``CELL_LIMIT`` + ``FETCH_LIMIT`` rows a pass.

Interpolation follows ``percentile`` / SQL ``quantile_cont``: position
``p * (n - 1)`` between the two neighbouring order statistics.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_right
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed tuning values
SKETCH_SIZE = 16384            # k of the bracketing KLL sketches (some 400 KB a column and task)
SKETCH_ERROR = 3.7e-4           # their rank error; a bracket that misses its rank only costs a pass
CELL_LIMIT = 1 << 15           # cells of a pass, shared by all brackets
FETCH_LIMIT = 200_000          # values that a pass may list, shared by all brackets
MAX_PASSES = 64                # a pass cuts a bracket's doubles into at least 8 cells; 2^64 of them last 22


def valid_value(c: str) -> Column:
    """Column as double with NaN treated as missing (one meaning of missing)."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def placed(df: DataFrame, edges: Mapping[str, Sequence[float]], names: Mapping[str, str]) -> DataFrame:
    """``df`` with integer columns ``names[c]``: how many of the ascending ``edges[c]`` are at most the value of ``c``.

    Columns must be double without NaN; null gives null.  Binary search in the JVM, no Python worker.
    """
    from pyspark.ml.feature import Bucketizer
    inf = float("inf")
    inner = {c: [e for e in dict.fromkeys(x + 0.0 for x in es) if -inf < e < inf] for c, es in edges.items()}
    cut = [c for c in edges if inner[c]]
    if cut:
        df = Bucketizer(splitsArray=[[-inf, *inner[c], inf] for c in cut], inputCols=cut,
                        outputCols=[names[c] for c in cut]).transform(df)
    more = {}
    for c, es in edges.items():
        n = F.col(names[c]).cast("int") if inner[c] else F.when(F.col(c).isNotNull(), F.lit(0))
        if -inf in es:
            n = n + F.lit(1)
        if inf in es:
            n = n + F.when(F.col(c) == inf, F.lit(1)).otherwise(F.lit(0))
        more[names[c]] = n
    return df.withColumns(more)


def _ordered(x: float) -> int:
    """The place of a double among all doubles."""
    n = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
    return n if n >= 0 else -(n & (2 ** 63 - 1))


def _double(n: int) -> float:
    return struct.unpack("<d", struct.pack("<q", n))[0] if n >= 0 else -struct.unpack("<d", struct.pack("<q", -n))[0]


def _cuts(lo: float, hi: float, parts: int) -> list[float]:
    """Ascending edges that cut [lo, hi] into at most ``parts`` cells; the first is lo, the last the double after hi."""
    a, b = _ordered(lo), _ordered(hi) + 1
    parts = min(parts, b - a)
    return [_double(a + (b - a) * i // parts) for i in range(parts + 1)]


def _merged(brackets: Sequence[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Disjoint ascending (lo, hi, rows expected) from overlapping ones."""
    out: list[tuple[float, float, float]] = []
    for lo, hi, n in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi), out[-1][2] + n)
        else:
            out.append((lo, hi, n))
    return out


def kth_smallest(df: DataFrame, wanted: Mapping[str, Sequence[int]],
                 brackets: Mapping[str, Sequence[tuple[float, float, float]]]) -> dict[tuple[str, int], float]:
    """k-th smallest non-missing value (0-based k) for each column and k.

    ``wanted`` maps column -> ranks; ``brackets`` maps column -> (lo, hi, rows expected between) where to look first.
    """
    result: dict[tuple[str, int], float] = {}
    open_ = {c: sorted(set(ks)) for c, ks in wanted.items() if ks}
    look = {c: _merged(brackets[c]) for c in open_}
    for _ in range(MAX_PASSES):
        if not open_:
            return result
        counts = _cell_counts(df, look)
        nxt: dict[str, list[int]] = {}
        for c, ks in open_.items():
            cells = counts.get(c, [])
            ends, total = [], 0
            for cell in cells:
                total += cell[0]
                ends.append(total)
            found = []
            for k in ks:
                at = bisect_right(ends, k)
                if at == len(cells):
                    raise ValueError(f"rank {k} of {c} is beyond its {total} values")
                n, lo, hi = cells[at]
                if lo == hi:
                    result[c, k] = lo
                else:
                    nxt.setdefault(c, []).append(k)
                    found.append((lo, hi, n))
            look[c] = _merged(list(dict.fromkeys(found)))
        open_, look = nxt, {c: look[c] for c in nxt}
    raise RuntimeError(f"quantile narrowing did not converge for {open_}")


def _cell_counts(df: DataFrame, look: Mapping[str, Sequence[tuple[float, float, float]]]
                 ) -> dict[str, list[tuple[int, float, float]]]:
    """Per column the ascending cells as (rows, least, greatest value), from one scan and one aggregate."""
    brackets = sorted((n, c, lo, hi) for c, found in look.items() for lo, hi, n in found)
    listed, room = set(), FETCH_LIMIT
    for n, c, lo, hi in brackets:  # the smallest brackets give their values
        if n > room:
            break
        listed.add((c, lo, hi))
        room -= n
    parts = max(8, CELL_LIMIT // max(1, len(brackets) - len(listed)))
    edges: dict[str, list[float]] = {}
    single: dict[str, list[int]] = {}  # cells whose values are listed
    for c, found in look.items():
        edges[c], single[c] = [], []
        for lo, hi, _ in found:
            cuts = _cuts(lo, hi, 1 if (c, lo, hi) in listed else parts)
            if edges[c] and edges[c][-1] == cuts[0]:
                edges[c].pop()
            edges[c] += cuts
            if (c, lo, hi) in listed:
                single[c].append(len(edges[c]) - 1)
    cols = list(look)
    inner, place = {c: f"v{i}" for i, c in enumerate(cols)}, {f"v{i}": f"c{i}" for i in range(len(cols))}
    wide = df.select(*[(valid_value(c) + F.lit(0.0)).alias(v) for c, v in inner.items()])  # one zero: -0.0 + 0.0
    wide = placed(wide, {v: edges[c] for c, v in inner.items()}, place)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("no"), F.col(f"c{i}").alias("cell"), F.col(f"v{i}").alias("v"),
                 (F.col(f"c{i}").isin(single[c]) if single[c] else F.lit(False)).alias("listed"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*").where(F.col("v").isNotNull())
    sums = (long.groupBy("no", "cell", F.when(F.col("listed"), F.col("v")).alias("value"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    out: dict[str, list[tuple[int, float, float]]] = {}
    for r in sorted(sums.collect(), key=lambda r: (r.no, r.cell, r.lo)):  # cells, and values of the small brackets
        out.setdefault(cols[r.no], []).append((r.n, r.lo, r.hi))
    return out


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]
                    ) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles ``{col: [q(p) for p in probs]}``; missing ignored."""
    cols = list(dict.fromkeys(cols))
    eps = 2 * SKETCH_ERROR
    # one aggregate: counts, extremes and a sketch bracket around every wanted rank
    qgrid = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-eps, eps)})
    aggs = []
    for i, c in enumerate(cols):
        v = valid_value(c)
        sketch = F.call_function("kll_sketch_agg_double", v, F.lit(SKETCH_SIZE))
        ranks = F.array(*map(F.lit, qgrid))
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"),
                 F.when(F.count(v) > 0, F.call_function("kll_sketch_get_quantile_double", sketch, ranks)).alias(f"q{i}")]
    row = df.agg(*aggs).collect()[0]
    wanted: dict[str, list[int]] = {}
    brackets: dict[str, list[tuple[float, float, float]]] = {}
    counts = {}
    for i, c in enumerate(cols):
        n = counts[c] = row[f"n{i}"]
        if not n:
            continue
        qv = dict(zip(qgrid, row[f"q{i}"]))
        wanted[c], brackets[c] = [], []
        for p in probs:
            lo_q, hi_q = min(1.0, max(0.0, p - eps)), min(1.0, max(0.0, p + eps))
            lo = row[f"mn{i}"] if lo_q <= 0.0 else qv[lo_q]
            hi = row[f"mx{i}"] if hi_q >= 1.0 else qv[hi_q]
            wanted[c] += {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}
            brackets[c].append((lo, hi, 3 * eps * n + 2))
    kth = kth_smallest(df, wanted, brackets) if wanted else {}
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = counts[c]
        vals = []
        for p in probs:
            if not n:
                vals.append(None)
                continue
            pos = p * (n - 1)
            k0, k1 = math.floor(pos), math.ceil(pos)
            lo, hi = kth[(c, k0)], kth[(c, k1)]
            vals.append(lo if k0 == k1 else lo + (pos - k0) * (hi - lo))
        out[c] = vals
    return out


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     relative_error: float = 0.01) -> dict[str, list[float | None]]:
    """Sketch quantiles (actual values, rank error <= relative_error * n), one aggregate."""
    acc = max(1, int(round(1.0 / relative_error))) if relative_error > 0 else 1_000_000
    row = df.agg(*[F.percentile_approx(valid_value(c), list(probs), acc).alias(f"q{i}")
                   for i, c in enumerate(cols)]).collect()[0]
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
            for i, c in enumerate(cols)}


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              exact: bool = True, relative_error: float = 0.01) -> dict[str, list[float | None]]:
    if exact:
        return exact_quantiles(df, cols, probs)
    return approx_quantiles(df, cols, probs, relative_error)
