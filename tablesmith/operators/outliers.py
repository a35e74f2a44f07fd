"""Outlier removal (X1-X3): one aggregate of bounds, then one AND-ed filter.

Rules (D3-D6): IQR and percentile bounds are inclusive on both sides, z-score
keeps ``|z| < threshold`` strictly, a column with zero (or undefined) spread is
skipped, and a row missing a tested value is dropped unless ``keep_missing``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.operators.profile import numeric_columns
from tablesmith.plans import quantiles as Q


def _inside(c: str, lo: float, hi: float, keep_missing: bool) -> Column:
    """``lo <= x <= hi`` as plain comparisons so the scan can skip row groups.

    In a filter a null comparison drops the row, and NaN (largest in Spark's
    order) fails ``x <= hi``: missing values are dropped without extra terms.
    """
    x = F.col(c)
    cond = (x >= F.lit(lo)) & (x <= F.lit(hi))
    if keep_missing:
        return x.isNull() | F.isnan(x.cast("double")) | cond
    return cond


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5,
               mode: str = "sequential", keep_missing: bool = False) -> dict[str, tuple[float, float]]:
    """Bounds ``[q1 - k*iqr, q3 + k*iqr]`` per column.

    ``sequential`` (the reference's rule, D3): column j is measured on the rows
    kept by columns 1..j-1, so the column order is part of the result.
    ``simultaneous``: all quartiles from one pass over the original rows.
    """
    bounds: dict[str, tuple[float, float]] = {}
    if mode == "simultaneous":
        qs = Q.exact_quantiles(df, cols, [0.25, 0.75])
        for c in cols:
            q1, q3 = qs[c]
            if q1 is not None:
                bounds[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
        return bounds
    cur = df
    for c in cols:
        q1, q3 = Q.exact_quantiles(cur, [c], [0.25, 0.75])[c]
        if q1 is None:
            continue
        bounds[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
        cur = cur.where(_inside(c, *bounds[c], keep_missing))
    return bounds


def outlier_iqr(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5,
                mode: str = "sequential", keep_missing: bool = False) -> DataFrame:
    """Remove rows outside the IQR fences of every listed numeric column."""
    cols = list(cols or numeric_columns(df))
    bounds = iqr_bounds(df, cols, k, mode, keep_missing)
    return _apply(df, bounds, keep_missing)


def percentile_bounds(df: DataFrame, cols: Sequence[str], lower: float = 0.01, upper: float = 0.99,
                      exact: bool = True, relative_error: float = 0.01) -> dict[str, tuple[float, float]]:
    qs = Q.quantiles(df, cols, [lower, upper], exact=exact, relative_error=relative_error)
    return {c: tuple(qs[c]) for c in cols if qs[c][0] is not None}


def outlier_percentile(df: DataFrame, cols: Sequence[str] | None = None, lower: float = 0.01,
                       upper: float = 0.99, exact: bool = True, keep_missing: bool = False) -> DataFrame:
    """Keep rows between the lower and upper percentile of every column,
    all thresholds measured on the original rows (D4)."""
    cols = list(cols or numeric_columns(df))
    return _apply(df, percentile_bounds(df, cols, lower, upper, exact), keep_missing)


def zscore_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[e for i, c in enumerate(cols)
                   for e in (F.avg(Q.valid_value(c)).alias(f"m{i}"),
                             F.stddev_samp(Q.valid_value(c)).alias(f"s{i}"))]).collect()[0]
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def outlier_zscore(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 3.0,
                   keep_missing: bool = False) -> DataFrame:
    """Keep ``|x - mean| / stddev < threshold`` for every column with spread."""
    cols = list(cols or numeric_columns(df))
    stats = zscore_stats(df, cols)
    cond = F.lit(True)
    for c, (m, s) in stats.items():
        if m is None or s is None or s == 0:
            continue  # zero spread: skipped (D5)
        x = F.col(c)
        part = F.abs((x - F.lit(m)) / F.lit(s)) < F.lit(threshold)
        if keep_missing:
            part = x.isNull() | F.isnan(x.cast("double")) | part
        else:
            # an implied, slightly wider range first: pushable to the scan, never narrower
            slack = abs(threshold * s) * (1 + 1e-9) + 1e-300
            part = (x > F.lit(m - slack)) & (x < F.lit(m + slack)) & part
        cond = cond & part
    return df.where(cond)


def _apply(df: DataFrame, bounds: dict[str, tuple[float, float]], keep_missing: bool) -> DataFrame:
    cond = F.lit(True)
    for c, (lo, hi) in bounds.items():
        cond = cond & _inside(c, lo, hi, keep_missing)
    return df.where(cond)
