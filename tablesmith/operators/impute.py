"""Imputation (I1-I4) as fit (one aggregate -> constants) + transform (one projection)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType, NumericType

from tablesmith.plans import quantiles as Q


@dataclass
class FillModel:
    """Fitted fill values; ``transform`` writes them into missing cells."""
    values: dict = field(default_factory=dict)
    suffix: str = ""          # "" overwrites in place, else writes c + suffix

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, v in self.values.items():
            if v is None:
                continue
            x = F.col(c)
            dtype = df.schema[c].dataType
            miss = x.isNull()
            if isinstance(dtype, NumericType):
                miss = miss | F.isnan(x.cast("double"))
            new[c + self.suffix] = F.when(miss, F.lit(v).cast(dtype)).otherwise(x)
        return df.withColumns(new)


def impute_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill with fixed values per column (0, "Unknown", ...)."""
    return FillModel(dict(values)).transform(df)


def fit_mean(df: DataFrame, cols: Sequence[str], suffix: str = "") -> FillModel:
    """Column means over non-missing values (null and NaN alike)."""
    row = df.agg(*[F.avg(Q.valid_value(c)).alias(f"m{i}") for i, c in enumerate(cols)]).collect()[0]
    return FillModel({c: row[f"m{i}"] for i, c in enumerate(cols)}, suffix)


def impute_mean(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    return fit_mean(df, cols, suffix).transform(df)


def fit_median(df: DataFrame, cols: Sequence[str], exact: bool = True,
               relative_error: float = 0.001, suffix: str = "") -> FillModel:
    """Exact interpolated median, or the sketch median Spark's Imputer uses."""
    qs = Q.quantiles(df, cols, [0.5], exact=exact, relative_error=relative_error)
    return FillModel({c: qs[c][0] for c in cols}, suffix)


def impute_median(df: DataFrame, cols: Sequence[str], exact: bool = True, suffix: str = "") -> DataFrame:
    return fit_median(df, cols, exact=exact, suffix=suffix).transform(df)


def fit_mode(df: DataFrame, cols: Sequence[str]) -> FillModel:
    """I4 (D13): most frequent non-missing value per column; ties -> smallest.

    One grouping over (column, value) with map-side combine, then a min over
    (-count, value) per column: no per-column job, no value map in one task.
    """
    values: dict[str, object] = {}
    kinds: dict[str, list[str]] = {}
    for c in cols:  # integers and decimals keep their own type, so large ones stay exact
        t = df.schema[c].dataType
        kind = "double" if isinstance(t, (DoubleType, FloatType)) else "long" if isinstance(t, IntegralType) \
            else t.simpleString() if isinstance(t, NumericType) else "string"
        kinds.setdefault(kind, []).append(c)
    for kind, cs in kinds.items():
        sel = [Q.valid_value(c).alias(c) if kind == "double" else F.col(c).cast(kind).alias(c) for c in cs]
        long = df.select(*sel).unpivot([], cs, "column", "value").where(F.col("value").isNotNull())
        g = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = g.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("value"))).alias("b"))
        for r in best.collect():  # one row per column
            values[r["column"]] = r["b"]["value"]
    return FillModel(values)


def impute_mode(train: DataFrame, cols: Sequence[str], *others: DataFrame):
    """I4: fit on ``train``, apply to train and every other frame given."""
    m = fit_mode(train, cols)
    out = [m.transform(train)] + [m.transform(o) for o in others]
    return out[0] if not others else tuple(out)
