"""Projections, filters and cleaning (P1-P20) and set operations."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tablesmith.functions import columns as C


def select_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P1."""
    return df.select(*cols)


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P2."""
    return df.drop(*cols)


def clean_name(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip())


def rename_clean(df: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Rename listed columns, then replace blanks by ``_`` in every name."""
    renames = dict(renames or {})
    return df.toDF(*[clean_name(renames.get(c, c)) for c in df.columns])


def ratio_features(df: DataFrame, ratios: Mapping[str, tuple[str, str]] | None = None,
                   products: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Ratios (null on zero divisor, D2) and products, in one projection.

    A name listed twice is kept once (the reference doubled a feature that way).
    """
    new: dict[str, Column] = {}
    for name, (a, b) in (ratios or {}).items():
        new[name] = C.safe_div(a, b)
    for name, (a, b) in (products or {}).items():
        if name in new:
            warnings.warn(f"feature {name} listed twice; kept once")
        new[name] = F.col(a) * F.col(b)
    return df.withColumns(new)


def smoothed_ratio(df: DataFrame, name: str, a: str, b: str, eps: float = 1e-6) -> DataFrame:
    """P5."""
    return df.withColumn(name, C.smoothed_ratio(a, b, eps))


def scaled_ratio(df: DataFrame, name: str, a: str, b: str, scale: float = 100000.0) -> DataFrame:
    """P6."""
    return df.withColumn(name, C.scaled_ratio(a, b, scale))


def threshold_flag(df: DataFrame, name: str, c: str, op: str, value) -> DataFrame:
    """P7."""
    return df.withColumn(name, C.threshold_flag(C.known(df, c), op, value))


def case_bins(df: DataFrame, name: str, c: str, thresholds: Sequence[float],
              labels: Sequence[str], descending: bool = False) -> DataFrame:
    """P8."""
    f = C.case_bins_desc if descending else C.case_bins
    return df.withColumn(name, f(C.known(df, c), thresholds, labels))


def ordinal_map(df: DataFrame, name: str, c: str, mapping: Mapping, default=1) -> DataFrame:
    """P9."""
    return df.withColumn(name, C.ordinal_map(c, mapping, default))


def filter_range(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]],
                 keep_missing: bool = False) -> DataFrame:
    """P10: keep rows inside all bounds (inclusive); one AND-ed predicate.  NaN is missing, like null."""
    cond = F.lit(True)
    for c, (lo, hi) in bounds.items():
        x = F.col(c)
        missing = x.isNull() | F.isnan(x) if C.is_floating(df, c) else x.isNull()
        part = F.lit(True)
        if lo is not None:
            part = part & (x >= F.lit(lo))
        if hi is not None:
            part = part & (x <= F.lit(hi))
        if keep_missing:
            part = missing | part
        elif hi is None and C.is_floating(df, c):
            part = part & ~F.isnan(x)   # above every bound
        cond = cond & part          # plain comparisons: pushed to the scan; null fails the filter
    return df.where(cond)


def sentinel_to_null(df: DataFrame, cols: Sequence[str] | None = None,
                     sentinels: Sequence[str] = ("?",)) -> DataFrame:
    """Trimmed sentinel -> null in the listed (default: all string) columns."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: C.sentinel_to_null(c, sentinels) for c in cols})


def recode_values(df: DataFrame, cols: Sequence[str], values: Sequence, to) -> DataFrame:
    """P12."""
    return df.withColumns({c: C.recode_values(c, values, to) for c in cols})


def strip_suffix(df: DataFrame, c: str, suffix: str = ".") -> DataFrame:
    """P13."""
    return df.withColumn(c, C.strip_suffix(c, suffix))


def normalise_strings(df: DataFrame, cols: Sequence[str], trim: bool = True) -> DataFrame:
    """Cast to string, optionally trim."""
    def one(c):
        x = F.col(c).cast("string")
        return F.trim(x) if trim else x
    return df.withColumns({c: one(c) for c in cols})


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Drop rows missing any (or all) of the subset; NaN counts as missing."""
    return df.na.drop(how=how, subset=list(subset) if subset else None)


def clip_lower(df: DataFrame, cols: Sequence[str], lower: float = 0.0) -> DataFrame:
    """P16."""
    return df.withColumns({c: C.clip_lower(c, lower) for c in cols})


def tag_source(df: DataFrame, name: str, value) -> DataFrame:
    """P17."""
    return df.withColumn(name, F.lit(value))


def columns_by_type(df: DataFrame) -> dict[str, list[str]]:
    """P18 (D16): numeric by ``NumericType``, categorical = string."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    cat = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return {"numeric": num, "categorical": cat}


def columns_by_type_frame(df: DataFrame) -> DataFrame:
    """P18 as a table: position, column, type, kind and non-null count (one aggregate)."""
    kinds = columns_by_type(df)
    fields = df.schema.fields
    one = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"nn{i}") for i, f in enumerate(fields)])
    structs = []
    for i, f in enumerate(fields):
        kind = "numeric" if f.name in kinds["numeric"] else (
            "categorical" if f.name in kinds["categorical"] else "other")
        structs.append(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                                F.lit(f.dataType.simpleString()).alias("type"), F.lit(kind).alias("kind"),
                                F.col(f"nn{i}").alias("non_null")))
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def parse_date(df: DataFrame, c: str, fmt: str | None = None, name: str | None = None) -> DataFrame:
    """Text or timestamp -> date; unparseable -> null."""
    x = F.col(c)
    if fmt:
        out = F.to_date(F.try_to_timestamp(x.cast("string"), F.lit(fmt)))
    else:
        out = F.to_date(x) if not isinstance(df.schema[c].dataType, StringType) else \
            F.to_date(F.try_to_timestamp(x))
    return df.withColumn(name or c, out)


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """P20: drop full-row (or subset) copies."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows, distinct rows, duplicates removed -- one grouping pass."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").cast("bigint").alias("n_rows"),
                 F.count(F.lit(1)).alias("n_distinct"),
                 (F.sum("_n") - F.count(F.lit(1))).cast("bigint").alias("n_duplicates"))


def union_tagged(frames: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Stack frames with the same columns, each tagged by its name."""
    out = None
    for name, df in frames.items():
        t = df.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out
