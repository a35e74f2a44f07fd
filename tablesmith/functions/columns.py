"""Column-expression builders (JVM side, inside whole-stage codegen).

Every helper returns a ``Column``; none runs Python per row.  Rules for missing
values are stated per helper: null in gives null out unless said otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> str:
    """A column name for ``F.col`` and ``expr``, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def nan_to_null(c: str | Column) -> Column:
    """NaN becomes null so that missing has one meaning."""
    x = col_of(c)
    return F.when(~F.isnan(x), x)


def named(df: DataFrame, c: str) -> Column:
    """Column ``c`` of ``df``, or the field of a struct that it names."""
    return F.col(quoted(c) if c in df.columns else c)


def is_floating(df: DataFrame, c: str) -> bool:
    return isinstance(df.select(named(df, c)).schema[0].dataType, (DoubleType, FloatType))


def known(df: DataFrame, c: str) -> Column:
    """Column ``c`` of ``df`` with NaN as null, whatever its type."""
    return nan_to_null(named(df, c)) if is_floating(df, c) else named(df, c)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has not."""
    while name in df.columns:
        name = f"_{name}"
    return name


def nan_free(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """D1 for a frame: NaN becomes null in the listed (default: all) floating columns; others stay as they are."""
    floating = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (DoubleType, FloatType)) and (cols is None or f.name in cols)]
    return df.withColumns({c: nan_to_null(F.col(quoted(c))) for c in floating}) if floating else df


def equal_width_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin 0..bins-1 over [lo, hi], the last one closed; null (and NaN) gives null."""
    x = nan_to_null(x.cast("double"))
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(0))
    b = F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("int")
    return F.when(x.isNotNull(), F.least(b, F.lit(bins - 1)))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """A / b, null when b is 0 or null (ANSI mode would raise)."""
    return F.try_divide(col_of(a), col_of(b))


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Aggregate: Pearson r over the rows where both are present, within [-1, 1]; null if either has no
    spread there (``F.corr`` raises then in ANSI mode)."""
    x, y = col_of(a).cast("double"), col_of(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def smoothed_ratio(a: str | Column, b: str | Column, eps: float = 1e-6) -> Column:
    """a / (b + eps) (P5)."""
    return F.try_divide(col_of(a), col_of(b) + F.lit(eps))


def scaled_ratio(a: str | Column, b: str | Column, scale: float = 100000.0) -> Column:
    """a / (b / scale), e.g. income relative to price per 100k."""
    return F.try_divide(col_of(a), F.try_divide(col_of(b), F.lit(scale)))


_OPS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}


def threshold_flag(c: str | Column, op: str, value) -> Column:
    """1 when ``c op value`` else 0; null stays null (P7).  NaN compares as the greatest value: pass it as null."""
    x = col_of(c)
    cond = getattr(x, _OPS[op])(F.lit(value))
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(cond.cast("int"))


def case_bins(c: str | Column, thresholds: Sequence[float], labels: Sequence[str]) -> Column:
    """Ordered ``c < t_i`` -> label_i, else last label; null -> null (P8, D10); pass NaN as null.

    ``labels`` has one entry more than ``thresholds``.
    """
    assert len(labels) == len(thresholds) + 1
    x = col_of(c)
    expr = F.when(x.isNull(), F.lit(None).cast("string"))
    for t, lab in zip(thresholds, labels):
        expr = expr.when(x < F.lit(t), F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def case_bins_desc(c: str | Column, thresholds: Sequence[float], labels: Sequence[str]) -> Column:
    """Ordered ``c >= t_i`` -> label_i (descending thresholds), else last label."""
    assert len(labels) == len(thresholds) + 1
    x = col_of(c)
    expr = F.when(x.isNull(), F.lit(None).cast("string"))
    for t, lab in zip(thresholds, labels):
        expr = expr.when(x >= F.lit(t), F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def ordinal_map(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Category -> score by lookup map; unlisted -> default (P9).  Null key -> default."""
    x = col_of(c)
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.try_element_at(m, x), F.lit(default))


def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str] | None = None,
        closed: str = "right", include_lowest: bool = False) -> Column:
    """Fixed bins like ``pd.cut``.

    closed="right": (a, b]; closed="left": [a, b).  ``include_lowest`` closes the
    outer edge too.  Values outside all edges and nulls give null.  Without
    labels the bin index (0-based int) is returned.
    """
    x = col_of(c)
    n = len(edges) - 1
    labels = list(labels) if labels is not None else list(range(n))
    assert len(labels) == n
    out_type = "string" if isinstance(labels[0], str) else "int"
    expr = None
    for i in range(n):
        a, b = edges[i], edges[i + 1]
        if closed == "right":
            lower = (x >= F.lit(a)) if (include_lowest and i == 0) else (x > F.lit(a))
            cond = lower & (x <= F.lit(b))
        else:
            upper = (x <= F.lit(b)) if (include_lowest and i == n - 1) else (x < F.lit(b))
            cond = (x >= F.lit(a)) & upper
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return expr.otherwise(F.lit(None).cast(out_type))


def hash_unit(cols: Sequence[str | Column], salt: str = "") -> Column:
    """Layout-free pseudo-random integer in [0, 2^32) from md5 of the key.

    Same value in Spark and in SQL engines with md5: the first 8 hex digits of
    ``md5(salt || concat_ws('|', key...))`` read as an unsigned integer.
    """
    parts = [col_of(c).cast("string") for c in cols]
    key = F.concat_ws("|", *parts)
    if salt:
        key = F.concat(F.lit(salt), key)
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def hash_bucket(cols: Sequence[str | Column], n: int = 100, salt: str = "") -> Column:
    """Bucket 0..n-1 from ``hash_unit`` (splits, folds, A/B assignment)."""
    return F.pmod(hash_unit(cols, salt), F.lit(n)).cast("int")


def sql_hash_unit(cols: Sequence[str], salt: str = "") -> str:
    """The DuckDB form of ``hash_unit`` for oracle SQL."""
    key = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"
    if salt:
        key = f"('{salt}' || {key})"
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"


def in_share(cols: Sequence[str | Column], share: float, salt: str = "") -> Column:
    """True for a ``share`` of the keys, to one part in 2^32 (``hash_unit`` below share * 2^32)."""
    return hash_unit(cols, salt) < F.lit(int(share * (1 << 32) + 0.5))


def sql_in_share(cols: Sequence[str], share: float, salt: str = "") -> str:
    return f"({sql_hash_unit(cols, salt)} < {int(share * (1 << 32) + 0.5)})"


def sql_hash_bucket(cols: Sequence[str], n: int = 100, salt: str = "") -> str:
    return f"CAST(({sql_hash_unit(cols, salt)} % {n}) AS INTEGER)"


def season(month: str | Column) -> Column:
    """Meteorological season of a month number; null -> null."""
    m = col_of(month)
    return (F.when(m.isNull(), F.lit(None).cast("string"))
            .when(m.isin(12, 1, 2), "Winter")
            .when(m.isin(3, 4, 5), "Spring")
            .when(m.isin(6, 7, 8), "Summer")
            .otherwise("Fall"))


def is_weekend(date_col: str | Column) -> Column:
    """Spark dayofweek 1=Sunday .. 7=Saturday; weekend = {1, 7}."""
    d = F.dayofweek(col_of(date_col))
    return F.when(d.isNull(), F.lit(None).cast("int")).otherwise(d.isin(1, 7).cast("int"))


def clip_lower(c: str | Column, lower: float = 0.0) -> Column:
    """Values below ``lower`` -> lower; null stays null."""
    x = col_of(c)
    return F.when(x.isNull(), x).otherwise(F.greatest(x, F.lit(lower)))


def recode_values(c: str | Column, values: Sequence, to) -> Column:
    """Values in a set -> one constant, others kept."""
    x = col_of(c)
    return F.when(x.isin(*values), F.lit(to)).otherwise(x)


def strip_suffix(c: str | Column, suffix: str = ".") -> Column:
    """Drop one trailing suffix."""
    x = col_of(c)
    return F.when(x.endswith(suffix), x.substr(F.lit(1), F.length(x) - F.lit(len(suffix)))).otherwise(x)


def sentinel_to_null(c: str | Column, sentinels: Sequence[str] = ("?",)) -> Column:
    """Trimmed value in the sentinel set -> null."""
    x = col_of(c)
    return F.when(F.trim(x).isin(*sentinels), F.lit(None).cast("string")).otherwise(x)


def round_half_away(c: str | Column, digits: int = 6) -> Column:
    """Round like SQL engines round doubles: half away from zero on ``x * 10^d``.

    ``F.round`` rounds the shortest decimal string of ``x`` half-up, which can
    differ from this on exact-half cases (1037.0821875 -> ...188 vs ...187).
    """
    m = float(10 ** digits)
    x = col_of(c)
    r = F.round(x * F.lit(m)) / F.lit(m)
    # IEEE rounding keeps the sign of a zero result (-0.4e-6 -> -0.0), as the SQL engines do
    negative = (x < 0) | (x.cast("string") == "-0.0")          # also an input of -0.0
    return F.when((r == 0) & negative, F.lit(-0.0)).otherwise(r)


def round_half_away_value(x: float | None, digits: int = 6) -> float | None:
    """Python twin of ``round_half_away`` for driver-side constants."""
    if x is None or math.isnan(x) or math.isinf(x):
        return x
    m = float(10 ** digits)
    y = x * m
    r = float(math.trunc(y))
    if abs(y - r) >= 0.5:
        r += math.copysign(1.0, y)
    return math.copysign(r, y) / m if r == 0 else r / m


def exact_mean(c: str | Column) -> Column:
    """Mean from an exact decimal sum when every value fits DECIMAL(38,18), else
    the double mean.  The exact form does not depend on summation order, so it
    is the same on any partitioning (a double sum is not)."""
    x = col_of(c).cast("double")
    d = x.try_cast("decimal(38,18)")
    exact = F.try_avg(d)
    return F.when((F.count(d) == F.count(x)) & exact.isNotNull(), exact.cast("double")).otherwise(F.avg(x))
