"""Aggregations and profiling (A1-A26) and sorts / top-k.

Profiles are computed by one or two multi-column aggregates (never one job per
column) and returned as long, typed DataFrames.  Only aggregate constants
(quantile values, extremes, totals) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, FloatType, NumericType

from tablesmith.functions.columns import (equal_width_bin, exact_mean, free_name, known, nan_free, quoted, round_half_away,
                                          round_half_away_value, safe_corr)

from tablesmith.plans import quantiles as Q


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def _long(df_one_row: DataFrame, names: Sequence[str], fields: Sequence[str],
          prefix_fmt: str = "{f}__{c}") -> DataFrame:
    """Turn a one-row wide aggregate into one row per column (lazy, no collect)."""
    structs = [F.struct(F.lit(c).alias("column"),
                        *[F.col(prefix_fmt.format(f=f, c=i)).alias(f) for f in fields])
               for i, c in enumerate(names)]
    return df_one_row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# ---------------------------------------------------------------- A1-A5, A14

def group_count(df: DataFrame, by: Sequence[str] | str) -> DataFrame:
    """A1: rows per category."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _group_stat(df, by, cols, fn, prefix):
    by = [by] if isinstance(by, str) else list(by)
    cols = cols or numeric_columns(df, exclude=by)
    return nan_free(df, cols).groupBy(*by).agg(*[fn(F.col(quoted(c))).alias(f"{prefix}_{c}") for c in cols])


def group_mean(df: DataFrame, by, cols: Sequence[str] | None = None) -> DataFrame:
    """A2: mean of every numeric column per group (strings excluded)."""
    return _group_stat(df, by, cols, F.avg, "mean")


def group_max(df: DataFrame, by, cols: Sequence[str] | None = None) -> DataFrame:
    """A3."""
    return _group_stat(df, by, cols, F.max, "max")


def group_min(df: DataFrame, by, cols: Sequence[str] | None = None) -> DataFrame:
    """A4."""
    return _group_stat(df, by, cols, F.min, "min")


def group_sum(df: DataFrame, by, cols: Sequence[str] | None = None) -> DataFrame:
    """A5."""
    return _group_stat(df, by, cols, F.sum, "sum")


def group_avg_sorted(df: DataFrame, by: str, value: str, ascending: bool = True) -> DataFrame:
    """Mean by key (missing values left out) and rows, ordered by key."""
    out = nan_free(df, [value]).groupBy(by).agg(F.avg(value).alias(f"avg_{value}"), F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.col(by).asc() if ascending else F.col(by).desc())


# ---------------------------------------------------------------- A6-A9

def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Typed long form of count, mean, stddev (n-1), min, max per column."""
    cols = list(cols or numeric_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        v = Q.valid_value(c)
        aggs += [F.count(v).alias(f"count__{i}"), F.avg(v).alias(f"mean__{i}"),
                 F.stddev_samp(v).alias(f"stddev__{i}"), F.min(v).alias(f"min__{i}"),
                 F.max(v).alias(f"max__{i}")]
    return _long(df.agg(*aggs), cols, ["count", "mean", "stddev", "min", "max"])


def summary(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True,
            relative_error: float = 0.01) -> DataFrame:
    """A6 plus 25 / 50 / 75 % (exact interpolated, or sketch values)."""
    cols = list(cols or numeric_columns(df))
    qs = Q.quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact, relative_error=relative_error)
    base = describe(df, cols)
    spark = df.sparkSession
    qdf = spark.createDataFrame([(c, *[None if v is None else float(v) for v in qs[c]]) for c in cols],
                                "column string, p25 double, p50 double, p75 double")
    # both sides hold one row per listed column: a bounded lookup
    return base.join(F.broadcast(qdf), "column").select(
        "column", "count", "mean", "stddev", "min", "p25", "p50", "p75", "max")


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing (null, or NaN in floating columns) per column, with share."""
    fields = [f for f in df.schema.fields if cols is None or f.name in cols]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, f in enumerate(fields):
        x = F.col(f"`{f.name}`")
        miss = x.isNull() | F.isnan(x) if isinstance(f.dataType, (DoubleType, FloatType)) else x.isNull()
        aggs.append(F.sum(miss.cast("long")).alias(f"n_missing__{i}"))
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(f.name).alias("column"),
                        F.col(f"n_missing__{i}").alias("n_missing"),
                        F.col("n_rows").alias("n_rows")) for i, f in enumerate(fields)]
    return (one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
            .withColumn("share_missing", F.try_divide(F.col("n_missing"), F.col("n_rows"))))


def table_shape(df: DataFrame) -> DataFrame:
    """Per column its position, type, count of values that are there (not null, not NaN); table rows and columns."""
    fields = df.schema.fields
    one = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count(known(df, f.name)).alias(f"nn__{i}") for i, f in enumerate(fields)])
    structs = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                        F.lit(f.dataType.simpleString()).alias("type"),
                        F.col(f"nn__{i}").alias("non_null"), F.col("n_rows").alias("n_rows"),
                        F.lit(len(fields)).alias("n_cols")) for i, f in enumerate(fields)]
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# ---------------------------------------------------------------- A10-A13

def value_share(df: DataFrame, c: str) -> DataFrame:
    """A10: count and share of each value of ``c`` (null is a value)."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))  # one row, from the grouped counts
    return counts.join(F.broadcast(total)).select(c, "n", (F.col("n") / F.col("_total")).alias("share"))


def unpivot_values(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (),
                   var: str = "column", val: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot(list(ids), list(cols), var, val)


def rating_distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column and answer: count, percentage and column mean.

    One unpivot and one grouping instead of three jobs per column.  Missing
    answers are not counted.
    """
    long = unpivot_values(nan_free(df, cols), cols).where(F.col("value").isNotNull())
    g = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # totals and means follow from the grouped counts
    per_col = g.groupBy("column").agg(F.sum("n").alias("n_col"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("col_mean"))
    # per_col holds one row per listed column: bounded
    return (g.join(F.broadcast(per_col), "column")
            .select("column", "value", "n",
                    (F.col("n") * 100.0 / F.col("n_col")).alias("pct"), "col_mean"))


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each listed column (one row)."""
    return nan_free(df, cols).agg(*[F.avg(F.col(quoted(c))).alias(f"mean_{c}") for c in cols])


def overall_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean over all cells of the listed columns (missing cells skipped)."""
    df = nan_free(df, cols)
    parts_sum = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    parts_n = sum((F.col(c).isNotNull().cast("long") for c in cols), F.lit(0))
    return df.agg(F.try_divide(F.sum(parts_sum), F.sum(parts_n)).alias("overall_mean"),
                  F.sum(parts_n).alias("n_cells"))


# ---------------------------------------------------------------- A15-A19

def distinct_and_range(df: DataFrame, id_col: str, date_col: str, approx: bool = False) -> DataFrame:
    """Number of distinct ids; first and last date."""
    nd = F.approx_count_distinct(id_col) if approx else F.count_distinct(id_col)
    return df.agg(nd.alias("n_ids"), F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"))


def min_group_size(df: DataFrame, id_col: str | Sequence[str], min_rows: int = 100) -> DataFrame:
    """Keep rows of groups with at least ``min_rows`` rows.

    Sizes come from a partial-aggregated ``groupBy``; rows are kept by a semi
    join on the passing ids (AQE broadcasts the id list when it is small and
    splits a hot id's partition otherwise) - no window holding a whole group.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    size = free_name(df, "_n")
    ok = df.groupBy(*ids).agg(F.count(F.lit(1)).alias(size)).where(F.col(size) >= min_rows).select(*ids)
    return df.join(ok, ids, "left_semi")


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per (label, prediction)."""
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   exact: bool = True, relative_error: float = 0.01) -> DataFrame:
    """(column, p, value)."""
    qs = Q.quantiles(df, cols, probs, exact=exact, relative_error=relative_error)
    rows = [(c, float(p), None if v is None else float(v)) for c in cols for p, v in zip(probs, qs[c])]
    return df.sparkSession.createDataFrame(rows, "column string, p double, value double")


def exact_quantiles(df, cols, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """A18."""
    return quantile_table(df, cols, probs, exact=True)


def approx_quantiles(df, cols, probs=(0.01, 0.5, 0.99), relative_error: float = 0.01) -> DataFrame:
    """A19."""
    return quantile_table(df, cols, probs, exact=False, relative_error=relative_error)


# ---------------------------------------------------------------- A20-A22

def corr_matrix_pearson(df: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    """Every pair's Pearson r from one aggregate, long form (x, y, r).

    Each pair uses the rows where both are present (null and NaN are missing); r is null without spread.
    """
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    structs = [F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("r")) for c in cols]
    for i, (a, b) in enumerate(pairs):
        r = F.col(f"r__{i}")
        r = round_half_away(r, digits) if digits is not None else r
        structs += [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r.alias("r")),
                    F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), r.alias("r"))]
    one = nan_free(df, cols).agg(F.count(F.lit(1)).alias("n_rows"),
                                 *[safe_corr(F.col(quoted(a)), F.col(quoted(b))).alias(f"r__{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


#: Up to so many distinct values a column's ranks are broadcast.
BROADCAST_VALUES = 100_000


def corr_matrix_spearman(df: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    """Spearman rank correlation (average ranks for ties) of every pair.

    Each pair uses the rows where both are present, like Pearson and Kendall, so a value has a rank per partner
    column.  One grouping counts every column's distinct values, once for each partner that is present with them;
    range-partitioned running counts (``plans.ranking``) give the ranks against all partners at once.  Each row then meets
    the ranks of its columns (a join per column, not per pair; a column of few values is broadcast, so its hot values stay
    spread).  The column with most values needs none: a value's rank is the same in all its rows, so they are summed by
    it first, and the sums meet the ranks.  What the ranks spread comes from the distinct values.
    """
    from tablesmith.plans.ranking import cumulative_by_value
    from tablesmith.session import cut_lineage
    cols = list(cols)
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    rows = [(c, c, 1.0) for c in cols]
    if pairs:
        # one zero: -0.0 + 0.0 is 0.0
        base = nan_free(df.select(*[(F.col(quoted(c)).cast("double") + F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(cols)]))
        there = [F.col(f"c{i}").isNotNull().cast("double") for i in range(k)]
        entries = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"c{i}").alias("value")) for i in range(k)])
        long = base.select(*[t.alias(f"n{i}") for i, t in enumerate(there)], F.explode(entries).alias("e")).select("e.*", *[f"n{i}" for i in range(k)])
        weights = [f"n{i}" for i in range(k)]
        counted = cut_lineage(long.where(F.col("value").isNotNull()).groupBy("side", "value").agg(*[F.sum(w).alias(w) for w in weights]))
        ranks = cut_lineage(cumulative_by_value(counted, "value", weights, ["side"]).select(
            "side", "value", *weights, F.array(*[F.col(f"below_{w}") + (F.col(w) + F.lit(1.0)) / F.lit(2.0) for w in weights]).alias("ranks")))
        sides = counted.groupBy("side").agg(F.count(F.lit(1)).alias("held"), *[F.sum(w).alias(w) for w in weights]).collect()
        held = {r.side: r.held for r in sides}
        middle = {(r.side, j): (r[f"n{j}"] + 1) / 2 for r in sides for j in range(k)}  # centring first keeps the sums accurate
        last = max(range(k), key=lambda i: held.get(i, 0))

        def own(i):
            return ranks.where(F.col("side") == i).select(F.col("value").alias(f"c{i}"), F.col("ranks").alias(f"r{i}"))

        def centred(i, j):
            both = F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull()
            return F.when(both, F.col(f"r{i}")[j] - middle.get((i, j), 0.5))
        ranked = base
        for i in set(range(k)) - {last}:
            few = held.get(i, 0) <= BROADCAST_VALUES
            ranked = ranked.join(F.broadcast(own(i)) if few else own(i), f"c{i}", "left")
        sums = [F.sum(centred(i, j) * centred(j, i) if last not in (i, j) else centred(j if i == last else i, last)).alias(f"s_{i}_{j}")
                for i, j in pairs]
        by_value = ranked.groupBy(f"c{last}").agg(*sums).join(own(last), f"c{last}", "left")
        rank = {j: F.col(f"r{last}")[j] - middle.get((last, j), 0.5) for j in range(k)}
        products = by_value.agg(*[F.sum(F.col(f"s_{i}_{j}") * rank[j if i == last else i] if last in (i, j) else F.col(f"s_{i}_{j}")).alias(f"s_{i}_{j}")
                                  for i, j in pairs]).first()
        spread = ranks.agg(*[F.sum(F.when(F.col("side") == i, F.col(f"n{j}") * F.pow(F.col("ranks")[j] - middle.get((i, j), 0.5), 2))).alias(f"v_{i}_{j}")
                             for i in range(k) for j in range(k) if i != j]).first()
        found = {}
        for i, j in pairs:
            s, v = products[f"s_{i}_{j}"], math.sqrt(spread[f"v_{i}_{j}"] or 0.0) * math.sqrt(spread[f"v_{j}_{i}"] or 0.0)
            found[f"r_{i}_{j}"] = s / v if s is not None and v else None
        for i, j in pairs:
            r = found[f"r_{i}_{j}"]
            r = round_half_away_value(r, digits) if (digits is not None and r is not None) else r
            rows += [(cols[i], cols[j], r), (cols[j], cols[i], r)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def corr_matrix_kendall(df: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    """Kendall tau-b of every pair (see ``plans.kendall``), all pairs in one batch."""
    from tablesmith.plans.kendall import kendall_pairs
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    taus = kendall_pairs(df, pairs) if pairs else {}
    rows = [(c, c, 1.0) for c in cols]
    for (a, b), t in taus.items():
        t = round_half_away_value(t, digits) if digits is not None else t
        rows += [(a, b, t), (b, a, t)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


# ---------------------------------------------------------------- A23-A25

def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """Equal-width counts over [min, max], empty bins included."""
    mm = df.agg(F.min(Q.valid_value(c)).alias("lo"), F.max(Q.valid_value(c)).alias("hi")).collect()[0]
    spark = df.sparkSession
    if mm["lo"] is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, n long")
    lo, hi = float(mm["lo"]), float(mm["hi"])
    width = (hi - lo) / bins
    counts = (df.select(equal_width_bin(Q.valid_value(c), lo, hi, bins).alias("bin"))
              .where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """2-D binned counts of a point cloud (the data behind a scatter plot)."""
    df = nan_free(df, [x, y])
    mm = df.agg(F.min(x).alias("xl"), F.max(x).alias("xh"), F.min(y).alias("yl"), F.max(y).alias("yh")).collect()[0]
    if mm["xl"] is None or mm["yl"] is None:
        return df.sparkSession.createDataFrame([], "bx int, by int, n long")
    return (df.select(equal_width_bin(F.col(x), float(mm["xl"]), float(mm["xh"]), bins).alias("bx"),
                      equal_width_bin(F.col(y), float(mm["yl"]), float(mm["yh"]), bins).alias("by"))
            .where(F.col("bx").isNotNull() & F.col("by").isNotNull())
            .groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n")))


def scatter_sample(df: DataFrame, x: str, y: str, n: int = 1000, key: Sequence[str] | None = None,
                   salt: str = "scatter") -> DataFrame:
    """A24, point half: a bounded, layout-free sample of (x, y) points for a plot:
    the ``n`` rows with the smallest key hash (ties by key)."""
    from tablesmith.functions.columns import hash_unit
    key = list(key) if key else [x, y]
    h = df.select(*dict.fromkeys([*key, x, y]), hash_unit(key, salt).alias("_h"))
    return h.orderBy("_h", *key).limit(n).select(x, y)


def pair_bins(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Binned counts for every ordered pair of columns; x == y rows are the
    diagonal histograms.  One job: bin every column once, explode the pairs."""
    cols = list(cols)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(Q.valid_value(c)).alias(f"lo{i}"), F.max(Q.valid_value(c)).alias(f"hi{i}")]
    mm = df.agg(*aggs).collect()[0]
    binned = df.select(*[(equal_width_bin(F.col(c), float(mm[f"lo{i}"]), float(mm[f"hi{i}"]), bins)
                          if mm[f"lo{i}"] is not None else F.lit(None).cast("int")).alias(c)
                         for i, c in enumerate(cols)])
    pairs = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).alias("bx"), F.col(b).alias("by"))
             for a in cols for b in cols]
    return (binned.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
            .where(F.col("bx").isNotNull() & F.col("by").isNotNull())
            .where((F.col("x") != F.col("y")) | (F.col("bx") == F.col("by")))
            .groupBy("x", "y", "bx", "by").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- A26

def profile_report(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True,
                   with_rank_corr: bool = True, digits: int | None = None) -> dict[str, DataFrame]:
    """Per-column profile + correlation tables (the data of a profile report).

    Per column: count, missing, distinct, mean (exact, order-independent),
    stddev, min, quartiles, max, skewness and excess kurtosis (population
    forms); rounded only if ``digits`` is given.  Distinct counts come from one (column, value)
    grouping with ``exact``, else from sketches in the same aggregate.
    """
    cols = list(cols or numeric_columns(df))

    def rounded(x: Column) -> Column:
        return x if digits is None else round_half_away(x, digits)

    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        v = Q.valid_value(c)
        aggs += [F.count(v).alias(f"count__{i}"), F.approx_count_distinct(v).alias(f"distinct__{i}"),
                 exact_mean(v).alias(f"mean__{i}"), F.stddev_samp(v).alias(f"stddev__{i}"),
                 F.min(v).alias(f"min__{i}"), F.max(v).alias(f"max__{i}"),
                 F.skewness(v).alias(f"skewness__{i}"), F.kurtosis(v).alias(f"kurtosis__{i}")]
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"count__{i}").alias("count"),
                        (F.col("n_rows") - F.col(f"count__{i}")).alias("n_missing"),
                        F.col(f"distinct__{i}").alias("n_distinct"),
                        *[rounded(F.col(f"{m}__{i}")).alias(m)
                          for m in ("mean", "stddev", "min", "max", "skewness", "kurtosis")])
               for i, c in enumerate(cols)]
    per_col = one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    if exact:  # (column, value) combines map-side: no copy of every row per distinct count
        values = df.select(*[Q.valid_value(c).alias(f"v{i}") for i, c in enumerate(cols)]) \
            .unpivot([], [f"v{i}" for i in range(len(cols))], "_at", "_value").where(F.col("_value").isNotNull())
        found = values.groupBy("_at", "_value").agg(F.lit(1)).groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
        names = df.sparkSession.createDataFrame([(f"v{i}", c) for i, c in enumerate(cols)], "_at string, column string")
        distinct = F.broadcast(names.join(found, "_at", "left").select("column", F.coalesce("_n", F.lit(0)).alias("_n")))
        per_col = per_col.join(distinct, "column").withColumn("n_distinct", F.col("_n")).drop("_n")  # one row per column
    qs = Q.quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
    qdf = df.sparkSession.createDataFrame(
        [(c, *[None if v is None else float(v) if digits is None else round_half_away_value(float(v), digits) for v in qs[c]])
         for c in cols], "column string, p25 double, p50 double, p75 double")
    out = {"columns": per_col.join(F.broadcast(qdf), "column"),
           "pearson": corr_matrix_pearson(df, cols, digits)}
    if with_rank_corr:
        out["spearman"] = corr_matrix_spearman(df, cols, digits)
        out["kendall"] = corr_matrix_kendall(df, cols, digits)
    return out


# ---------------------------------------------------------------- T1-T4

def order_limit(df: DataFrame, by: str, n: int = 10, ascending: bool = True,
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """Lowest (or highest) n by a column, ties broken by ``tiebreak``."""
    o = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(o, *[F.col(t).asc() for t in tiebreak]).limit(n)


def head_tail(df: DataFrame, key: Sequence[str] | str, n: int = 5, last: bool = False) -> DataFrame:
    """First or last n rows by a key (row order exists only through a key)."""
    key = [key] if isinstance(key, str) else list(key)
    order = [F.col(k).desc() if last else F.col(k).asc() for k in key]
    return df.orderBy(*order).limit(n)


def sort_series(df: DataFrame, id_col: str, date_col: str, global_order: bool = True) -> DataFrame:
    """Order by id, then date.  ``global_order=False`` keeps each id's rows
    together and sorted inside partitions without a total-order shuffle."""
    if global_order:
        return df.orderBy(id_col, date_col)
    return df.repartition(id_col).sortWithinPartitions(id_col, date_col)


def top_features(scores: DataFrame, n: int = 10, score: str = "score", name: str = "feature",
                 by_abs: bool = False) -> DataFrame:
    """T4: the n best-scored features (ties by name)."""
    s = F.abs(F.col(score)) if by_abs else F.col(score)
    return scores.orderBy(s.desc_nulls_last(), F.col(name).asc()).limit(n)
