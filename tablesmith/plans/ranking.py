"""Exact ranks and running totals without a window over a whole group.

A window ``PARTITION BY g ORDER BY v`` puts all rows of a group in one task;
with a group holding a third of the data that task is the job.  Here the
order key is cut into ranges first, as many as the session has shuffle
partitions, so their number follows the cluster's setting.  Totals per (group,
range) form a small table whose running sums give each range its offset; inside
a range a window partitioned by (group, range) does the rest.  A hot group is
thus spread over all ranges, and the offsets table has at most groups x ranges
rows.  Groups compare null-safe: a missing group is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.columns import quoted
from tablesmith.session import cut_lineage


def shuffle_ranges(df: DataFrame) -> int:
    """Ranges to cut an order into: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; the keys appear once, from the left side."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[quoted(k)].eqNullSafe(renamed[quoted(f"_right_{k}")]) for k in keys]
    return left.join(renamed, reduce(Column.__and__, on), how).drop(*[f"_right_{k}" for k in keys])


def hash_order_ranks(df: DataFrame, group_cols: Sequence[str], hash_col: str, tie_cols: Sequence[str],
                     out: str = "rank", ranges: int | None = None) -> DataFrame:
    """0-based row rank inside each group, ordered by (hash_col, tie_cols...).

    ``hash_col`` must be uniform on [0, 2^32) (see ``hash_unit``), so equal-width
    ranges are balanced without sampling.  Adds ``out`` and ``_group_n``.
    """
    g = list(group_cols)
    by = [quoted(c) for c in g]
    width = -(-(1 << 32) // (ranges or shuffle_ranges(df)))
    tagged = df.withColumn("_r", F.floor(F.col(hash_col) / F.lit(width)).cast("int"))
    counts = tagged.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*by)
    offsets = counts.select(*by, "_r", F.coalesce(F.sum("_cnt").over(w_off), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(w_all).alias("_group_n"))
    w_in = Window.partitionBy(*by, "_r").orderBy(F.col(hash_col), *[F.col(quoted(t)) for t in tie_cols])
    ranked = tagged.withColumn("_rn", F.row_number().over(w_in))
    return (null_safe_join(ranked, offsets, [*g, "_r"])
            .withColumn(out, F.col("_off") + F.col("_rn") - 1)
            .drop("_r", "_rn", "_off"))


def cumulative_by_value(df: DataFrame, value: str, weights: Sequence[str], group_cols: Sequence[str] = (),
                        ranges: int | None = None) -> DataFrame:
    """Per distinct (group, value): the weight sums at that value and strictly below it.

    Rows are first combined to distinct values (map-side), so a hot value is
    one row.  Spark's range partitioning over (group, value) cuts the order; the
    combined table with its range numbers is written once to the shared checkpoint
    folder, since both the range totals and the in-range sums read it.
    Output columns: group..., value, w (at value), below_w (< value), total_w.
    """
    g = list(group_cols)
    combined = df.groupBy(*g, value).agg(*[F.sum(w).alias(w) for w in weights])
    cut = combined.repartitionByRange(ranges, *g, value) if ranges else combined.repartitionByRange(*g, value)
    tagged = cut_lineage(cut.withColumn("_r", F.spark_partition_id()))
    per_range = tagged.groupBy(*g, "_r").agg(*[F.sum(w).alias(f"_rs_{w}") for w in weights])
    w_off = Window.partitionBy(*g).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*g)
    offsets = per_range.select(*g, "_r",
                               *[F.coalesce(F.sum(f"_rs_{w}").over(w_off), F.lit(0)).alias(f"_off_{w}")
                                 for w in weights],
                               *[F.sum(f"_rs_{w}").over(w_all).alias(f"total_{w}") for w in weights])
    w_in = Window.partitionBy(*g, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inner = tagged.select(*g, value, "_r", *weights,
                          *[F.coalesce(F.sum(w).over(w_in), F.lit(0)).alias(f"_in_{w}") for w in weights])
    out = null_safe_join(inner, offsets, [*g, "_r"])
    return out.select(*g, value, *weights,
                      *[(F.col(f"_off_{w}") + F.col(f"_in_{w}")).alias(f"below_{w}") for w in weights],
                      *[F.col(f"total_{w}") for w in weights])


def average_ranks(df: DataFrame, value: str, ranges: int | None = None) -> DataFrame:
    """(value, rank): 1-based average rank of each distinct value (ties share the mean rank)."""
    ones = df.select(value, F.lit(1.0).alias("_one")).where(F.col(value).isNotNull())
    c = cumulative_by_value(ones, value, ["_one"], ranges=ranges)
    return c.select(value, (F.col("below__one") + (F.col("_one") + F.lit(1.0)) / F.lit(2.0)).alias("rank"))


def average_ranks_long(df: DataFrame, cols: Sequence[str], ranges: int | None = None) -> DataFrame:
    """(column, value, rank) for several numeric columns in one plan."""
    long = (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([], list(cols), "column", "value").where(F.col("value").isNotNull())
            .withColumn("_one", F.lit(1.0)))
    c = cumulative_by_value(long, "value", ["_one"], ["column"], ranges=ranges)
    return c.select("column", "value", (F.col("below__one") + (F.col("_one") + F.lit(1.0)) / F.lit(2.0)).alias("rank"))
