"""Queries: slice 1, imputation (I1-I4), outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions.columns import hash_bucket, sql_hash_bucket, round_half_away
from tablesmith.operators import clean, impute, outliers
from tablesmith.queries import register
from tablesmith.queries.common import LINEITEM_NUM, T

# ------------------------------------------------------------------ slice 1

def _pct_filter_sql(src: str, cols, lo=0.01, hi=0.99) -> str:
    b = ", ".join(f"quantile_cont({c}, {lo}) AS lo_{c}, quantile_cont({c}, {hi}) AS hi_{c}" for c in cols)
    cond = " AND ".join(f"{c} >= lo_{c} AND {c} <= hi_{c}" for c in cols)
    return f"SELECT s.* FROM {src} s, (SELECT {b} FROM {src}) b WHERE {cond}"


FLAGSHIP_SQL = f"""
WITH f AS ({_pct_filter_sql('lineitem', LINEITEM_NUM)})
SELECT l_returnflag,
       {", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in LINEITEM_NUM)},
       round(avg(l_extendedprice / nullif(l_quantity, 0)), 6) AS mean_price_per_qty,
       count(*) AS n
FROM f GROUP BY l_returnflag
"""


@register("flagship_clean_profile", FLAGSHIP_SQL)
def flagship(spark, sf):
    """lineitem -> percentile outliers (X2) -> ratio (P4) -> mean by flag (A2)."""
    li = T(spark, sf, "lineitem")
    kept = outliers.outlier_percentile(li, LINEITEM_NUM, 0.01, 0.99)
    kept = clean.ratio_features(kept, ratios={"price_per_qty": ("l_extendedprice", "l_quantity")})
    cols = LINEITEM_NUM + ["price_per_qty"]
    g = kept.groupBy("l_returnflag").agg(*[round_half_away(F.avg(c), 6).alias(f"mean_{c}") for c in cols],
                                         F.count(F.lit(1)).alias("n"))
    return g


# ------------------------------------------------------------------ X1-X3

@register("outlier_percentile", _pct_filter_sql("lineitem", LINEITEM_NUM))
def q_outlier_percentile(spark, sf):
    return outliers.outlier_percentile(T(spark, sf, "lineitem"), LINEITEM_NUM, 0.01, 0.99)


def _iqr_sequential_sql(src, cols, k=1.5):
    parts, prev = [], src
    for i, c in enumerate(cols):
        parts.append(f"b{i} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {prev})")
        parts.append(f"f{i} AS (SELECT s.* FROM {prev} s, b{i} WHERE {c} >= q1 - {k} * (q3 - q1) "
                     f"AND {c} <= q3 + {k} * (q3 - q1))")
        prev = f"f{i}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT * FROM {prev}"


IQR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("outlier_iqr", _iqr_sequential_sql("lineitem", IQR_COLS, 0.2))
def q_outlier_iqr(spark, sf):
    """Sequential IQR fences (D3) with k=0.2 so that every column removes rows."""
    return outliers.outlier_iqr(T(spark, sf, "lineitem"), IQR_COLS, k=0.2, mode="sequential")


def _iqr_simultaneous_sql(src, cols, k):
    b = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)
    cond = " AND ".join(f"{c} >= q1_{c} - {k} * (q3_{c} - q1_{c}) AND {c} <= q3_{c} + {k} * (q3_{c} - q1_{c})"
                        for c in cols)
    return f"SELECT s.* FROM {src} s, (SELECT {b} FROM {src}) b WHERE {cond}"


@register("outlier_iqr_simultaneous", _iqr_simultaneous_sql("lineitem", IQR_COLS, 0.2))
def q_outlier_iqr_sim(spark, sf):
    return outliers.outlier_iqr(T(spark, sf, "lineitem"), IQR_COLS, k=0.2, mode="simultaneous")


ZCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_Z_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ZCOLS)
_Z_SQL = (f"SELECT s.* FROM lineitem s, (SELECT {_Z_STATS} FROM lineitem) b WHERE "
          + " AND ".join(f"abs(({c} - m_{c}) / s_{c}) < 2.0" for c in ZCOLS))


@register("outlier_zscore", _Z_SQL)
def q_outlier_zscore(spark, sf):
    """z-score filter, threshold 2.0 so that rows are removed at this data's spread."""
    return outliers.outlier_zscore(T(spark, sf, "lineitem"), ZCOLS, threshold=2.0)


# ------------------------------------------------------------------ I1-I4
# Test tables hold no nulls: missing cells are made by rule in both engines.

def _customer_holes(spark, sf):
    c = T(spark, sf, "customer")
    return c.withColumns({
        "c_acctbal": F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("c_acctbal")),
        "c_mktsegment": F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")),
        "c_nationkey": F.when(F.col("c_custkey") % 11 == 0, F.lit(None)).otherwise(F.col("c_nationkey")),
    })


HOLES_SQL = """(SELECT c_custkey, c_name,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""


@register("impute_constant", f"""
SELECT c_custkey, c_name, coalesce(c_nationkey, -1) AS c_nationkey, coalesce(c_acctbal, 0.0) AS c_acctbal,
       coalesce(c_mktsegment, 'Unknown') AS c_mktsegment FROM {HOLES_SQL} h""")
def q_impute_constant(spark, sf):
    return impute.impute_constant(_customer_holes(spark, sf),
                                  {"c_acctbal": 0.0, "c_mktsegment": "Unknown", "c_nationkey": -1})


@register("impute_mean", f"""
SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {HOLES_SQL} x)), 6) AS c_acctbal_imputed
FROM {HOLES_SQL} h""")
def q_impute_mean(spark, sf):
    out = impute.impute_mean(_customer_holes(spark, sf), ["c_acctbal"], suffix="_imputed")
    return out.select("c_custkey", round_half_away("c_acctbal_imputed", 6).alias("c_acctbal_imputed"))


@register("impute_median", f"""
SELECT c_custkey, round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM {HOLES_SQL} x)), 6)
       AS c_acctbal_imputed
FROM {HOLES_SQL} h""")
def q_impute_median(spark, sf):
    out = impute.impute_median(_customer_holes(spark, sf), ["c_acctbal"], exact=True, suffix="_imputed")
    return out.select("c_custkey", round_half_away("c_acctbal_imputed", 6).alias("c_acctbal_imputed"))


@register("impute_mode", f"""
WITH h AS {HOLES_SQL},
tr AS (SELECT * FROM h WHERE {sql_hash_bucket(['c_custkey'])} < 80),
ms AS (SELECT c_mktsegment AS v FROM tr WHERE c_mktsegment IS NOT NULL
       GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1),
mn AS (SELECT c_nationkey AS v FROM tr WHERE c_nationkey IS NOT NULL
       GROUP BY c_nationkey ORDER BY count(*) DESC, c_nationkey LIMIT 1)
SELECT c_custkey,
       CASE WHEN {sql_hash_bucket(['c_custkey'])} < 80 THEN 'train' ELSE 'test' END AS split,
       coalesce(c_mktsegment, (SELECT v FROM ms)) AS c_mktsegment,
       coalesce(c_nationkey, (SELECT v FROM mn)) AS c_nationkey
FROM h""")
def q_impute_mode(spark, sf):
    h = _customer_holes(spark, sf).withColumn(
        "split", F.when(hash_bucket(["c_custkey"]) < 80, "train").otherwise("test"))
    train = h.where(F.col("split") == "train")
    model = impute.fit_mode(train, ["c_mktsegment", "c_nationkey"])
    return model.transform(h).select("c_custkey", "split", "c_mktsegment", "c_nationkey")



