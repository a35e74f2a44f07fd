"""The statistics over a table with gaps: nulls and NaN made by rule (D1: both are missing)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import round_half_away
from tablesmith.operators import abtest as AB
from tablesmith.operators import clean as CL
from tablesmith.operators import evaluate as EV
from tablesmith.operators import features as FE
from tablesmith.operators import forecast as FC
from tablesmith.operators import profile as P
from tablesmith.operators import select as S
from tablesmith.queries import register
from tablesmith.queries.common import T
from tablesmith.queries.q_selection import _mi_quantile_sql

COLS = ["qty", "disc", "tax"]
GAPS = """(SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS qty,
  CASE WHEN l_suppkey % 5 <> 0 THEN l_discount END AS disc, CASE WHEN l_orderkey % 11 <> 0 THEN l_tax END AS tax,
  CASE WHEN l_partkey % 13 <> 0 THEN l_extendedprice END AS price FROM lineitem)"""


def gappy(spark, sf) -> DataFrame:
    """lineitem with missing quantities and prices (null), and missing discounts and taxes (NaN)."""
    nan = F.lit(float("nan"))
    return T(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("qty"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_discount")).otherwise(nan).alias("disc"),
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_tax")).otherwise(nan).alias("tax"),
        F.when(F.col("l_partkey") % 13 != 0, F.col("l_extendedprice")).alias("price"))


def _r(df, cols, d=6):
    return df.withColumns({c: round_half_away(c, d) for c in cols})


@register("gaps_group_mean", f"SELECT l_returnflag, round(avg(qty), 6) AS mean_qty, round(avg(disc), 6) AS mean_disc, "
          f"round(avg(tax), 6) AS mean_tax FROM {GAPS} g GROUP BY 1")
def q_group_mean(spark, sf):
    return _r(P.group_mean(gappy(spark, sf), "l_returnflag", COLS), [f"mean_{c}" for c in COLS])


@register("gaps_group_max", f"SELECT l_returnflag, max(qty) AS max_qty, max(disc) AS max_disc, max(tax) AS max_tax "
          f"FROM {GAPS} g GROUP BY 1")
def q_group_max(spark, sf):
    return P.group_max(gappy(spark, sf), "l_returnflag", COLS)


@register("gaps_column_means", f"SELECT round(avg(qty), 6) AS mean_qty, round(avg(disc), 6) AS mean_disc, "
          f"round(avg(tax), 6) AS mean_tax FROM {GAPS} g")
def q_column_means(spark, sf):
    return _r(P.column_means(gappy(spark, sf), COLS), [f"mean_{c}" for c in COLS])


@register("gaps_overall_mean", f"SELECT round((sum(qty) + sum(disc) + sum(tax)) / (count(qty) + count(disc) + count(tax)), 6) "
          f"AS overall_mean, count(qty) + count(disc) + count(tax) AS n_cells FROM {GAPS} g")
def q_overall_mean(spark, sf):
    return _r(P.overall_mean(gappy(spark, sf), COLS), ["overall_mean"])


def _pairs_sql(of):
    one = [f"SELECT '{a}' AS x, '{b}' AS y, {of(a, b) if a != b else '1.0::DOUBLE'} AS r" for a in COLS for b in COLS]
    return " UNION ALL ".join(one)


@register("gaps_pearson", _pairs_sql(lambda a, b: f"(SELECT round(corr({min(a, b)}, {max(a, b)}), 6) FROM {GAPS} g)"))
def q_pearson(spark, sf):
    return P.corr_matrix_pearson(gappy(spark, sf), COLS, digits=6)


def _rank_corr(a, b):
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    return (f"(SELECT round(corr(ra, rb), 6) FROM (SELECT {rank.format(a)} AS ra, {rank.format(b)} AS rb "
            f"FROM {GAPS} g WHERE {a} IS NOT NULL AND {b} IS NOT NULL))")


@register("gaps_spearman", _pairs_sql(_rank_corr))
def q_spearman(spark, sf):
    """Pairwise: a gap in a third column changes nothing."""
    return P.corr_matrix_spearman(gappy(spark, sf), COLS, digits=6)


@register("gaps_mutual_information", _mi_quantile_sql(COLS, "price", src=f"{GAPS} g"))
def q_mi(spark, sf):
    return _r(S.mutual_information(gappy(spark, sf), COLS, "price", 10, 10), ["mi"])


@register("gaps_select_k_best_f", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, price), 6) AS r, round(corr({c}, price) ^ 2 / (1 - corr({c}, price) ^ 2) "
    f"* (count(*) FILTER ({c} IS NOT NULL AND price IS NOT NULL) - 2), 4) AS f_score FROM {GAPS} g" for c in COLS))
def q_k_best(spark, sf):
    s = S.select_k_best_f(gappy(spark, sf), COLS, "price", k=2)
    return s.select("feature", round_half_away("r", 6).alias("r"), round_half_away("f_score", 4).alias("f_score"))


@register("gaps_variance_threshold", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_samp({c}), 6) AS variance, CAST(var_samp({c}) > 0.01 AS INTEGER) AS selected "
    f"FROM {GAPS} g" for c in COLS))
def q_variance(spark, sf):
    return _r(S.variance_threshold(gappy(spark, sf), COLS, 0.01), ["variance"])


@register("gaps_scatter_bins", f"""
WITH mm AS (SELECT min(disc) AS xl, max(disc) AS xh, min(tax) AS yl, max(tax) AS yh FROM {GAPS} g)
SELECT least(CAST(floor((disc - xl) / ((xh - xl) / 7)) AS INTEGER), 6) AS bx,
  least(CAST(floor((tax - yl) / ((yh - yl) / 7)) AS INTEGER), 6) AS by, count(*) AS n
FROM {GAPS} g, mm WHERE disc IS NOT NULL AND tax IS NOT NULL GROUP BY 1, 2""")
def q_scatter(spark, sf):
    return P.scatter_bins(gappy(spark, sf), "disc", "tax", 7)


@register("gaps_eval_regression", f"""
SELECT round(sqrt(avg((price - p) ^ 2)), 4) AS rmse, round(avg(abs(price - p)), 4) AS mae,
  round(1 - sum((price - p) ^ 2) / (var_pop(price) * count(price)), 6) AS r2, count(*) AS n
FROM (SELECT price, qty * 1500 AS p FROM {GAPS} g) WHERE price IS NOT NULL AND p IS NOT NULL""")
def q_eval_regression(spark, sf):
    d = gappy(spark, sf).select(F.col("price").alias("label"), (F.col("qty") * 1500).alias("prediction"))
    e = EV.eval_regression(d)
    return e.select(round_half_away("rmse", 4).alias("rmse"), round_half_away("mae", 4).alias("mae"),
                    round_half_away("r2", 6).alias("r2"), "n")


@register("gaps_scale_standard", f"""
WITH m AS (SELECT avg(disc) AS m, stddev_samp(disc) AS s FROM {GAPS} g)
SELECT l_orderkey, l_linenumber, round((disc - m) / s, 6) AS disc_std FROM {GAPS} g, m""")
def q_scale(spark, sf):
    d = FE.scale_standard_wide(gappy(spark, sf), ["disc"])
    return d.select("l_orderkey", "l_linenumber", round_half_away("disc_std", 6).alias("disc_std"))


@register("gaps_scale_minmax", f"""
WITH m AS (SELECT min(tax) AS lo, max(tax) AS hi FROM {GAPS} g)
SELECT l_orderkey, l_linenumber, round((tax - lo) / (hi - lo), 6) AS tax_minmax FROM {GAPS} g, m""")
def q_minmax(spark, sf):
    d = FE.scale_minmax_wide(gappy(spark, sf), ["tax"])
    return d.select("l_orderkey", "l_linenumber", round_half_away("tax_minmax", 6).alias("tax_minmax"))


@register("gaps_group_avg_sorted", f"SELECT l_returnflag, round(avg(disc), 6) AS avg_disc, count(*) AS n FROM {GAPS} g GROUP BY 1")
def q_group_avg_sorted(spark, sf):
    return _r(P.group_avg_sorted(gappy(spark, sf), "l_returnflag", "disc"), ["avg_disc"])


_FIELDS = ["l_orderkey", "l_linenumber", "l_returnflag", "qty", "disc", "tax", "price"]


@register("gaps_table_shape", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) AS n_rows FROM {GAPS} g" for c in _FIELDS))
def q_table_shape(spark, sf):
    return P.table_shape(gappy(spark, sf)).select("column", "non_null", "n_rows")


@register("gaps_threshold_flag", f"SELECT l_orderkey, l_linenumber, (disc > 0.05)::INTEGER AS high, (tax <> 0.02)::INTEGER AS odd FROM {GAPS} g")
def q_threshold_flag(spark, sf):
    d = CL.threshold_flag(CL.threshold_flag(gappy(spark, sf), "high", "disc", ">", 0.05), "odd", "tax", "!=", 0.02)
    return d.select("l_orderkey", "l_linenumber", "high", "odd")


@register("gaps_case_bins", f"SELECT l_orderkey, l_linenumber, CASE WHEN tax IS NULL THEN NULL WHEN tax < 0.03 THEN 'low' ELSE 'high' END AS band FROM {GAPS} g")
def q_case_bins(spark, sf):
    return CL.case_bins(gappy(spark, sf), "band", "tax", [0.03], ["low", "high"]).select("l_orderkey", "l_linenumber", "band")


@register("gaps_filter_range", f"""SELECT 'strict' AS kind, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM {GAPS} g WHERE disc >= 0.05 AND qty <= 30
UNION ALL SELECT 'missing kept', count(*), sum(l_orderkey)::BIGINT FROM {GAPS} g WHERE (disc IS NULL OR disc >= 0.05) AND (qty IS NULL OR qty <= 30)""")
def q_filter_range(spark, sf):
    bounds = {"disc": (0.05, None), "qty": (None, 30.0)}
    found = [CL.filter_range(gappy(spark, sf), bounds, keep).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))
             for kind, keep in (("strict", False), ("missing kept", True))]
    return found[0].unionByName(found[1])


@register("gaps_eval_smape", f"""SELECT round(avg(CASE WHEN abs(disc) + abs(tax) = 0 THEN 0 ELSE 2 * abs(disc - tax) / (abs(disc) + abs(tax)) END), 6) AS smape,
  count(*) AS n FROM {GAPS} g WHERE disc IS NOT NULL AND tax IS NOT NULL""")
def q_eval_smape(spark, sf):
    return _r(EV.eval_smape(gappy(spark, sf), "disc", "tax"), ["smape"])


@register("gaps_eval_multiclass", f"""WITH p AS (SELECT disc AS y, tax AS p FROM {GAPS} g WHERE disc IS NOT NULL AND tax IS NOT NULL),
c AS (SELECT DISTINCT y AS c FROM p),
s AS (SELECT c, (SELECT count(*) FROM p WHERE y = c) AS support, (SELECT count(*) FROM p WHERE p.p = c) AS predicted,
  (SELECT count(*) FROM p WHERE y = c AND p.p = c) AS tp FROM c)
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(CASE WHEN tp > 0 THEN support * 2.0 * tp / (support + predicted) ELSE 0 END) / sum(support), 6) AS weighted_f1,
  sum(support)::BIGINT AS n FROM s""")
def q_eval_multiclass(spark, sf):
    """Discounts taken as labels and taxes as predictions: rows that miss either do not count."""
    return _r(EV.eval_multiclass(gappy(spark, sf), "disc", "tax"), ["accuracy", "weighted_f1"])


@register("gaps_ab_metrics", f"""SELECT l_returnflag, count(*) AS n, round(avg((disc = tax)::INTEGER), 6) AS accuracy, round(avg(disc), 6) AS mean_prediction
FROM {GAPS} g WHERE disc IS NOT NULL AND tax IS NOT NULL GROUP BY 1""")
def q_ab_metrics(spark, sf):
    return _r(AB.ab_metrics(gappy(spark, sf), "l_returnflag", "disc", "tax"), ["accuracy", "mean_prediction"])


@register("gaps_series_prepare", f"""SELECT id, day, round(greatest(y, 0.0), 6) AS y FROM (
  SELECT event_type AS id, ts::DATE AS day, sum(CASE WHEN event_id % 9 <> 0 THEN value END) AS y FROM events GROUP BY 1, 2)
  WHERE id IN (SELECT event_type FROM events GROUP BY 1 HAVING count(DISTINCT ts::DATE) >= 20)""")
def q_series_prepare(spark, sf):
    e = T(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 9 != 0, F.col("value")).otherwise(F.lit(float("nan"))))
    return _r(FC.series_prepare(e, "event_type", "ts", "value", min_len=20), ["y"])
