"""Queries: aggregations and profiling (A1-A26), sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions.columns import round_half_away, sql_hash_unit

from tablesmith.operators import profile as P
from tablesmith.queries import register
from tablesmith.queries.common import LINEITEM_NUM, T
from tablesmith.queries.q_clean import SURVEY_COLS, SURVEY_SQL, survey_answers
from tablesmith.queries.q_prepare import HOLES_SQL, _customer_holes

PART_STATS = ["p_partkey", "p_size", "p_retailprice"]


def _rounded(df, cols, digits=6):
    return df.withColumns({c: round_half_away(c, digits) for c in cols})


@register("group_count", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_group_count(spark, sf):
    return P.group_count(T(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@register("group_mean", "SELECT p_type, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in PART_STATS)
          + " FROM part GROUP BY p_type")
def q_group_mean(spark, sf):
    g = P.group_mean(T(spark, sf, "part").drop("p_name", "p_brand"), "p_type")
    return _rounded(g, [f"mean_{c}" for c in PART_STATS])


@register("group_max", "SELECT p_type, " + ", ".join(f"max({c}) AS max_{c}" for c in PART_STATS)
          + " FROM part GROUP BY p_type")
def q_group_max(spark, sf):
    return P.group_max(T(spark, sf, "part"), "p_type", PART_STATS)


@register("group_min", "SELECT p_type, " + ", ".join(f"min({c}) AS min_{c}" for c in PART_STATS)
          + " FROM part GROUP BY p_type")
def q_group_min(spark, sf):
    return P.group_min(T(spark, sf, "part"), "p_type", PART_STATS)


@register("group_sum", """
SELECT p_type, CAST(sum(p_partkey) AS BIGINT) AS sum_p_partkey, CAST(sum(p_size) AS BIGINT) AS sum_p_size,
       round(sum(p_retailprice), 4) AS sum_p_retailprice FROM part GROUP BY p_type""")
def q_group_sum(spark, sf):
    g = P.group_sum(T(spark, sf, "part"), "p_type", PART_STATS)
    return g.withColumn("sum_p_retailprice", round_half_away("sum_p_retailprice", 4))


def _describe_sql(src, cols, with_q=False):
    parts = []
    for c in cols:
        q = (f", round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
             f"round(quantile_cont({c}, 0.75), 6) AS p75") if with_q else ""
        parts.append(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
                     f"round(stddev_samp({c}), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS min, "
                     f"CAST(max({c}) AS DOUBLE) AS max{q} FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("describe", _describe_sql("lineitem", LINEITEM_NUM))
def q_describe(spark, sf):
    return _rounded(P.describe(T(spark, sf, "lineitem"), LINEITEM_NUM), ["mean", "stddev"])


@register("summary", _describe_sql("lineitem", LINEITEM_NUM, with_q=True))
def q_summary(spark, sf):
    return _rounded(P.summary(T(spark, sf, "lineitem"), LINEITEM_NUM), ["mean", "stddev", "p25", "p50", "p75"])


_HOLE_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("missing_counts", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_missing, count(*) AS n_rows, "
    f"round((count(*) - count({c})) / count(*), 6) AS share_missing FROM {HOLES_SQL} h" for c in _HOLE_COLS))
def q_missing(spark, sf):
    return _rounded(P.missing_counts(_customer_holes(spark, sf)), ["share_missing"])


_ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@register("table_shape", "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, count(*) AS n_rows, "
    f"{len(_ORDERS_COLS)} AS n_cols FROM orders" for i, (c, t) in enumerate(_ORDERS_COLS)))
def q_shape(spark, sf):
    return P.table_shape(T(spark, sf, "orders"))


@register("value_share", """
SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share
FROM orders GROUP BY o_orderpriority""")
def q_value_share(spark, sf):
    return _rounded(P.value_share(T(spark, sf, "orders"), "o_orderpriority"), ["share"])


@register("rating_distribution", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS value, count(*) AS n,
        round(count(*) * 100.0 / (SELECT count({c}) FROM {SURVEY_SQL} t), 2) AS pct,
        round((SELECT avg({c}) FROM {SURVEY_SQL} t), 6) AS col_mean
        FROM {SURVEY_SQL} s GROUP BY {c}""" for c in SURVEY_COLS))
def q_rating(spark, sf):
    out = P.rating_distribution(survey_answers(spark, sf), SURVEY_COLS)
    return out.withColumns({"pct": round_half_away("pct", 2), "col_mean": round_half_away("col_mean", 6)})


@register("column_means", "SELECT " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in SURVEY_COLS)
          + f" FROM {SURVEY_SQL} s")
def q_column_means(spark, sf):
    return _rounded(P.column_means(survey_answers(spark, sf), SURVEY_COLS), [f"mean_{c}" for c in SURVEY_COLS])


@register("overall_mean", f"""
SELECT round(sum({' + '.join(SURVEY_COLS)}) / (count(*) * {len(SURVEY_COLS)}.0), 6) AS overall_mean,
       CAST(count(*) * {len(SURVEY_COLS)} AS BIGINT) AS n_cells FROM {SURVEY_SQL} s""")
def q_overall_mean(spark, sf):
    return _rounded(P.overall_mean(survey_answers(spark, sf), SURVEY_COLS), ["overall_mean"])


@register("group_avg_sorted", """
SELECT event_type, round(avg(value), 6) AS avg_value, count(*) AS n FROM events GROUP BY event_type""")
def q_group_avg_sorted(spark, sf):
    return _rounded(P.group_avg_sorted(T(spark, sf, "events"), "event_type", "value"), ["avg_value"])


@register("distinct_and_range", """
SELECT count(DISTINCT o_custkey) AS n_ids, min(o_orderdate) AS min_date, max(o_orderdate) AS max_date FROM orders""")
def q_distinct_range(spark, sf):
    return P.distinct_and_range(T(spark, sf, "orders"), "o_custkey", "o_orderdate")


@register("min_group_size", """
SELECT * FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 15)""")
def q_min_group(spark, sf):
    return P.min_group_size(T(spark, sf, "orders"), "o_custkey", 15)


@register("confusion_matrix", """
SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, CAST(l_discount >= 0.05 AS INTEGER) AS prediction,
       count(*) AS n FROM lineitem GROUP BY 1, 2""")
def q_confusion(spark, sf):
    li = T(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                                         (F.col("l_discount") >= 0.05).cast("int").alias("prediction"))
    return P.confusion_matrix(li)


_QPROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


@register("exact_quantiles", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {p} AS p, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem"
    for c in LINEITEM_NUM for p in _QPROBS))
def q_exact_quantiles(spark, sf):
    return _rounded(P.exact_quantiles(T(spark, sf, "lineitem"), LINEITEM_NUM, _QPROBS), ["value"])


@register("approx_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS p, 1 AS within_rank_error"
    for c in LINEITEM_NUM for p in (0.01, 0.5, 0.99)))
def q_approx_quantiles(spark, sf):
    """Sketch quantiles: the share of rows below the value, and up to it, meets p within the rank error."""
    li, error = T(spark, sf, "lineitem"), 0.01
    found = P.approx_quantiles(li, LINEITEM_NUM, [0.01, 0.5, 0.99], error).collect()  # one row per column and p
    shares = [e for i, r in enumerate(found) for e in (
        F.avg((F.col(r["column"]) < r["value"]).cast("double")).alias(f"b{i}"),
        F.avg((F.col(r["column"]) <= r["value"]).cast("double")).alias(f"u{i}"))]
    one = li.agg(*shares)
    rows = [F.struct(F.lit(r["column"]).alias("column"), F.lit(r["p"]).alias("p"),
                     ((F.col(f"b{i}") <= r["p"] + error) & (F.col(f"u{i}") >= r["p"] - error)).cast("int").alias("within_rank_error"))
            for i, r in enumerate(found)]
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def _pairs_sql(cols, expr, src):
    rows = []
    for i, a in enumerate(cols):
        rows.append(f"SELECT '{a}' AS x, '{a}' AS y, 1.0 AS r")
        for b in cols[i + 1:]:
            e = expr(a, b)
            rows.append(f"SELECT '{a}' AS x, '{b}' AS y, round({e}, 6) AS r FROM {src}")
            rows.append(f"SELECT '{b}' AS x, '{a}' AS y, round({e}, 6) AS r FROM {src}")
    return "\nUNION ALL\n".join(rows)


@register("corr_matrix_pearson", _pairs_sql(LINEITEM_NUM, lambda a, b: f"corr({a}, {b})", "lineitem"))
def q_pearson(spark, sf):
    return P.corr_matrix_pearson(T(spark, sf, "lineitem"), LINEITEM_NUM, digits=6)


_RANKS = "(SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in LINEITEM_NUM) \
    + " FROM lineitem)"


@register("corr_matrix_spearman", _pairs_sql(LINEITEM_NUM, lambda a, b: f"corr(r_{a}, r_{b})", _RANKS + " rk"))
def q_spearman(spark, sf):
    return P.corr_matrix_spearman(T(spark, sf, "lineitem"), LINEITEM_NUM, digits=6)


KENDALL_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _kendall_sql(cols):
    """Brute-force pair count over distinct points (exact; small because these
    columns have few distinct values)."""
    rows = []
    for i, a in enumerate(cols):
        rows.append(f"SELECT '{a}' AS x, '{a}' AS y, 1.0 AS r")
        for b in cols[i + 1:]:
            pts = f"(SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2)"
            s = (f"(SELECT sum(p.w * q.w * sign(p.x - q.x) * sign(p.y - q.y)) FROM {pts} p, {pts} q "
                 f"WHERE p.x > q.x)")
            n = "(SELECT count(*)::DOUBLE FROM lineitem)"
            tx = f"(SELECT sum(t * (t - 1) / 2) FROM (SELECT count(*)::DOUBLE AS t FROM lineitem GROUP BY {a}))"
            ty = f"(SELECT sum(t * (t - 1) / 2) FROM (SELECT count(*)::DOUBLE AS t FROM lineitem GROUP BY {b}))"
            e = f"round({s} / sqrt(({n} * ({n} - 1) / 2 - {tx}) * ({n} * ({n} - 1) / 2 - {ty})), 6)"
            rows.append(f"SELECT '{a}' AS x, '{b}' AS y, {e} AS r")
            rows.append(f"SELECT '{b}' AS x, '{a}' AS y, {e} AS r")
    return "\nUNION ALL\n".join(rows)


@register("corr_matrix_kendall", _kendall_sql(KENDALL_COLS))
def q_kendall(spark, sf):
    return P.corr_matrix_kendall(T(spark, sf, "lineitem"), KENDALL_COLS, digits=6)


def _hist_sql(c, bins, src):
    return f"""
WITH mm AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {src}),
b AS (SELECT least(CAST(floor(({c} - lo) / ((hi - lo) / {bins})) AS INTEGER), {bins - 1}) AS bin
      FROM {src}, mm),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT g.bin, round(lo + g.bin * ((hi - lo) / {bins}), 6) AS lower,
       round(lo + (g.bin + 1) * ((hi - lo) / {bins}), 6) AS upper,
       (SELECT count(*) FROM b WHERE b.bin = g.bin) AS n
FROM g, mm"""


@register("histogram", _hist_sql("l_extendedprice", 30, "lineitem"))
def q_histogram(spark, sf):
    return _rounded(P.histogram(T(spark, sf, "lineitem"), "l_extendedprice", 30), ["lower", "upper"])


def _bin_sql(c, lo, hi, bins):
    return f"least(CAST(floor(({c} - {lo}) / (({hi} - {lo}) / {bins})) AS INTEGER), {bins - 1})"


@register("scatter_bins", f"""
WITH mm AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_extendedprice) AS yl,
                   max(l_extendedprice) AS yh FROM lineitem)
SELECT {_bin_sql('l_quantity', 'xl', 'xh', 20)} AS bx, {_bin_sql('l_extendedprice', 'yl', 'yh', 20)} AS "by",
       count(*) AS n
FROM lineitem, mm GROUP BY 1, 2""")
def q_scatter(spark, sf):
    return P.scatter_bins(T(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 20)


@register("scatter_sample", f"""
SELECT l_quantity, l_extendedprice FROM lineitem
ORDER BY {sql_hash_unit(['l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey'], 'scatter')},
         l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 500""")
def q_scatter_sample(spark, sf):
    """500 plot points chosen by key hash (the sample is the feature)."""
    return P.scatter_sample(T(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 500,
                            key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


_PAIR_COLS = ["p_size", "p_retailprice", "p_partkey"]


def _pair_bins_sql():
    mm = "(SELECT " + ", ".join(f"min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}" for c in _PAIR_COLS) \
         + " FROM part)"
    binned = "(SELECT " + ", ".join(f"{_bin_sql(c, 'lo_' + c, 'hi_' + c, 10)} AS {c}" for c in _PAIR_COLS) \
             + f" FROM part, {mm} mm)"
    rows = []
    for a in _PAIR_COLS:
        for b in _PAIR_COLS:
            if a == b:
                rows.append(f"SELECT '{a}' AS x, '{b}' AS y, {a} AS bx, {a} AS \"by\", count(*) AS n "
                            f"FROM {binned} t GROUP BY {a}")
            else:
                rows.append(f"SELECT '{a}' AS x, '{b}' AS y, {a} AS bx, {b} AS \"by\", count(*) AS n "
                            f"FROM {binned} t GROUP BY {a}, {b}")
    return "\nUNION ALL\n".join(rows)


@register("pair_bins", _pair_bins_sql())
def q_pair_bins(spark, sf):
    return P.pair_bins(T(spark, sf, "part"), _PAIR_COLS, 10)


def _profile_sql(src, cols, d=9):
    parts = []
    for c in cols:
        m = f"(SELECT avg({c}) FROM {src})"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS n_missing, "
            f"count(DISTINCT {c}) AS n_distinct, round(avg(CAST({c} AS DECIMAL(38,18))), {d}) AS mean, "
            f"round(stddev_samp({c}), {d}) AS stddev, round(min({c}), {d}) AS min, round(max({c}), {d}) AS max, "
            f"round(avg(power({c} - {m}, 3)) / power(avg(power({c} - {m}, 2)), 1.5), {d}) AS skewness, "
            f"round(kurtosis_pop({c}), {d}) AS kurtosis, round(quantile_cont({c}, 0.25), {d}) AS p25, "
            f"round(quantile_cont({c}, 0.5), {d}) AS p50, round(quantile_cont({c}, 0.75), {d}) AS p75 FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("profile_report", _profile_sql("lineitem", LINEITEM_NUM))
def q_profile_report(spark, sf):
    rep = P.profile_report(T(spark, sf, "lineitem"), LINEITEM_NUM, with_rank_corr=False, digits=9)
    return rep["columns"]


_REPORT_COLS = ["l_quantity", "l_discount", "l_tax"]
_REPORT_RANKS = "(SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in _REPORT_COLS) + " FROM lineitem) rk"


@register("profile_report_correlations", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, * FROM ({q})" for k, q in (
        ("pearson", _pairs_sql(_REPORT_COLS, lambda a, b: f"corr({a}, {b})", "lineitem")),
        ("spearman", _pairs_sql(_REPORT_COLS, lambda a, b: f"corr(r_{a}, r_{b})", _REPORT_RANKS)),
        ("kendall", _kendall_sql(_REPORT_COLS)))))
def q_profile_correlations(spark, sf):
    """The report's three correlation tables."""
    rep = P.profile_report(T(spark, sf, "lineitem"), _REPORT_COLS, digits=6)
    kinds = [rep[k].select(F.lit(k).alias("kind"), "x", "y", "r") for k in ("pearson", "spearman", "kendall")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


# ------------------------------------------------------------------ T1-T3

@register("order_limit", """
SELECT * FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10""")
def q_order_limit(spark, sf):
    return P.order_limit(T(spark, sf, "lineitem"), "l_extendedprice", 10,
                         tiebreak=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@register("head_tail", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def q_head_tail(spark, sf):
    return P.head_tail(T(spark, sf, "orders"), "o_orderkey", 5, last=True)


@register("sort_series", """
SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY 1, 2""")
def q_sort_series(spark, sf):
    e = T(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return P.sort_series(e, "event_type", "day")
