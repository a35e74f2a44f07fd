"""Queries: feature selection (K1-K10), joins (J1-J2), splits (L1-L4), evaluation (V1-V4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablesmith.functions.columns import round_half_away, sql_hash_bucket, sql_hash_unit, sql_in_share
from tablesmith.operators import evaluate as EV
from tablesmith.operators import models as M
from tablesmith.operators import select as S
from tablesmith.operators import split as SP
from tablesmith.plans import neighbours as N
from tablesmith.queries import register
from tablesmith.queries import sql_models as Q
from tablesmith.queries.common import T

FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]
TARGET = "l_extendedprice"
SMALL_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _r(df, cols, d=6):
    return df.withColumns({c: round_half_away(c, d) for c in cols})


def _corr_sql():
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, round(corr({c}, {TARGET}), 6) AS corr, round(abs(corr({c}, {TARGET})), 6) "
        f"AS abs_corr, CAST(abs(corr({c}, {TARGET})) > 0.3 AS INTEGER) AS selected FROM lineitem" for c in FEATS)


@register("select_by_correlation", _corr_sql())
def q_corr_select(spark, sf):
    return _r(S.select_by_correlation(T(spark, sf, "lineitem"), FEATS, TARGET, 0.3), ["corr", "abs_corr"])


def _bin_sql(c, lo, hi, bins):
    return (f"CASE WHEN {hi} = {lo} THEN 0 ELSE least(CAST(floor(({c} - {lo}) / (({hi} - {lo}) / {bins})) AS INTEGER), "
            f"{bins - 1}) END")


def _quantile_bin_sql(c, bins, src):
    cuts = ", ".join(str(i / bins) for i in range(1, bins))
    return (f"len(list_filter((SELECT list_distinct(quantile_cont({c}::DOUBLE, [{cuts}])) FROM {src}), lambda t: t < {c}))")


def _mi_quantile_sql(feats, target, bins=10, target_bins=10, src="lineitem"):
    """Bins by exact interpolated quantiles; missing values leave the feature's counts."""
    b = ("(SELECT " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {_quantile_bin_sql(c, bins, src)} END AS {c}" for c in feats)
         + f", CASE WHEN {target} IS NOT NULL THEN {_quantile_bin_sql(target, target_bins, src)} END AS _y FROM {src})")
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS xb, _y FROM {b} b WHERE {c} IS NOT NULL AND _y IS NOT NULL"
                              for c in feats)
    return _mi_from(long)


def _mi_sql(feats, target, bins=10, target_bins=10):
    cols = list(feats) + [target]
    mm = "(SELECT " + ", ".join(f"min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}" for c in cols) \
         + " FROM lineitem)"
    b = ("(SELECT " + ", ".join(f"{_bin_sql(c, 'lo_' + c, 'hi_' + c, bins)} AS {c}" for c in feats)
         + f", {_bin_sql(target, 'lo_' + target, 'hi_' + target, target_bins)} AS _y FROM lineitem, {mm} mm)")
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS xb, _y FROM {b} b" for c in feats)
    return _mi_from(long)


def _mi_from(long):
    return f"""
WITH j AS (SELECT feature, xb, _y, count(*)::DOUBLE AS nxy FROM ({long}) l GROUP BY feature, xb, _y),
m AS (SELECT feature, nxy, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, xb) AS nx,
             sum(nxy) OVER (PARTITION BY feature, _y) AS ny FROM j)
SELECT feature, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS mi FROM m GROUP BY feature"""


@register("mutual_information_equal_width", _mi_sql(FEATS, TARGET))
def q_mi_equal(spark, sf):
    return _r(S.mutual_information(T(spark, sf, "lineitem"), FEATS, TARGET, 10, 10, equal_width=True), ["mi"])


@register("mutual_information", _mi_quantile_sql(FEATS, TARGET))
def q_mi(spark, sf):
    return _r(S.mutual_information(T(spark, sf, "lineitem"), FEATS, TARGET, 10, 10), ["mi"])


NEAR_FEATS = ["p_size", "p_partkey"]


def _nearest_sql(feats, target, k=3, src="part"):
    """The definition over all pairs of rows; harmonic sums stand for psi of whole numbers."""
    one = " UNION ALL ".join(f"SELECT '{c}' AS feature, row_number() OVER () AS i, floor({c} / stddev_pop({c}) OVER () * {N.STEPS} + 0.5) / {N.STEPS} AS x, "
                             f"floor({target} / stddev_pop({target}) OVER () * {N.STEPS} + 0.5) / {N.STEPS} AS y FROM {src}" for c in feats)
    return f"""
WITH p AS MATERIALIZED ({one}),
psi AS MATERIALIZED (SELECT n, -0.5772156649015329 + coalesce(sum(1.0 / (n - 1)) FILTER (n > 1) OVER (ORDER BY n), 0) AS psi
  FROM range(1, (SELECT count(*) + 2 FROM {src})) r(n)),
e AS (SELECT a.feature, a.i, list_sort(min(greatest(abs(a.x - b.x), abs(a.y - b.y)), {k}))[{k}] AS eps
  FROM p a JOIN p b ON a.feature = b.feature AND a.i <> b.i GROUP BY a.feature, a.i),
c AS (SELECT a.feature, a.i, count(*) FILTER (CASE WHEN eps = 0 THEN a.x = b.x ELSE abs(a.x - b.x) < eps END) AS nx,
    count(*) FILTER (CASE WHEN eps = 0 THEN a.y = b.y ELSE abs(a.y - b.y) < eps END) AS ny
  FROM p a JOIN e USING (feature, i) JOIN p b ON a.feature = b.feature GROUP BY a.feature, a.i)
SELECT feature, round(greatest(0, (SELECT psi FROM psi WHERE n = any_value(total)) + (SELECT psi FROM psi WHERE n = {k})
  - avg(px.psi + py.psi)), 6) AS mi
FROM c JOIN psi px ON px.n = nx JOIN psi py ON py.n = ny, (SELECT count(*) AS total FROM {src}) GROUP BY feature"""


@register("mutual_information_nearest", _nearest_sql(NEAR_FEATS, "p_retailprice"))
def q_mi_nearest(spark, sf):
    """The k-nearest-neighbour estimator; the oracle compares all pairs."""
    return _r(N.nearest_mutual_information(T(spark, sf, "part"), NEAR_FEATS, "p_retailprice", 3), ["mi"])


def _each_feature(extra, of="lineitem"):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {extra} WHERE (SELECT count(*) FROM {of}) > 0" for c in FEATS)


@register("rfe", f"""WITH {Q.elimination_ctes("lineitem", FEATS, TARGET, 3)}
SELECT v.name AS feature, coalesce(rank, 1)::INTEGER AS rank, (rank IS NULL)::INTEGER AS selected
FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(FEATS))}) v(i, name) LEFT JOIN gone USING (i)""")
def q_rfe(spark, sf):
    """Linear-model elimination down to 3 of 6 features; the oracle solves each step's correlation matrix."""
    return S.rfe(T(spark, sf, "lineitem"), FEATS, TARGET, n_keep=3)


def _boosted_sql(trees, rounds, depth):
    """``imp``: importances of the trees that the CTEs ``trees`` boost on ``d``."""
    few = ", ".join(f"{c}::DOUBLE AS f_{j}" for j, c in enumerate(SMALL_FEATS))
    return (f"WITH d AS (SELECT {few}, {TARGET} AS label FROM lineitem),\n"
            + trees
            + f",\nimp AS MATERIALIZED ({Q.importance_sql(SMALL_FEATS, [f't{r}' for r in range(rounds)], depth)})\n")


def _boosted(spark, sf, rounds, depth):
    return S.tree_importance(T(spark, sf, "lineitem"), SMALL_FEATS, TARGET, "boosted", max_iter=rounds, boosted_depth=depth, max_bins=64)


@register("tree_importance", _boosted_sql(Q.boosted_split_ctes("d", len(SMALL_FEATS), "label", 50, 5, 0.1), 50, 5)
          + "SELECT feature, round(importance, 5) AS importance FROM imp")
def q_tree_importance(spark, sf):
    """Importances of 50 boosted trees of depth 5; the oracle boosts in SQL and sums the gains of its splits."""
    return _boosted(spark, sf, 50, 5).withColumn("importance", round_half_away("importance", 5))


@register("tree_importance_forest", _each_feature("1 AS not_negative, 1.0::DOUBLE AS total"))
def q_tree_importance_forest(spark, sf):
    """A forest draws its rows and features: none negative, and one in sum."""
    imp = S.tree_importance(T(spark, sf, "lineitem"), FEATS, TARGET, "forest", num_trees=20, max_depth=6)
    return imp.select("feature", (F.col("importance") >= 0).cast("int").alias("not_negative"),
                      F.round(F.sum("importance").over(Window.partitionBy()), 9).alias("total"))  # one row per feature


@register("select_from_model", _boosted_sql(Q.boosted_ctes("d", len(SMALL_FEATS), "label", 3, 3, 0.1, []), 3, 3) + """SELECT feature, round(importance, 5) AS importance,
(importance >= (SELECT quantile_cont(importance, 0.5) FROM imp))::INTEGER AS selected FROM imp""")
def q_select_from_model(spark, sf):
    """Features that reach the median importance."""
    return S.select_from_model(_boosted(spark, sf, 3, 3)).withColumn("importance", round_half_away("importance", 5))


def _f_sql():
    inner = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, corr({c}, {TARGET}) AS r, count({c}) AS n FROM lineitem" for c in FEATS)
    return f"""
WITH s AS ({inner}), f AS (SELECT feature, r, r * r / (1 - r * r) * (n - 2) AS f_score FROM s)
SELECT feature, round(r, 6) AS r, round(f_score, 4) AS f_score,
       CAST(row_number() OVER (ORDER BY f_score DESC, feature) AS INTEGER) AS rank,
       CAST(row_number() OVER (ORDER BY f_score DESC, feature) <= 3 AS INTEGER) AS selected FROM f"""


@register("select_k_best_f", _f_sql())
def q_k_best(spark, sf):
    s = S.select_k_best_f(T(spark, sf, "lineitem"), FEATS, TARGET, k=3)
    return s.withColumns({"r": round_half_away("r", 6), "f_score": round_half_away("f_score", 4)})


@register("variance_threshold", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(var_samp({c}), 6) AS variance, CAST(var_samp({c}) > 0.01 AS INTEGER) AS selected "
    f"FROM lineitem" for c in SMALL_FEATS))
def q_variance(spark, sf):
    return _r(S.variance_threshold(T(spark, sf, "lineitem"), SMALL_FEATS, 0.01), ["variance"])


CHI_FEATS = ["l_linenumber", "qty_band", "l_discount", "l_tax"]
_CHI_SRC = ("(SELECT l_returnflag, CAST(l_linenumber AS VARCHAR) AS l_linenumber, "
            "CAST(CAST(floor((l_quantity - 1) / 10) AS INTEGER) AS VARCHAR) AS qty_band, "
            "CAST(l_discount AS VARCHAR) AS l_discount, CAST(l_tax AS VARCHAR) AS l_tax FROM lineitem)")


def _chi_source(spark, sf):
    return T(spark, sf, "lineitem").select(
        "l_returnflag", "l_linenumber", F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("qty_band"),
        "l_discount", "l_tax")


def _chi_sql(k=2):
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, l_returnflag AS y FROM {_CHI_SRC} s"
                              for c in CHI_FEATS)
    return f"""
WITH l AS ({long}),
o AS (SELECT feature, x, y, count(*)::DOUBLE AS o FROM l GROUP BY ALL),
xs AS (SELECT feature, x, sum(o) AS nx FROM o GROUP BY ALL),
ys AS (SELECT feature, y, sum(o) AS ny FROM o GROUP BY ALL),
t AS (SELECT feature, sum(o) AS n, count(DISTINCT x) AS kx, count(DISTINCT y) AS ky FROM o GROUP BY ALL),
c AS (SELECT xs.feature, (coalesce(o.o, 0) - nx * ny / n) ^ 2 / (nx * ny / n) AS contrib,
             CAST((kx - 1) * (ky - 1) AS INTEGER) AS dof
      FROM xs JOIN ys USING (feature) JOIN t USING (feature) LEFT JOIN o ON o.feature = xs.feature AND o.x = xs.x
      AND o.y = ys.y),
s AS (SELECT feature, sum(contrib) AS chi2, min(dof) AS dof FROM c GROUP BY feature)
SELECT feature, round(chi2, 6) AS chi2, dof, CAST(row_number() OVER (ORDER BY chi2 DESC, feature) AS INTEGER) AS rank,
       CAST(row_number() OVER (ORDER BY chi2 DESC, feature) <= {k} AS INTEGER) AS selected FROM s"""


@register("chi_square_select", _chi_sql(2))
def q_chi(spark, sf):
    return _r(S.chi_square_select(_chi_source(spark, sf), CHI_FEATS, "l_returnflag", k=2), ["chi2"])


def _rank_sql(score_sql, name):
    return (f"(SELECT CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS rank, feature AS {name} "
            f"FROM ({score_sql}) q)")


_CORR_SCORE = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, {TARGET})), 9) AS score FROM lineitem"
                                 for c in FEATS)
_VAR_SCORE = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_samp({c}), 9) AS score FROM lineitem"
                                for c in FEATS)


@register("rank_align", f"""
SELECT a.rank, a.correlation, b.variance FROM {_rank_sql(_CORR_SCORE, 'correlation')} a
FULL JOIN {_rank_sql(_VAR_SCORE, 'variance')} b ON a.rank = b.rank WHERE a.rank <= 3""")
def q_rank_align(spark, sf):
    li = T(spark, sf, "lineitem")
    corr = S.select_by_correlation(li, FEATS, TARGET).select("feature", round_half_away("abs_corr", 9).alias("score"))
    var = S.variance_threshold(li, FEATS).select("feature", round_half_away("variance", 9).alias("score"))
    return S.rank_align({"correlation": corr, "variance": var}, n=3)


def _summary_sql():
    f_score = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr({c}, {TARGET}) * corr({c}, {TARGET}) / (1 - corr({c}, {TARGET}) * "
        f"corr({c}, {TARGET})) * (count({c}) - 2), 9) AS score FROM lineitem" for c in FEATS)
    mi = _mi_quantile_sql(FEATS, TARGET).replace("round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS mi",
                                         "round(sum(nxy / n * ln(nxy * n / (nx * ny))), 9) AS score")
    return f"""
SELECT c.rank, c.correlation, f.f_test, m.mutual_info, v.variance
FROM {_rank_sql(_CORR_SCORE, 'correlation')} c
FULL JOIN {_rank_sql(f_score, 'f_test')} f ON f.rank = c.rank
FULL JOIN {_rank_sql(mi, 'mutual_info')} m ON m.rank = c.rank
FULL JOIN {_rank_sql(_VAR_SCORE, 'variance')} v ON v.rank = c.rank"""


@register("selection_summary", _summary_sql())
def q_selection_summary(spark, sf):
    return S.selection_summary(T(spark, sf, "lineitem"), FEATS, TARGET, n=10, bins=10)


@register("model_importance", f"""WITH d AS (SELECT {", ".join(f"{c}::DOUBLE AS f_{j}" for j, c in enumerate(SMALL_FEATS))},
  {TARGET} AS label FROM lineitem),
{Q.tree_ctes("d", len(SMALL_FEATS), "label", 4, False)}
SELECT feature, round(importance, 5) AS importance FROM ({Q.importance_sql(SMALL_FEATS, ["t"], 4)})""")
def q_model_importance(spark, sf):
    """Importances of a fitted tree by name; the oracle grows the tree in SQL."""
    from pyspark.ml.feature import VectorAssembler
    li = VectorAssembler(inputCols=SMALL_FEATS, outputCol="features").transform(T(spark, sf, "lineitem").withColumnRenamed(TARGET, "label"))
    m = M.decision_tree_regressor(max_depth=4, max_bins=64).fit(li)
    return S.model_importance(m, SMALL_FEATS, spark).withColumn("importance", round_half_away("importance", 5))


@register("append_columns", """
SELECT o.*, s.n_orders, round(s.avg_price, 6) AS avg_price FROM orders o
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS avg_price FROM orders GROUP BY 1) s
USING (o_custkey)""")
def q_append(spark, sf):
    o = T(spark, sf, "orders")
    stats = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"),
                                       round_half_away(F.avg("o_totalprice"), 6).alias("avg_price"))
    return S.append_columns(o, stats, key=["o_custkey"])


# ------------------------------------------------------------------ L1-L4

LKEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@register("split_random", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN {sql_in_share(LKEY, 0.8, 'split')} THEN 'train' ELSE 'test' END AS split FROM lineitem""")
def q_split_random(spark, sf):
    return SP.split_random(T(spark, sf, "lineitem").select(*LKEY), LKEY, 0.8, salt="split")


@register("split_stratified", f"""
WITH h AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  {sql_hash_unit(['o_orderkey'], 'strat')} AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) - 1 AS rk,
             count(*) OVER (PARTITION BY o_orderpriority) AS n FROM h)
SELECT o_orderkey, o_orderpriority, CASE WHEN rk < floor(n * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS split FROM r""")
def q_split_stratified(spark, sf):
    """Priorities as strata, missing ones (by rule) being a stratum too."""
    o = T(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return SP.split_stratified(o, "o_orderpriority", ["o_orderkey"], 0.8, salt="strat")


@register("split_chronological", """
WITH mm AS (SELECT min(epoch(o_orderdate)) AS lo, max(epoch(o_orderdate)) AS hi FROM orders)
SELECT o_orderkey, CASE WHEN epoch(o_orderdate) <= lo + 0.8 * (hi - lo) THEN 'train' ELSE 'test' END AS split
FROM orders, mm""")
def q_split_chrono(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return SP.split_chronological(o, "o_orderdate", 0.8).select("o_orderkey", "split")


@register("kfold", f"SELECT o_orderkey, {sql_hash_bucket(['o_orderkey'], 5, 'fold')} AS fold FROM orders")
def q_kfold(spark, sf):
    return SP.kfold(T(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 5)


# ------------------------------------------------------------------ V1-V4

_PRED_CLASS = "CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END"


@register("eval_multiclass", f"""
WITH cm AS (SELECT l_returnflag AS y, {_PRED_CLASS} AS p, count(*) AS n FROM lineitem GROUP BY 1, 2),
a AS (SELECT y AS c, sum(n) AS support FROM cm GROUP BY 1),
pr AS (SELECT p AS c, sum(n) AS predicted FROM cm GROUP BY 1),
tp AS (SELECT y AS c, n AS tp FROM cm WHERE y = p),
per AS (SELECT coalesce(a.c, pr.c) AS c, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted,
               coalesce(tp, 0) AS tp FROM a FULL JOIN pr ON a.c = pr.c LEFT JOIN tp ON tp.c = coalesce(a.c, pr.c)),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pre,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM per)
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0.0 END * support) / sum(support), 6)
         AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM m""")
def q_eval_multiclass(spark, sf):
    li = T(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("label"),
        F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R").alias("prediction"))
    return _r(EV.eval_multiclass(li), ["accuracy", "weighted_f1"])


def _auc_sql(score):
    return f"""
WITH d AS (SELECT {score} AS s, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE AS pos,
                  sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END)::DOUBLE AS neg FROM lineitem GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM d)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos,
       CAST(sum(neg) AS BIGINT) AS n_neg FROM c"""


@register("eval_auc", _auc_sql("l_discount"))
def q_eval_auc(spark, sf):
    li = T(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                                         F.col("l_discount").alias("score"))
    return _r(EV.eval_auc(li), ["auc"])


@register("eval_auc_continuous", _auc_sql("l_extendedprice"))
def q_eval_auc_cont(spark, sf):
    """Exact AUC on a score with ~all-distinct values (range-partitioned running sums)."""
    li = T(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                                         F.col("l_extendedprice").alias("score"))
    return _r(EV.eval_auc(li), ["auc"])


@register("eval_regression", """
SELECT round(sqrt(avg((l_extendedprice - l_quantity * 950) ^ 2)), 6) AS rmse,
       round(avg(abs(l_extendedprice - l_quantity * 950)), 6) AS mae,
       round(1 - sum((l_extendedprice - l_quantity * 950) ^ 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2,
       count(*) AS n FROM lineitem""")
def q_eval_regression(spark, sf):
    li = T(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("label"),
                                         (F.col("l_quantity") * 950).alias("prediction"))
    return _r(EV.eval_regression(li), ["rmse", "mae", "r2"])


@register("eval_smape", """
SELECT event_type, round(avg(CASE WHEN abs(value) + 10.0 = 0 THEN 0.0
  ELSE 2 * abs(value - 10.0) / (abs(value) + 10.0) END), 6) AS smape, count(*) AS n FROM events GROUP BY 1""")
def q_eval_smape(spark, sf):
    e = T(spark, sf, "events").select("event_type", F.col("value").alias("label"), F.lit(10.0).alias("prediction"))
    return _r(EV.eval_smape(e, group="event_type"), ["smape"])


@register("top_features", f"""
SELECT feature, score FROM ({_CORR_SCORE}) s ORDER BY score DESC, feature LIMIT 3""")
def q_top_features(spark, sf):
    """T4: the three features most correlated (in absolute value) with the price."""
    from tablesmith.operators.profile import top_features
    scores = S.select_by_correlation(T(spark, sf, "lineitem"), FEATS, TARGET).select(
        "feature", round_half_away("abs_corr", 9).alias("score"))
    return top_features(scores, n=3)
