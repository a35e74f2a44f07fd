"""Queries: feature transformers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablesmith.functions.columns import round_half_away, sql_hash_unit
from tablesmith.functions.text import ENGLISH_STOP_WORDS
from tablesmith.operators import features as FE
from tablesmith.queries import register
from tablesmith.queries import sql_models as Q
from tablesmith.queries.common import LINEITEM_NUM, T

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@register("bucketize", """
SELECT p_partkey, CASE WHEN p_retailprice < 925 THEN 0.0 WHEN p_retailprice < 950 THEN 1.0
  WHEN p_retailprice < 975 THEN 2.0 ELSE 3.0 END AS price_bucket FROM part""")
def q_bucketize(spark, sf):
    p = FE.bucketize(T(spark, sf, "part"), "p_retailprice", [900.0, 925.0, 950.0, 975.0, float("inf")],
                     "price_bucket")
    return p.select("p_partkey", "price_bucket")


@register("cut_labels", """
SELECT o_orderkey,
  CASE WHEN o_totalprice > 0 AND o_totalprice <= 100000 THEN 'low'
       WHEN o_totalprice > 100000 AND o_totalprice <= 200000 THEN 'mid'
       WHEN o_totalprice > 200000 AND o_totalprice <= 300000 THEN 'high'
       WHEN o_totalprice > 300000 AND o_totalprice <= 400000 THEN 'top' END AS price_band,
  CASE WHEN o_totalprice >= 0 AND o_totalprice < 150000 THEN 0
       WHEN o_totalprice >= 150000 AND o_totalprice <= 450000 THEN 1 END AS price_half
FROM orders""")
def q_cut(spark, sf):
    o = FE.cut_labels(T(spark, sf, "orders"), "o_totalprice", [0, 100000, 200000, 300000, 400000],
                      ["low", "mid", "high", "top"], "price_band", closed="right")
    o = FE.cut_labels(o, "o_totalprice", [0, 150000, 450000], None, "price_half", closed="left",
                      include_lowest=True)
    return o.select("o_orderkey", "price_band", "price_half")


@register("quantile_bins", """
WITH e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM orders)
SELECT o_orderkey,
  CASE WHEN o_totalprice >= q[1] AND o_totalprice <= q[2] THEN 'q1'
       WHEN o_totalprice > q[2] AND o_totalprice <= q[3] THEN 'q2'
       WHEN o_totalprice > q[3] AND o_totalprice <= q[4] THEN 'q3'
       WHEN o_totalprice > q[4] AND o_totalprice <= q[5] THEN 'q4'
       WHEN o_totalprice > q[5] AND o_totalprice <= q[6] THEN 'q5' END AS price_quintile
FROM orders, e""")
def q_quantile_bins(spark, sf):
    o = FE.quantile_bins(T(spark, sf, "orders"), "o_totalprice", 5, "price_quintile",
                         labels=["q1", "q2", "q3", "q4", "q5"])
    return o.select("o_orderkey", "price_quintile")


@register("date_features", """
SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
  CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS o_orderdate_dayofweek,
  CAST(dayofweek(o_orderdate) IN (0, 6) AS INTEGER) AS o_orderdate_is_weekend,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS o_orderdate_days_since,
  CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Spring'
       WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS o_orderdate_season
FROM orders""")
def q_date_features(spark, sf):
    o = FE.date_features(T(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "2002-01-01")
    return o.drop("o_orderdate")


@register("synthetic_date", f"""
SELECT c_custkey, CAST(DATE '2024-01-01' - CAST({sql_hash_unit(['c_custkey'], 'listing')} % 1825 AS INTEGER) AS DATE)
  AS listing_date FROM customer""")
def q_synthetic_date(spark, sf):
    c = FE.synthetic_date(T(spark, sf, "customer"), ["c_custkey"], "listing_date", "2024-01-01", salt="listing")
    return c.select("c_custkey", "listing_date")


@register("tokenize", r"""
SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS words FROM documents""")
def q_tokenize(spark, sf):
    return FE.tokenize(T(spark, sf, "documents"), "text").select("doc_id", "words")


_TOKENS_SQL = r"""(SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))
  AS term FROM documents)"""


@register("count_vectorize", f"""
WITH t AS {_TOKENS_SQL},
v AS (SELECT term, CAST(row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS INTEGER) AS term_index
      FROM t GROUP BY term ORDER BY count(*) DESC, term LIMIT 30)
SELECT doc_id, term_index, term, count(*) AS n FROM t JOIN v USING (term) GROUP BY doc_id, term_index, term""")
def q_count_vectorize(spark, sf):
    counts, _ = FE.count_vectorize(T(spark, sf, "documents"), "doc_id", "text", vocab_size=30)
    return counts


_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"
_WORDS_SQL = rf"""(SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'),
  lambda x: NOT list_contains({_STOP_SQL}, x))) AS term FROM documents)"""


@register("count_vectorize_wide", f"""
WITH t AS {_WORDS_SQL},
tf AS (SELECT term, doc_id, count(*) AS n FROM t GROUP BY term, doc_id),
v AS (SELECT term FROM tf GROUP BY term HAVING count(*) >= 5 ORDER BY sum(n) DESC, term LIMIT 30)
SELECT d.doc_id, 'cv_' || v.term AS feature, CAST(coalesce(tf.n, 0) AS BIGINT) AS n
FROM documents d CROSS JOIN v LEFT JOIN tf ON tf.doc_id = d.doc_id AND tf.term = v.term""")
def q_count_vectorize_wide(spark, sf):
    wide = FE.count_vectorize_wide(T(spark, sf, "documents"), "doc_id", "text", max_features=30, min_df=5)
    feats = [c for c in wide.columns if c.startswith("cv_")]
    return wide.unpivot(["doc_id"], feats, "feature", "n")


@register("string_index", """
WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1),
i AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY n DESC, c_mktsegment) - 1 AS DOUBLE) AS segment_index
      FROM c)
SELECT c_custkey, segment_index FROM customer JOIN i USING (c_mktsegment)""")
def q_string_index(spark, sf):
    out, _ = FE.string_index(T(spark, sf, "customer"), "c_mktsegment", "segment_index")
    return out.select("c_custkey", "segment_index")


@register("one_hot_vector", """
WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1),
i AS (SELECT p_type, row_number() OVER (ORDER BY n DESC, p_type) - 1 AS idx FROM c),
k AS (SELECT count(*) AS k FROM c)
SELECT p_partkey, list_transform(range(k.k - 1), lambda j: CASE WHEN j = idx THEN 1.0 ELSE 0.0 END) AS type_ohe
FROM part JOIN i USING (p_type), k""")
def q_one_hot_vector(spark, sf):
    out, _ = FE.string_index(T(spark, sf, "part"), "p_type", "type_index")
    return FE.one_hot_vector(out, "type_index", "type_ohe").select("p_partkey", "type_ohe")


@register("one_hot_wide", """
SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS c_mktsegment_BUILDING,
  CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS c_mktsegment_FURNITURE,
  CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS c_mktsegment_HOUSEHOLD,
  CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS c_mktsegment_MACHINERY FROM customer""")
def q_one_hot_wide(spark, sf):
    return FE.one_hot_wide(T(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment") \
        .drop("c_mktsegment")


@register("assemble_vector", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  [l_quantity, l_extendedprice, l_discount, l_tax] AS features
FROM lineitem WHERE nullif(l_discount, 0.0) IS NOT NULL""")
def q_assemble(spark, sf):
    li = T(spark, sf, "lineitem").withColumn(
        "l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    out = FE.assemble_vector(li, LINEITEM_NUM, "features", "skip")
    return out.select(*LI_KEY, vector_to_array("features").alias("features"))


@register("scale_standard", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem), 6) AS {c}_std"
    for c in LINEITEM_NUM) + " FROM lineitem")
def q_scale_standard(spark, sf):
    out = FE.scale_standard_wide(T(spark, sf, "lineitem"), LINEITEM_NUM)
    return out.select(*LI_KEY, *[round_half_away(f"{c}_std", 6).alias(f"{c}_std") for c in LINEITEM_NUM])


@register("scale_minmax", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"round(({c} - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) FROM lineitem) - "
    f"(SELECT min({c}) FROM lineitem)), 6) AS {c}_minmax" for c in LINEITEM_NUM) + " FROM lineitem")
def q_scale_minmax(spark, sf):
    out = FE.scale_minmax_wide(T(spark, sf, "lineitem"), LINEITEM_NUM)
    return out.select(*LI_KEY, *[round_half_away(f"{c}_minmax", 6).alias(f"{c}_minmax") for c in LINEITEM_NUM])


@register("vector_to_columns", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
          + ", ".join(f"{c} AS v_{c}" for c in LINEITEM_NUM) + " FROM lineitem")
def q_vector_to_columns(spark, sf):
    v = FE.assemble_vector(T(spark, sf, "lineitem"), LINEITEM_NUM, "features")
    return FE.vector_to_columns(v, "features", [f"v_{c}" for c in LINEITEM_NUM]).select(
        *LI_KEY, *[f"v_{c}" for c in LINEITEM_NUM])


@register("vector_size", """
SELECT p_partkey, CAST((SELECT count(DISTINCT p_type) FROM part) - 1 + 2 AS INTEGER) AS n_features FROM part""")
def q_vector_size(spark, sf):
    p, _ = FE.string_index(T(spark, sf, "part"), "p_type", "type_index")
    p = FE.one_hot_vector(p, "type_index", "type_ohe", as_array=False)
    p = FE.assemble_vector(p, ["type_ohe", "p_size", "p_retailprice"], "features")
    return FE.vector_size(p, "features").select("p_partkey", "n_features")


def _scaled_lineitem(spark, sf):
    v = FE.assemble_vector(T(spark, sf, "lineitem"), LINEITEM_NUM, "raw")
    return FE.scale_vector(v, "raw", "features", "standard")[0]


_CORR_SQL = "cm AS MATERIALIZED (SELECT " + ", ".join(
    f"corr({a}, {b}) AS m_{i}_{j}" if i != j else f"1.0::DOUBLE AS m_{i}_{j}"
    for i, a in enumerate(LINEITEM_NUM) for j, b in enumerate(LINEITEM_NUM) if i <= j) + " FROM lineitem)"
_Z_SQL = "z AS (SELECT *, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z_{i}" for i, c in enumerate(LINEITEM_NUM)) + " FROM lineitem)"
_COMPONENTS_SQL = f"""WITH {_CORR_SQL},
{Q.eigen_ctes(4, "cm", 2)},
{_Z_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [{", ".join(
    "round(" + " + ".join(f"v_{c}_{i} * z_{i}" for i in range(4)) + ", 3)" for c in range(2))}] AS components FROM z, ev"""


@register("pca", _COMPONENTS_SQL)
def q_pca(spark, sf):
    """Two components of the scaled lineitem measures for every row; the oracle finds the correlation matrix's vectors by squaring it."""
    res, _, _ = FE.pca(_scaled_lineitem(spark, sf), "features", 2)
    return res.select(*LI_KEY, F.transform("pca", lambda x: round_half_away(x, 3)).alias("components"))


@register("pca_wide", _COMPONENTS_SQL)
def q_pca_wide(spark, sf):
    """The same components by the randomised range finder for wide vectors."""
    from tablesmith.plans import wide_pca as W
    v = _scaled_lineitem(spark, sf)
    res = W.project(v, "features", W.pca_wide(v, "features", 2))
    return res.select(*LI_KEY, F.transform("pca", lambda x: round_half_away(x, 3)).alias("components"))


@register("pca_variance", f"""WITH {_CORR_SQL},
{Q.eigen_ctes(4, "cm", 4)},
s AS ({" UNION ALL ".join(f"SELECT {c + 1} AS component, value_{c} / 4 AS explained FROM ev" for c in range(4))}),
t AS (SELECT *, sum(explained) OVER (ORDER BY component) AS cumulative FROM s)
SELECT component, round(explained, 6) AS explained, round(cumulative, 6) AS cumulative,
  (SELECT min(component) FROM t WHERE cumulative >= 0.9) AS k_for_threshold FROM t""")
def q_pca_variance(spark, sf):
    """Variance shares of all four components, and how many reach nine tenths."""
    _, _, m = FE.pca(_scaled_lineitem(spark, sf), "features", 4)
    return FE.pca_variance(m, 0.9, spark).withColumns({c: round_half_away(c, 6) for c in ("explained", "cumulative")})


_DENSE = "(dense_rank() OVER (ORDER BY {0}) - 1)::DOUBLE"


@register("vector_index", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  [{_DENSE.format("l_linenumber")}, l_quantity, {_DENSE.format("l_discount")}, {_DENSE.format("l_tax")}, l_extendedprice] AS indexed
FROM lineitem""")
def q_vector_index(spark, sf):
    v = FE.assemble_vector(T(spark, sf, "lineitem"), ["l_linenumber", "l_quantity", "l_discount", "l_tax",
                                                      "l_extendedprice"], "raw")
    res, _ = FE.vector_index(v, "raw", "indexed", 25)
    return res.select(*LI_KEY, vector_to_array("indexed").alias("indexed"))


_SCALED = "round(({0} - avg({0}) OVER ()) / stddev_samp({0}) OVER (), 6)"
_HOT = "CAST(CAST({0} = {1} AS INTEGER) AS DOUBLE)"


@register("feature_pipeline", f"""
WITH a AS (SELECT *, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS d, l_extendedprice / l_quantity AS ratio FROM lineitem),
m AS (SELECT quantile_disc(d, 0.5) AS m FROM a),
f AS (SELECT l_returnflag, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS fi FROM lineitem GROUP BY 1),
s AS (SELECT l_linestatus, row_number() OVER (ORDER BY count(*) DESC, l_linestatus) - 1 AS si FROM lineitem GROUP BY 1),
b AS (SELECT a.*, coalesce(d, m) AS di, fi, si FROM a JOIN f USING (l_returnflag) JOIN s USING (l_linestatus), m)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [{", ".join(
    [_SCALED.format(c) for c in ("l_quantity", "l_extendedprice", "di", "l_tax", "ratio")]
    + [_HOT.format("fi", k) for k in range(4)] + [_HOT.format("si", k) for k in range(3)])}] AS features FROM b""")
def q_feature_pipeline(spark, sf):
    li = T(spark, sf, "lineitem").withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    pipe = FE.feature_pipeline(["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                               ["l_returnflag", "l_linestatus"], impute=["l_discount"],
                               derived={"price_per_qty": ("l_extendedprice", "l_quantity")})
    out = pipe.fit(li).transform(li)
    return out.select(*LI_KEY, F.transform(vector_to_array("features"), lambda x: round_half_away(x, 6)).alias("features"))


_NAMES = """SELECT {n} + row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS position, '{c}_' || {c} AS name FROM part GROUP BY {c}
UNION ALL SELECT {n} + count(DISTINCT {c}), '{c}___unknown' FROM part"""


@register("column_transformer", f"""
SELECT 0::BIGINT AS position, 'p_size' AS name UNION ALL SELECT 1, 'p_retailprice' UNION ALL {_NAMES.format(n=2, c="p_type")}
UNION ALL {_NAMES.format(n="3 + (SELECT count(DISTINCT p_type) FROM part)", c="p_brand")}""")
def q_column_transformer(spark, sf):
    """Feature names after scaling and one-hot, as (position, name)."""
    p = T(spark, sf, "part")
    _, _, names = FE.column_transformer(p, ["p_size", "p_retailprice"], ["p_type", "p_brand"])
    return spark.createDataFrame(list(enumerate(names)), "position long, name string")


@register("scale_vector", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [" + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem), 6)"
    for c in LINEITEM_NUM) + "] AS features FROM lineitem")
def q_scale_vector(spark, sf):
    """E13 on a vector with Spark's StandardScaler (mean 0, sample sd 1)."""
    v = FE.assemble_vector(T(spark, sf, "lineitem"), LINEITEM_NUM, "raw")
    out, _ = FE.scale_vector(v, "raw", "scaled", "standard")
    return out.select(*LI_KEY, F.transform(vector_to_array("scaled"), lambda x: round_half_away(x, 6))
                      .alias("features"))


@register("quantile_discretize", """SELECT i::DOUBLE AS price_bucket, 1 AS about_a_fifth
FROM range(5) r(i) WHERE (SELECT count(*) FROM orders) > 0""")
def q_quantile_discretize(spark, sf):
    """E3, scale variant: Spark's QuantileDiscretizer (sketch edges): five buckets of about a fifth each."""
    d = FE.quantile_discretize(T(spark, sf, "orders"), "o_totalprice", 5, "price_bucket")
    n = F.count(F.lit(1))
    sizes = d.groupBy("price_bucket").agg(n.alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # five rows
    return sizes.select("price_bucket", share.between(0.18, 0.22).cast("int").alias("about_a_fifth"))
