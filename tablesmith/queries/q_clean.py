"""Queries: projections, filters, cleaning (P1-P20) and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions.columns import round_half_away

from tablesmith.operators import clean
from tablesmith.queries import register
from tablesmith.queries.common import T

# test values: segment scores of the ordinal map (P9), default 0
SEGMENT_SCORE = {"MACHINERY": 10, "HOUSEHOLD": 7, "AUTOMOBILE": 6}


@register("select_cols", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
def q_select(spark, sf):
    return clean.select_cols(T(spark, sf, "lineitem"), ["l_orderkey", "l_quantity", "l_returnflag"])


@register("drop_cols", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def q_drop(spark, sf):
    return clean.drop_cols(T(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("rename_clean", """
SELECT c_custkey AS customer_key, c_name AS customer_name, c_nationkey, c_acctbal AS account_balance,
       c_mktsegment AS market_segment FROM customer""")
def q_rename(spark, sf):
    c = T(spark, sf, "customer").toDF("c_custkey", "customer  name", "c_nationkey", "account balance",
                                      " market segment")
    return clean.rename_clean(c, {"c_custkey": "customer key"})


@register("ratio_features", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(l_extendedprice / nullif(l_quantity, 0), 6) AS price_per_qty,
       round(l_tax / nullif(l_discount, 0), 6) AS tax_per_discount,
       round(l_extendedprice * l_discount, 6) AS discount_amount
FROM lineitem""")
def q_ratio(spark, sf):
    li = T(spark, sf, "lineitem")
    out = clean.ratio_features(li, ratios={"price_per_qty": ("l_extendedprice", "l_quantity"),
                                           "tax_per_discount": ("l_tax", "l_discount")},
                               products={"discount_amount": ("l_extendedprice", "l_discount")})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      *[round_half_away(c, 6).alias(c) for c in ("price_per_qty", "tax_per_discount", "discount_amount")])


@register("smoothed_ratio", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_tax / (l_discount + 1e-6), 6) AS tax_ratio
FROM lineitem""")
def q_smoothed(spark, sf):
    out = clean.smoothed_ratio(T(spark, sf, "lineitem"), "tax_ratio", "l_tax", "l_discount", 1e-6)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", round_half_away("tax_ratio", 6).alias("tax_ratio"))


@register("scaled_ratio", """
SELECT o_orderkey, round(o_totalprice / nullif(o_totalprice / 100000.0, 0) , 6) AS same_scale,
       round(o_totalprice / (nullif(o_custkey, 0) / 100000.0), 6) AS price_per_100k_key
FROM orders""")
def q_scaled(spark, sf):
    o = T(spark, sf, "orders")
    o = clean.scaled_ratio(o, "same_scale", "o_totalprice", "o_totalprice", 100000.0)
    o = clean.scaled_ratio(o, "price_per_100k_key", "o_totalprice", "o_custkey", 100000.0)
    return o.select("o_orderkey", round_half_away("same_scale", 6).alias("same_scale"),
                    round_half_away("price_per_100k_key", 6).alias("price_per_100k_key"))


@register("threshold_flag", """
SELECT o_orderkey, CAST(o_totalprice > 250000 AS INTEGER) AS high_value,
       CAST(o_totalprice <= 50000 AS INTEGER) AS low_value FROM orders""")
def q_flag(spark, sf):
    o = clean.threshold_flag(T(spark, sf, "orders"), "high_value", "o_totalprice", ">", 250000)
    o = clean.threshold_flag(o, "low_value", "o_totalprice", "<=", 50000)
    return o.select("o_orderkey", "high_value", "low_value")


@register("case_bins", """
SELECT p_partkey, CASE WHEN p_size < 9 THEN 'S' WHEN p_size < 26 THEN 'M' ELSE 'L' END AS size_class,
  CASE WHEN p_retailprice >= 1400 THEN 'top' WHEN p_retailprice >= 1100 THEN 'upper' WHEN p_retailprice >= 950 THEN 'lower'
    ELSE 'base' END AS price_tier
FROM part""")
def q_case_bins(spark, sf):
    p = clean.case_bins(T(spark, sf, "part"), "size_class", "p_size", [9, 26], ["S", "M", "L"])
    p = clean.case_bins(p, "price_tier", "p_retailprice", [1400, 1100, 950], ["top", "upper", "lower", "base"],
                        descending=True)
    return p.select("p_partkey", "size_class", "price_tier")


@register("ordinal_map", """
SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 10 WHEN 'HOUSEHOLD' THEN 7 WHEN 'AUTOMOBILE' THEN 6
  ELSE 0 END AS segment_score FROM customer""")
def q_ordinal(spark, sf):
    c = clean.ordinal_map(T(spark, sf, "customer"), "segment_score", "c_mktsegment", SEGMENT_SCORE, default=0)
    return c.select("c_custkey", "segment_score")


@register("filter_range", """
SELECT * FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 40 AND l_discount >= 0.02 AND l_discount <= 0.08""")
def q_filter_range(spark, sf):
    return clean.filter_range(T(spark, sf, "lineitem"), {"l_quantity": (10, 40), "l_discount": (0.02, 0.08)})


def _with_sentinels(spark, sf):
    o = T(spark, sf, "orders")
    return o.withColumns({
        "o_orderstatus": F.when(F.col("o_orderkey") % 9 == 0, F.lit(" ?")).otherwise(F.col("o_orderstatus")),
        "o_orderpriority": F.when(F.col("o_orderkey") % 13 == 0, F.lit("?")).otherwise(F.col("o_orderpriority")),
    })


@register("sentinel_to_null", """
SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders""")
def q_sentinel(spark, sf):
    return clean.sentinel_to_null(_with_sentinels(spark, sf), sentinels=["?"])


SURVEY_COLS = [f"q{k}" for k in range(1, 6)]


def survey_answers(spark, sf):
    """Survey-like 0-6 answers derived from events (0 = not applicable, 6 = not used)."""
    e = T(spark, sf, "events")
    return e.select("event_id", "event_type",
                    *[F.pmod(F.col("event_id") * (2 * k + 1) + k, F.lit(7)).cast("int").alias(f"q{k}")
                      for k in range(1, 6)])


SURVEY_SQL = ("(SELECT event_id, event_type, "
              + ", ".join(f"CAST(((event_id * {2 * k + 1} + {k}) % 7) AS INTEGER) AS q{k}" for k in range(1, 6))
              + " FROM events)")


@register("recode_values", "SELECT event_id, "
          + ", ".join(f"CASE WHEN q{k} IN (0, 6) THEN 3 ELSE q{k} END AS q{k}" for k in range(1, 6))
          + f" FROM {SURVEY_SQL} s")
def q_recode(spark, sf):
    s = clean.recode_values(survey_answers(spark, sf), SURVEY_COLS, [0, 6], 3)
    return s.select("event_id", *SURVEY_COLS)


@register("strip_suffix", """
SELECT o_orderkey, o_orderstatus AS label FROM orders""")
def q_strip(spark, sf):
    o = T(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderstatus", F.lit(".")))
        .otherwise(F.col("o_orderstatus")).alias("label"))
    return clean.strip_suffix(o, "label", ".")


@register("normalise_strings", """
SELECT c_custkey, trim(c_name) AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       trim(CAST(c_acctbal AS VARCHAR)) AS c_acctbal_text FROM customer""")
def q_normalise(spark, sf):
    c = T(spark, sf, "customer").withColumn("c_acctbal_text", F.concat(F.lit("  "), F.col("c_acctbal").cast("string")))
    return clean.normalise_strings(c, ["c_name", "c_nationkey", "c_acctbal_text"]).select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal_text")


@register("drop_missing", """
SELECT * FROM (SELECT c_custkey, c_name, c_nationkey,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer) h
WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""")
def q_drop_missing(spark, sf):
    c = T(spark, sf, "customer").withColumns({
        "c_acctbal": F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("c_acctbal")),
        "c_mktsegment": F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))})
    return clean.drop_missing(c, ["c_acctbal", "c_mktsegment"])


@register("clip_lower", "SELECT c_custkey, greatest(c_acctbal, 0.0) AS c_acctbal FROM customer")
def q_clip(spark, sf):
    return clean.clip_lower(T(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 0.0)


@register("tag_source", "SELECT s_suppkey, s_acctbal, 'supplier' AS source FROM supplier")
def q_tag(spark, sf):
    return clean.tag_source(T(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "source", "supplier")


_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("columns_by_type", """
SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS "column",
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type,
  CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric'
       WHEN data_type = 'VARCHAR' THEN 'categorical' ELSE 'other' END AS kind, nn.non_null
FROM information_schema.columns JOIN (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, count({c}) AS non_null FROM lineitem" for c in _LI_COLS) + """) nn ON nn.c = column_name
WHERE table_name = 'lineitem'""")
def q_columns_by_type(spark, sf):
    return clean.columns_by_type_frame(T(spark, sf, "lineitem"))


@register("parse_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders")
def q_parse_date(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))
    return clean.parse_date(o, "order_date", fmt="yyyy-MM-dd")


@register("drop_duplicates", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def q_dedup(spark, sf):
    return clean.drop_duplicates(T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@register("duplicate_count", """
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST((SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT) AS n_distinct,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT)
         AS n_duplicates
FROM lineitem""")
def q_dup_count(spark, sf):
    return clean.duplicate_report(T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@register("union_tagged", """
SELECT c_custkey AS id, c_acctbal AS acctbal, c_nationkey AS nationkey, 'customer' AS source FROM customer
UNION ALL
SELECT s_suppkey AS id, s_acctbal AS acctbal, s_nationkey AS nationkey, 'supplier' AS source FROM supplier""")
def q_union(spark, sf):
    c = T(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"),
                                        F.col("c_nationkey").alias("nationkey"))
    s = T(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"),
                                        F.col("s_nationkey").alias("nationkey"))
    return clean.union_tagged({"customer": c, "supplier": s}, "source")
