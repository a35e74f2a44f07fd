"""Queries: sources and sinks.

Files are written by Spark from the given tables into a fresh folder under
the shared checkpoint folder, then read back through the operator under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tablesmith.functions.columns import sql_hash_unit
from tablesmith.sources import files as S
from tablesmith.queries import register
from tablesmith.queries.common import T, scratch_path


def _csv(df, path, header=True, sep=","):
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)
    return path


@register("read_csv_infer", """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_read_csv_infer(spark, sf):
    p = _csv(T(spark, sf, "customer"), scratch_path(spark, "csv-infer"))
    return S.read_csv_infer(spark, p)


ORDERS_SCHEMA = StructType([StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()),
                            StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType()),
                            StructField("o_orderpriority", StringType())])


@register("read_csv_schema",
          "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def q_read_csv_schema(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    p = _csv(o, scratch_path(spark, "csv-schema"), header=False, sep=", ")
    return S.read_csv_schema(spark, p, ORDERS_SCHEMA, delimiter=", ")


@register("read_csv_positional", """
SELECT CAST(s_suppkey AS INTEGER) AS supplier_id, s_name AS supplier_name, s_nationkey AS nation,
       s_acctbal AS balance FROM supplier""")
def q_read_csv_positional(spark, sf):
    p = _csv(T(spark, sf, "supplier"), scratch_path(spark, "csv-pos"), header=False)
    return S.read_csv_positional(spark, p, ["supplier_id", "supplier_name", "nation", "balance"])


@register("read_csv_sep", """
SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part""")
def q_read_csv_sep(spark, sf):
    p = _csv(T(spark, sf, "part"), scratch_path(spark, "csv-sep"), sep=";")
    return S.read_csv_sep(spark, p, ";")


PART_SCHEMA = StructType([StructField("p_partkey", LongType()), StructField("p_brand", StringType()),
                          StructField("p_size", IntegerType()), StructField("p_retailprice", DoubleType())])


@register("read_csv_trim_dropna", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_size <= 45")
def q_read_csv_trim(spark, sf):
    """Fields written with a leading blank; sizes above 45 are written as an unparseable "n/a"."""
    p = T(spark, sf, "part")
    raw = p.select(F.col("p_partkey").cast("string"), F.concat(F.lit(" "), "p_brand").alias("p_brand"),
                   F.when(F.col("p_size") > 45, F.lit(" n/a"))
                   .otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("p_size"),
                   F.concat(F.lit(" "), F.col("p_retailprice").cast("string")).alias("p_retailprice"))
    path = _csv(raw, scratch_path(spark, "csv-trim"), header=False)
    return S.read_csv_trim_dropna(spark, path, schema=PART_SCHEMA)


@register("read_libsvm", "SELECT CAST(label AS DOUBLE) AS label, CAST(embedding AS DOUBLE[]) AS features FROM embeddings")
def q_read_libsvm(spark, sf):
    """embeddings written as libsvm (label, 64 features) and read back."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    e = T(spark, sf, "embeddings").select(F.col("label").cast("double").alias("label"),
                                         array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    path = scratch_path(spark, "libsvm")
    S.write_libsvm(e, path)
    back = S.read_libsvm(spark, path, num_features=64)
    return back.select("label", vector_to_array("features").alias("features"))


def _view_name(base):
    return f"{base}_{uuid.uuid4().hex[:8]}"


@register("read_table", "SELECT * FROM nation")
def q_read_table(spark, sf):
    """A catalog table over the given file, read by its name."""
    name = _view_name("nation_table")
    spark.catalog.createTable(name, path=f"{sf}/nation.parquet", source="parquet")
    return S.read_table(spark, name)


@register("read_with_fallback", "SELECT * FROM region")
def q_read_fallback(spark, sf):
    return S.read_with_fallback(spark, _view_name("missing_region"), f"{sf}/region.parquet", "parquet")


@register("write_table_overwrite", "SELECT * FROM supplier")
def q_write_overwrite(spark, sf):
    name = _view_name("supplier_copy")
    path = scratch_path(spark, name)
    S.write_table_overwrite(T(spark, sf, "nation"), name, path=path)
    S.write_table_overwrite(T(spark, sf, "supplier"), name, path=path)
    return spark.table(name)


@register("write_table_append", "SELECT * FROM nation UNION ALL SELECT * FROM nation")
def q_write_append(spark, sf):
    name = _view_name("nation_log")
    path = scratch_path(spark, name)
    S.write_table_append(T(spark, sf, "nation"), name, path=path)
    S.write_table_append(T(spark, sf, "nation"), name, path=path)
    return spark.table(name)


# fixed values: region weights of the literal lookup table
REGION_WEIGHT = [(0, 1.0), (1, 1.5), (2, 2.0), (3, 2.5), (4, 3.0)]


@register("literal_table", """
SELECT n_nationkey, n_name, w.weight FROM nation
JOIN (VALUES (0, 1.0), (1, 1.5), (2, 2.0), (3, 2.5), (4, 3.0)) w(r, weight) ON n_regionkey = w.r""")
def q_literal(spark, sf):
    lit = S.literal_table(spark, REGION_WEIGHT, "r int, weight double")
    n = T(spark, sf, "nation")
    return n.join(F.broadcast(lit), n.n_regionkey == lit.r).select("n_nationkey", "n_name", "weight")


@register("save_load_model", "SELECT l_orderkey, l_linenumber, 1 AS same FROM lineitem")
def q_save_load(spark, sf):
    """Fit, save, reload and score: the reloaded model predicts what the fitted one did."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    li = T(spark, sf, "lineitem")
    m = Pipeline(stages=[VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features"),
                         LinearRegression(labelCol="l_extendedprice")]).fit(li)
    path = scratch_path(spark, "model")
    S.save_model(m, path)
    back = S.load_model(path).transform(m.transform(li).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.col("prediction").alias("before")))
    return back.select("l_orderkey", "l_linenumber", (F.col("prediction") == F.col("before")).cast("int").alias("same"))


@register("sample_rows", f"""
SELECT * FROM lineitem WHERE {sql_hash_unit(['l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey'], '42')}
  < {int(round(0.1 * (1 << 32)))}""")
def q_sample(spark, sf):
    """10 % hash sample: the same rows on any layout (the feature is the sample)."""
    return S.sample_rows(T(spark, sf, "lineitem"), 0.1, seed=42,
                         key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
