"""Source / sink branches not covered by the oracle queries."""

import uuid

from pyspark.sql import functions as F

from conftest import SMALL
from tablesmith.queries.common import T
from tablesmith.sources import files as S
from tablesmith.streaming import score as SC


def test_read_with_fallback_prefers_the_table(spark):
    name = f"region_{uuid.uuid4().hex[:8]}"
    T(spark, SMALL, "nation").createOrReplaceTempView(name)
    got = S.read_with_fallback(spark, name, f"{SMALL}/region.parquet")
    assert got.count() == 25            # the table (nation), not the file (region)


def test_linear_expression_equals_pandas_udf(spark):
    li = T(spark, SMALL, "lineitem")
    a, b = 12.5, 3.25
    udf = SC.udf_score(li, lambda p: a + b * p["l_quantity"], ["l_quantity"]).select("prediction")
    expr = li.select(SC.linear_score({"l_quantity": b}, a).alias("prediction"))
    assert sorted(r[0] for r in udf.collect()) == sorted(r[0] for r in expr.collect())


def test_hash_sample_is_layout_free(spark):
    li = T(spark, SMALL, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a = S.sample_rows(li.repartition(1), 0.2, key=key).select(*key).collect()
    b = S.sample_rows(li.repartition(5), 0.2, key=key).select(*key).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and 0 < len(a) < li.count()


def test_csv_positional_names(spark):
    from tablesmith.queries.common import scratch_path
    p = scratch_path(spark, "pos")
    T(spark, SMALL, "region").write.option("header", False).csv(p)
    df = S.read_csv_positional(spark, p, ["rid", "rname"])
    assert df.columns == ["rid", "rname"] and df.where(F.col("rname").isNull()).count() == 0
