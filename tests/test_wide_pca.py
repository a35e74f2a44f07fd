"""Wide components against the exact ones."""

import numpy as np
import pytest
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import SMALL
from tablesmith.operators import features as FE
from tablesmith.plans import wide_pca as W


def exact(x):
    c = np.cov(x, rowvar=False)
    value, vector = np.linalg.eigh(c)
    order = np.argsort(-value)
    vector = vector[:, order]
    return value[order], vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(len(value))]), np.trace(c)


def test_equals_exact_components(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((800, 30)) @ np.diag(0.6 ** np.arange(30)) @ rng.standard_normal((30, 30)) + 0.5
    x[rng.random(x.shape) < 0.01] = 0.0
    df = spark.createDataFrame([(i, Vectors.dense(r) if i % 2 else Vectors.sparse(30, np.flatnonzero(r), r[r != 0])) for i, r in enumerate(x)] + [(-1, None)],
                               ["id", "v"])
    got = W.pca_wide(df, "v", 4, passes=12)
    value, vector, total = exact(x)
    assert got.rows == 800 and got.variances == pytest.approx(value[:4], rel=1e-6) and got.explained == pytest.approx(value[:4] / total, rel=1e-6)
    assert np.allclose(np.abs(got.loadings), np.abs(vector[:, :4]), atol=1e-3)
    rows = {r.id: r.pca for r in W.project(df, "v", got).collect()}
    assert rows[-1] is None and np.allclose([rows[i] for i in range(800)], (x - x.mean(axis=0)) @ got.loadings, atol=1e-9)


def test_leading_variances_on_lineitem(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet").select(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    v = VectorAssembler(inputCols=li.columns, outputCol="v").transform(li)
    got = W.pca_wide(v, "v", 3)
    _, _, model = FE.pca(v, "v", 3)
    assert got.explained == pytest.approx(model.explainedVariance.toArray(), abs=1e-6)


def test_twenty_thousand_columns(spark):
    """A one-hot column with a few frequent categories: its largest variances are near p (1 - p)."""
    n, d = 30_000, 20_000
    rows = spark.range(n).select(F.when(F.col("id") % 4 == 0, F.lit(0)).when(F.col("id") % 4 == 1, F.lit(1))
                                 .otherwise(F.pmod(F.xxhash64("id"), F.lit(d - 2)) + 2).cast("double").alias("c"))
    rows = rows.unionByName(spark.range(1).select(F.lit(float(d - 1)).alias("c")))
    v = OneHotEncoder(inputCols=["c"], outputCols=["v"], dropLast=False).fit(rows).transform(rows)
    got = W.pca_wide(v, "v", 2, oversample=4, passes=4)
    assert got.loadings.shape == (d, 2)
    assert got.variances == pytest.approx([0.25, 0.125], rel=0.02)  # of two indicators with p = 1/4: difference and sum
    assert set(np.abs(got.loadings).argmax(axis=0)) <= {0, 1}


def test_one_column_and_no_rows(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0]),), (Vectors.dense([3.0]),)], ["v"])
    got = W.pca_wide(df, "v", 1)
    assert got.variances.tolist() == [2.0] and got.loadings.tolist() == [[1.0]]
    with pytest.raises(ValueError):
        W.pca_wide(df.limit(0), "v", 1)
