"""Kernel maps against the kernels, and what a linear machine cannot separate."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.operators import kernels as K
from tablesmith.operators import models as M


def frame(spark, x, label=None):
    rows = [(*map(float, r), float(label[i]) if label is not None else 0.0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(f"`x {i}` double" for i in range(len(x[0]))) + ", label double")


def mapped(spark, x, **kw):
    cols = [f"x {i}" for i in range(x.shape[1])]
    return np.array([r.features.toArray() for r in K.KernelMap(cols, **kw).transform(frame(spark, x)).select("features").collect()])


def test_fourier_features_follow_the_rbf_kernel(spark):
    x = np.random.default_rng(1).standard_normal((40, 3))
    exact = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    error = {n: np.abs((z := mapped(spark, x, kind="rbf", n=n, gamma=0.7)) @ z.T - exact) for n in (50, 1500)}
    assert error[1500].max() < 6 / math.sqrt(1500) and error[1500].mean() < 0.5 * error[50].mean()
    assert (mapped(spark, x, n=20) == mapped(spark, x, n=20)).all()


@pytest.mark.parametrize("degree,coef0", [(2, 1.0), (3, 0.5), (2, 0.0)])
def test_monomials_are_the_polynomial_kernel(spark, degree, coef0):
    x = np.random.default_rng(2).standard_normal((25, 3))
    exact = (0.4 * x @ x.T + coef0) ** degree
    z = mapped(spark, x, kind="poly", degree=degree, gamma=0.4, coef0=coef0)
    assert np.allclose(z @ z.T, exact, atol=1e-9)


def test_hashed_monomials_are_unbiased(spark):
    x = np.random.default_rng(3).standard_normal((12, 3))
    exact = (0.4 * x @ x.T + 1.0) ** 2
    found = [(z := mapped(spark, x, kind="poly", gamma=0.4, buckets=6, seed=s)) @ z.T for s in range(60)]
    assert np.abs(np.mean(found, axis=0) - exact).mean() < 0.35 * np.abs(exact).mean() and len(found[0]) == 12


def test_two_rings(spark):
    rng = random.Random(4)
    x, y = [], []
    for i in range(400):
        r, a = (1.0 if i % 2 else 2.0) + rng.gauss(0, 0.12), rng.uniform(0, 2 * math.pi)
        x.append((r * math.cos(a), r * math.sin(a)))
        y.append(i % 2)
    df = frame(spark, x, y)
    from pyspark.ml.feature import VectorAssembler
    plain = VectorAssembler(inputCols=["x 0", "x 1"], outputCol="features").transform(df)

    def accuracy(out):
        return out.where("label = prediction").count() / 400
    assert accuracy(M.linear_svc(multiclass=False).fit(plain).transform(plain)) < 0.7
    for kw in ({"kind": "rbf", "n": 100}, {"kind": "poly", "degree": 2}):
        out = K.kernel_svc(["x 0", "x 1"], multiclass=False, max_iter=30, **kw).fit(df).transform(df)
        assert accuracy(out) > 0.97
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_unknown_kernels_are_refused(spark):
    for kw in ({"kind": "sigmoid"}, {"kind": "poly", "degree": 4}):
        with pytest.raises(ValueError):
            K.KernelMap(["x"], **kw)


def test_equal_rows_are_fitted_as_one(spark, monkeypatch):
    """The solver reads distinct rows with their numbers as weights and finds the machine of all rows."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler
    rng = random.Random(6)
    points = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(60)]
    x = [points[int(60 * rng.random() ** 2)] for _ in range(1500)]
    df = frame(spark, x, [a + 0.5 * b + rng.gauss(0, 0.3) > 0 for a, b in x])
    seen, fit = [], LinearSVC._fit
    monkeypatch.setattr(LinearSVC, "_fit", lambda self, d: (seen.append(d.count()), fit(self, d))[1])
    plain = VectorAssembler(inputCols=["x 0", "x 1"], outputCol="features")
    machine = M.linear_svc(max_iter=10, multiclass=False)
    want = machine.fit(plain.transform(df))
    got = K.CountedFit(["x 0", "x 1"], [plain], machine).fit(df).stages[-1]
    rows = np.array(df.collect())

    def loss(m):
        return np.maximum(0, 1 - (2 * rows[:, 2] - 1) * (rows[:, :2] @ m.coefficients.toArray() + m.intercept)).mean()
    assert loss(got) == pytest.approx(loss(want), rel=0.03)
    K.kernel_svc(["x 0", "x 1"], n=10, max_iter=2).fit(df)
    distinct = df.distinct().count()
    assert seen[:2] == [1500, distinct] and set(seen[2:]) == {distinct} and distinct <= 120


def test_a_null_is_refused(spark):
    df = frame(spark, [(1.0, 2.0)]).withColumn("x 1", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="holds null"):
        K.KernelMap(["x 0", "x 1"], n=5).transform(df).collect()


def test_classes_share_the_cluster(spark):
    assert M.linear_svc().getParallelism() == M.CLASSES_AT_A_TIME > 1
