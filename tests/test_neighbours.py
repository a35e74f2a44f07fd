"""Nearest-neighbour mutual information against brute force over all pairs."""

import math
import random

import numpy as np
import pytest

from tablesmith.plans import neighbours as N


def brute(x, y, k):
    """The definition, point by point."""
    ok = [i for i in range(len(x)) if x[i] is not None and y[i] is not None and x[i] == x[i] and y[i] == y[i]]
    x, y = (np.array([v[i] for i in ok], dtype=float) for v in (x, y))
    n = len(x)
    if n <= k:
        return None
    x, y = (np.floor(v / (v.std() or 1.0) * N.STEPS + 0.5) / N.STEPS for v in (x, y))
    total = 0.0
    for i in range(n):
        dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
        eps = np.sort(np.delete(np.maximum(dx, dy), i))[k - 1]
        nx, ny = ((d < eps).sum() if eps else (d == 0).sum() for d in (dx, dy))
        total += float(N.digamma(nx) + N.digamma(ny))
    return max(0.0, float(N.digamma(n) + N.digamma(k)) - total / n)


def columns(seed, n=700):
    rng = random.Random(seed)
    y = [rng.gauss(0, 1) if i % 3 else 0.25 for i in range(n)]  # a third of the targets are one value
    out = {
        "near": [v + rng.gauss(0, 0.3) for v in y],
        "steps": [float(round(v * 2)) for v in y],
        "noise": [rng.expovariate(0.1) ** 3 for _ in y],
        "flag": [float(v > 0) for v in y],
        "same": [7.0] * n,
        "gaps": [None if i % 7 == 0 else float("nan") if i % 11 == 0 else v * v for i, v in enumerate(y)],
        "few": [1.0 * i if i < 3 else None for i in range(n)],
    }
    return out, [None if i == 5 else v for i, v in enumerate(y)]


@pytest.mark.parametrize("box,piece,lookups,k", [(512, 20_000, 100_000, 3), (8, 20, 9, 3), (3, 5, 1000, 1), (20, 60, 50, 5)])
def test_equals_brute_force(spark, monkeypatch, box, piece, lookups, k):
    for name, v in (("BOX", box), ("SLICE", piece), ("LOOKUPS", lookups)):
        monkeypatch.setattr(N, name, v)
    xs, y = columns(box)
    df = spark.createDataFrame(list(zip(*xs.values(), y)), ", ".join(f"`{c}` double" for c in [*xs, "the target"]))
    got = {r.feature: r.mi for r in N.nearest_mutual_information(df, list(xs), "the target", k).collect()}
    want = {c: brute(x, y, k) for c, x in xs.items()}
    assert (got["few"] is None) == (k >= 3)
    for c in xs:
        assert got[c] == want[c] or got[c] == pytest.approx(want[c], abs=1e-9), c
    assert got["near"] > 0.3 and got["same"] < 0.01


def test_digamma_of_whole_numbers():
    want = [-0.5772156649015329 + sum(1 / i for i in range(1, n)) for n in range(1, 60)]
    assert np.allclose(N.digamma(np.arange(1, 60)), want, rtol=0, atol=1e-12)
    assert float(N.digamma(10 ** 9)) == pytest.approx(math.log(10 ** 9), rel=1e-9)


def test_k_nearest_counts_weights():
    x, y, w = np.array([0.0, 1.0, 5.0]), np.array([0.0, 0.5, 0.0]), np.array([3, 1, 2])
    assert N.k_nearest(x, y, w, x, y, 3, True).tolist() == [[0, 0, 1], [1, 1, 1], [0, 4, 5]]
    assert N.k_nearest(x, y, w, np.array([0.0]), np.array([0.0]), 5, False).tolist() == [[0, 0, 0, 1, 5]]
    assert N.k_nearest(x[:1], y[:1], w[:1], x[:1], y[:1], 3, True).tolist() == [[0, 0, math.inf]]
