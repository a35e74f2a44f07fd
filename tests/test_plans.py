"""Distributed plan pieces against brute force on small fixtures."""

import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablesmith.functions.columns import hash_unit, round_half_away, round_half_away_value
from tablesmith.plans import kendall, quantiles, ranking


def _skewed(n=3000, seed=1):
    rng = random.Random(seed)
    vals = []
    for i in range(n):
        if i % 3 == 0:
            vals.append(7.0)            # a hot value: a third of all rows
        elif i % 17 == 0:
            vals.append(None)
        else:
            vals.append(rng.gauss(0, 100))
    return vals


@pytest.mark.parametrize("fetch_limit", [200_000, 5])
def test_exact_quantiles_match_numpy(spark, monkeypatch, fetch_limit):
    monkeypatch.setattr(quantiles, "FETCH_LIMIT", fetch_limit)   # 5 forces several narrowing passes
    monkeypatch.setattr(quantiles, "CELL_LIMIT", 64)
    vals = _skewed()
    other = [None if v is None else float("inf") if i % 50 == 0 else -float("inf") if i % 50 == 1 else -0.0 if i % 9 == 0
             else math.copysign(abs(v) ** 40, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(list(zip(vals, other)), "x double, `y.z` double").union(
        spark.createDataFrame([(float("nan"), 1.0)], "x double, y double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0] + [i / 97 for i in range(97)]
    got = quantiles.exact_quantiles(df.withColumnRenamed("y.z", "y"), ["x", "y"], probs)
    clean = np.array([v for v in vals if v is not None])
    assert np.allclose(got["x"], np.quantile(clean, probs, method="linear"), rtol=0, atol=1e-9)
    y = sorted([v for v in other if v is not None] + [1.0])
    for p, v in zip(probs, got["y"]):
        k = p * (len(y) - 1)
        lo, hi = y[math.floor(k)], y[math.ceil(k)]
        want = lo if k == math.floor(k) else lo + (k - math.floor(k)) * (hi - lo)
        assert v == want or math.isnan(v) and math.isnan(want)


def test_ranks_of_many_columns_take_one_scan_a_pass(spark, monkeypatch):
    """Whatever the number of ranks: a pass counts every value of every column once."""
    rows = [(float(i * 7919 % 1000), float(i % 13)) for i in range(1000)]
    df = spark.createDataFrame(rows, "x double, y double")
    seen = []
    count = quantiles._cell_counts

    def spy(*a):
        out = count(*a)
        seen.append({c: sum(n for n, _, _ in cells) for c, cells in out.items()})
        return out
    monkeypatch.setattr(quantiles, "_cell_counts", spy)
    got = quantiles.exact_quantiles(df, ["x", "y"], [i / 200 for i in range(201)])
    assert np.allclose(got["x"], np.quantile([r[0] for r in rows], [i / 200 for i in range(201)]))
    assert seen == [{"x": 1000, "y": 1000}]


def test_a_bracket_without_its_rank_is_no_special_case(spark):
    df = spark.createDataFrame([(float(i),) for i in range(500)], "x double")
    wrong = {"x": [(400.0, 410.0, 5), (700.0, 900.0, 5)]}
    assert quantiles.kth_smallest(df, {"x": [0, 3, 250, 499]}, wrong) == {("x", k): float(k) for k in (0, 3, 250, 499)}
    with pytest.raises(ValueError):
        quantiles.kth_smallest(df, {"x": [500]}, wrong)


def test_placed_counts_edges_up_to_the_value(spark):
    inf = float("inf")
    vals = [None, -inf, -1.5, -0.0, 0.0, 2.0, 2.5, inf]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for edges in ([], [0.0], [-inf, 0.0, 2.0, inf], [-inf], [inf], [-1.5, 2.5]):
        got = [r.n for r in quantiles.placed(df.select((F.col("x") + 0.0).alias("x")), {"x": edges}, {"x": "n"}).collect()]
        assert got == [None if v is None else sum(e <= v for e in edges) for v in vals], edges


def test_quantiles_all_missing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.5])["x"] == [None]


def test_hash_order_ranks_under_skew(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long").withColumn("h", hash_unit(["k"]))
    got = ranking.hash_order_ranks(df, ["g"], "h", ["k"], out="r", ranges=8).toPandas()
    pdf = df.toPandas().sort_values(["g", "h", "k"])
    pdf["want"] = pdf.groupby("g").cumcount()
    m = got.merge(pdf, on=["g", "k"])
    assert (m["r"] == m["want"]).all() and len(m) == 2000


def test_cumulative_by_value(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b"]), float(rng.randint(0, 40)), float(rng.random() < 0.3)) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    got = ranking.cumulative_by_value(df, "v", ["w"], ["g"], ranges=6).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "v", "w"])
    for _, r in got.iterrows():
        sub = pdf[pdf.g == r.g]
        assert r.w == sub[sub.v == r.v].w.sum()
        assert r.below_w == sub[sub.v < r.v].w.sum()
        assert r.total_w == sub.w.sum()


def _tau_b_brute(x, y):
    n0 = len(x) * (len(x) - 1) / 2
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in itertools.combinations(range(len(x)), 2))
    tx = sum(c * (c - 1) / 2 for c in pd.Series(x).value_counts())
    ty = sum(c * (c - 1) / 2 for c in pd.Series(y).value_counts())
    return s / math.sqrt((n0 - tx) * (n0 - ty))


@pytest.mark.parametrize("cells, line_points", [(256, 100_000), (3, 12), (4, 40)])
def test_kendall_matches_pair_count(spark, monkeypatch, cells, line_points):
    monkeypatch.setattr(kendall, "CELLS", cells)               # few cells and short lines: several levels
    monkeypatch.setattr(kendall, "LINE_POINTS", line_points)
    rng = random.Random(5)
    x = [float(rng.randint(0, 30)) for _ in range(400)]
    y = [float(v + rng.randint(-10, 10)) if i % 4 else 3.0 for i, v in enumerate(x)]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    assert abs(kendall.kendall_tau_b(df, "x", "y") - _tau_b_brute(x, y)) < 1e-12


def test_kendall_groups_stay_small_as_data_grows(spark, monkeypatch):
    """Ten times the points: the largest group a task counts stays under the same bound."""
    monkeypatch.setattr(kendall, "CELLS", 8)
    monkeypatch.setattr(kendall, "LINE_POINTS", 60)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 200, 1500).astype(float)
    x[:500] = 17.0                                             # a third of the rows share one value
    y = rng.standard_normal(1500).round(2)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    assert abs(kendall.kendall_tau_b(df, "x", "y") - _tau_b_brute(x, y)) < 1e-12


def test_rounding_matches_sql_engine(spark):
    vals = [1037.0821875, 0.0499185, 2.675, -2.5e-7, 123456.1234565, 0.125, -4e-7, -0.0, 0.0]
    con = duckdb.connect()
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in (2, 6):
        got = [r[0] for r in df.select(round_half_away("x", d)).collect()]
        want = [con.execute(f"SELECT round({v!r}::DOUBLE, {d})").fetchall()[0][0] for v in vals]
        assert [repr(v) for v in got] == [repr(v) for v in want]      # also the sign of zero
        assert [repr(round_half_away_value(v, d)) for v in vals] == [repr(v) for v in want]


def test_signed_dominance_matches_brute_force():
    rng = np.random.default_rng(11)
    for n in (1, 2, 50, 300, 2000):
        key = rng.integers(0, max(2, n // 7), n).astype(float)
        key[: n // 3] = 5.0                                     # a hot key
        y = rng.integers(0, max(2, n // 5), n).astype(float)
        w = rng.integers(1, 4, n).astype(float)
        got = kendall._signed_dominance(key, y, w)
        if n <= 300:
            want = float(np.sum(w[:, None] * w[None, :] * (key[None, :] < key[:, None])
                                * np.sign(y[:, None] - y[None, :])))
        else:
            want = sum(float(np.sum(w[i] * w * (key < key[i]) * np.sign(y[i] - y))) for i in range(n))
        assert got == pytest.approx(want, abs=1e-6)


def test_hot_group_is_spread_over_ranges(spark):
    """A stratum with a third of all rows is ranked in as many balanced ranges as the session shuffles into."""
    n = 30000
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", i) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k long").withColumn("h", hash_unit(["k"]))
    ranges = ranking.shuffle_ranges(df)
    width = -(-(1 << 32) // ranges)
    sizes = (df.where("g = 'hot'").groupBy((F.col("h") / F.lit(width)).cast("int").alias("r")).count()
             .collect())
    counts = [r["count"] for r in sizes]
    assert len(counts) == ranges
    assert max(counts) < 2 * (n / 3) / ranges      # no range holds more than twice its share


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_missing_groups_keep_their_rows(spark, ranges):
    rows = [(None if i % 4 == 0 else "ab"[i % 2], i, float(i % 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k long, v double").withColumn("h", hash_unit(["k"]))
    got = ranking.hash_order_ranks(df, ["g"], "h", ["k"], out="r", ranges=ranges).collect()
    assert len(got) == 200
    for g in (None, "a", "b"):
        assert sorted(r.r for r in got if r.g == g) == list(range(sum(x[0] == g for x in rows)))
    total = ranking.cumulative_by_value(df.withColumn("w", F.lit(1.0)), "v", ["w"], ["g"], ranges=ranges).collect()
    for r in total:
        below = sum(x[0] == r.g and x[2] < r.v for x in rows)
        assert (r.below_w, r.total_w) == (below, sum(x[0] == r.g for x in rows))


def test_mode_of_a_hot_value(spark):
    from tablesmith.operators import impute
    rows = [("hot",)] * 5000 + [(f"v{i}",) for i in range(3000)] + [(None,)] * 6000
    df = spark.createDataFrame(rows, "c string")
    assert impute.fit_mode(df, ["c"]).values == {"c": "hot"}


def test_document_frequencies_need_no_lambda(spark, monkeypatch):
    """Terms and document frequencies come from plain strings: no struct is built for a token."""
    from tablesmith.operators import features
    docs = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, ["a", "c"]), (3, ["c", "c", "c", "c", "c"]), (4, []), (5, None)], "id int, words array<string>")
    monkeypatch.setattr(F, "transform", lambda *a: pytest.fail("a lambda over the tokens"))
    assert features.fit_vocabulary(docs, "words", 5, 2).terms == ["c", "a"]
    assert features.fit_vocabulary(docs, "words", 5, 2, ["c"]).terms == ["a"]
    assert features.fit_vocabulary(docs, "words", 5).terms == ["c", "b", "a"]


@pytest.mark.parametrize("few", [100_000, 0])
def test_spearman_joins_rows_with_all_columns_but_the_widest(spark, monkeypatch, few):
    from tablesmith.operators import profile
    rng = random.Random(5)
    data = [(float(rng.randrange(4)) if rng.random() > 0.1 else None, rng.gauss(0, 1) if rng.random() > 0.2 else None, float(rng.randrange(9)), 1.0)
            for _ in range(300)]
    seen, hint = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda d: (seen.append(d), hint(d))[1])
    monkeypatch.setattr(profile, "BROADCAST_VALUES", few)
    got = {(r.x, r.y): r.r for r in profile.corr_matrix_spearman(spark.createDataFrame(data, "a double, b double, c double, d double"), list("abcd")).collect()}
    p = pd.DataFrame(data, columns=list("abcd"))
    for x, y in itertools.permutations("abc", 2):
        both = p[[x, y]].dropna().rank()
        assert got[x, y] == pytest.approx(both[x].corr(both[y]), abs=1e-9)
    assert got["a", "d"] is None and got["d", "d"] == 1.0 and len(got) == 16
    assert len(seen) == (3 if few else 0)
