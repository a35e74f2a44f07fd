"""Guided search: proposals follow the log, resume, and beat plain draws on a planted optimum."""

import math
import random

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler

from tablesmith.operators import guided as G
from tablesmith.operators import models as M
from tablesmith.operators.tune import RunLog, Space
from tablesmith.queries.common import scratch_path

SPACE = {"rate": Space("loguniform", 1e-5, 10.0), "share": Space("uniform", 0.0, 1.0), "depth": Space("randint", 1, 20),
         "step": Space("quniform", 0.0, 10.0, q=0.5), "kind": Space("choice", options=["a", "b", "c"])}


def planted(s):
    return ((math.log10(s["rate"]) + 2) ** 2 + 8 * (s["share"] - 0.7) ** 2 + ((s["depth"] - 6) / 5) ** 2 + (s["step"] - 3) ** 2 / 10
            + (s["kind"] != "b"))


def search(seed, n=48, guided=True):
    history = []
    while len(history) < n:
        history += [(s, planted(s)) for s in G.propose(SPACE, history, 4, False, seed, 8 if guided else n)]
    return history


def test_guided_beats_plain_draws_on_a_planted_optimum():
    best = {g: sorted(min(m for _, m in search(seed, guided=g)) for seed in range(100, 115)) for g in (True, False)}
    assert best[True][7] < 0.6 * best[False][7] and sum(best[True]) < sum(best[False])


def test_proposals_follow_from_history_and_stay_inside():
    history = search(3)
    assert history == search(3) and history != search(4)
    assert G.propose(SPACE, history[:20], 4, False, 3) == [s for s, _ in history[20:24]]
    for s, _ in history:
        assert 1e-5 <= s["rate"] <= 10 and 0 <= s["share"] <= 1 and s["depth"] in range(1, 21) and s["step"] * 2 == int(s["step"] * 2)
        assert s["kind"] in "abc"
    up = G.propose(SPACE, [(s, -m) for s, m in history[:20]], 4, True, 3)
    assert up == G.propose(SPACE, history[:20], 4, False, 3)


def test_failed_trials_and_single_points():
    failed = [({**s}, None) for s, _ in search(5, 12)]
    assert len(G.propose(SPACE, failed, 3, False)) == 3
    one = {"x": Space("uniform", 2.0, 2.0), "c": Space("choice", options=[7])}
    assert G.propose(one, [({"x": 2.0, "c": 7}, 1.0)] * 9, 2, False) == [{"x": 2.0, "c": 7}] * 2


def test_search_resumes_from_the_log(spark):
    rng = random.Random(1)
    rows = [(i, x := rng.random(), 5 * x + rng.gauss(0, 0.1)) for i in range(200)]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "id int, x double, label double"))
    space = {"regParam": Space("loguniform", 1e-6, 10.0)}
    path = scratch_path(spark, "guided")
    args = (M.linear_regression(), space, RegressionEvaluator(metricName="rmse"), df)
    _, first = G.guided_search(*args, RunLog(spark, path), "e", 4, 2, 2, ["id"], startup=4)
    model, table = G.guided_search(*args, RunLog(spark, path), "e", 9, 2, 2, ["id"], startup=4)
    whole = G.guided_search(*args, RunLog(spark, scratch_path(spark, "guided")), "e", 9, 2, 2, ["id"], startup=4)[1]
    got = [tuple(r) for r in table.orderBy("trial").collect()]
    assert [g[:2] for g in got] == [tuple(r)[:2] for r in whole.orderBy("trial").collect()] and len(got) == 9
    assert [g[1] for g in got[:4]] == [r.setting for r in first.orderBy("trial").collect()]
    assert sum(g[4] for g in got) == 5 and model.coefficients[0] == pytest.approx(5, abs=0.2)
