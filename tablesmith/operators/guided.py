"""History-guided search (V6): Parzen-density proposals from the finished trials of a run log.

Finished trials are split into the better ones and the rest.  Per dimension each part gives a
density: normal kernels on its settings plus a broad prior, or smoothed counts for a choice.  Of
a number of draws from the better part's density the one with the largest ratio of the two
is proposed.  A batch of ``parallelism`` trials is proposed at once; settings already proposed
count among the rest, so a batch spreads.  Trials are Spark jobs (``run_trials``).

Every batch goes to the log before the next is proposed, and proposals depend on the log and the seed
alone: a search that stopped goes on where it was, and the same log gives the same proposals.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.operators import models as M
from tablesmith.operators.tune import WHOLE_NUMBERS, RunLog, Space, Trial, run_trials

GOOD_SHARE = 0.15
DRAWS = 24
PRIOR = 1.0


def _forward(space: Space, v: float) -> float:
    return math.log(v) if space.kind == "loguniform" else float(v)


def _bounds(space: Space) -> tuple[float, float]:
    return _forward(space, space.low), _forward(space, space.high)


def _back(space: Space, u: float):
    lo, hi = _bounds(space)
    u = min(hi, max(lo, u))
    if space.kind == "loguniform":
        return min(space.high, max(space.low, math.exp(u)))
    if space.kind == "quniform":
        return round(u / space.q) * space.q
    return round(u) if space.kind == "randint" else u


class Density:
    """A Parzen density of one dimension over some settings of it."""

    def __init__(self, space: Space, values: Sequence):
        self.space = space
        if space.kind == "choice":
            self.weights = [PRIOR + sum(v == o for v in values) for o in space.options]
            return
        lo, hi = _bounds(space)
        self.centres = sorted(_forward(space, v) for v in values)
        span = (hi - lo) or 1.0
        least = span / (4 + 4 * len(self.centres))
        edges = [lo, *self.centres, hi]
        self.widths = [min(span, max(least, edges[i + 1] - edges[i], edges[i + 2] - edges[i + 1])) for i in range(len(self.centres))]
        self.centres.append((lo + hi) / 2)  # the prior
        self.widths.append(span)

    def draw(self, rng: random.Random):
        if self.space.kind == "choice":
            return rng.choices(list(self.space.options), self.weights)[0]
        i = rng.randrange(len(self.centres))
        lo, hi = _bounds(self.space)
        for _ in range(100):
            u = rng.gauss(self.centres[i], self.widths[i])
            if lo <= u <= hi:
                return _back(self.space, u)
        return _back(self.space, rng.uniform(lo, hi))

    def at(self, v) -> float:
        if self.space.kind == "choice":
            return self.weights[list(self.space.options).index(v)] / sum(self.weights)
        u = _forward(self.space, v)
        return sum(math.exp(-0.5 * ((u - c) / w) ** 2) / w for c, w in zip(self.centres, self.widths)) / len(self.centres)


def propose(space: Mapping[str, Space], history: Sequence[tuple[Mapping, float | None]], n: int, larger: bool, seed: int = 42,
            startup: int = 8) -> list[dict]:
    """The next ``n`` settings after ``history`` (settings and metrics in the order of the trials; None: failed).

    The first ``startup`` trials are plain draws.
    """
    rng = random.Random(f"{seed}:{len(history)}")
    out: list[dict] = []
    done = [(s, m) for s, m in history if m is not None]
    done.sort(key=lambda x: -x[1] if larger else x[1])
    good = max(1, math.ceil(GOOD_SHARE * len(done)))
    for _ in range(n):
        if len(history) + len(out) < startup or len(done) < 2:
            out.append({name: s.draw(rng) for name, s in space.items()})
            continue
        rest = [s for s, _ in done[good:]] + [s for s, m in history if m is None] + out
        setting = {}
        for name, s in space.items():
            near, far = Density(s, [x[name] for x, _ in done[:good]]), Density(s, [x[name] for x in rest])
            drawn = [near.draw(rng) for _ in range(DRAWS)]
            setting[name] = max(drawn, key=lambda v: near.at(v) / far.at(v))
        out.append(setting)
    return out


def _trial_id(experiment: str, number: int) -> str:
    return hashlib.md5(f"{experiment}|{number}".encode()).hexdigest()


def finished(log: RunLog, experiment: str, metric: str) -> list[tuple[dict, float | None]]:
    """Settings and metrics of the experiment's trials, in order."""
    try:
        rows = log.runs().where(F.col("experiment") == experiment).collect()  # one row per trial
    except Exception as e:  # no run yet: the log's folder does not exist
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    rows.sort(key=lambda r: int(r.tags["trial"]))
    return [(json.loads(r.tags["setting"]), r.metrics.get(metric)) for r in rows]


def guided_search(estimator, space: Mapping[str, Space], evaluator, df: DataFrame, log: RunLog, experiment: str, n_trials: int = 20,
                  parallelism: int = 4, folds: int = 3, key: Sequence[str] | None = None, seed: int = 42, startup: int = 8):
    """V6, guided: go on with the experiment until it has ``n_trials``; (best model on all rows or None, trials).

    ``trials``: trial, setting (JSON), metric, status, guided; one row each.
    """
    if "maxDepth" in space and space["maxDepth"].highest() > M.MAX_TREE_DEPTH:
        raise ValueError(f"maxDepth up to {space['maxDepth'].highest()}: Spark's trees go to {M.MAX_TREE_DEPTH}")
    metric, larger = evaluator.getMetricName(), evaluator.isLargerBetter()

    def setting_of(drawn: Mapping) -> dict:
        return {estimator.getParam(k): int(round(v)) if k in WHOLE_NUMBERS else v for k, v in drawn.items()}

    while len(history := finished(log, experiment, metric)) < n_trials:
        drawn = propose(space, history, min(parallelism, n_trials - len(history)), larger, seed, startup)
        trials = run_trials(df, [Trial(type(estimator).__name__, estimator, setting_of(d)) for d in drawn], evaluator, folds, key,
                            parallelism=parallelism)
        first = len(history)
        log.log_many(experiment, [(f"trial-{first + i}", d, {"seconds": t.seconds} | ({metric: t.metric} if t.metric is not None else {}),
                                   {"trial": first + i, "setting": json.dumps(d, sort_keys=True), "status": t.status, "family": t.family})
                                  for i, (d, t) in enumerate(zip(drawn, trials))],
                     [_trial_id(experiment, first + i) for i in range(len(drawn))])
    done = [(i, s, m) for i, (s, m) in enumerate(history)]
    best = min((x for x in done if x[2] is not None), key=lambda x: (-x[2] if larger else x[2], x[0]), default=None)
    rows = [(i, json.dumps(s, sort_keys=True), m, "ok" if m is not None else "failed", i >= startup) for i, s, m in done]
    table = df.sparkSession.createDataFrame(rows, "trial int, setting string, metric double, status string, guided boolean")
    return (estimator.copy(setting_of(best[1])).fit(df) if best else None), table
