"""Kernel support vector machines by explicit feature maps (M4).

A kernel SVM has no distributed form, a linear one has.  Feature maps whose inner products
approximate (or are) the kernel turn one into the other:

- ``rbf``: random Fourier features sqrt(2 / n) cos(w x + b), w normal with variance 2 gamma, b uniform; the
  error of an inner product is of the order of 1 / sqrt(n).
- ``poly`` of degree 2 or 3: every monomial of (gamma x y + coef0)^degree with its square-rooted weight, which
  is exact; with ``buckets`` the monomials are hashed with random signs into that many features (unbiased).

The maps are column expressions (no Python worker); random numbers come from the seed alone.

A machine's loss is a sum over rows, so equal rows count as one with their number as weight: ``CountedFit`` groups the
rows by their raw columns and label before anything is mapped, and the solver's passes read distinct rows only.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import quoted
from tablesmith.operators.models import linear_svc
from tablesmith.session import cut_lineage


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def fourier_weights(d: int, n: int, gamma: float, seed: int) -> list[tuple[list[float], float]]:
    """(w, b) of each of n random Fourier features over d columns."""
    rng = random.Random(seed)
    return [([rng.gauss(0, math.sqrt(2 * gamma)) for _ in range(d)], rng.uniform(0, 2 * math.pi)) for _ in range(n)]


def rbf_expressions(cols: Sequence[str], n: int, gamma: float, seed: int) -> list[str]:
    """SQL text of the random Fourier features."""
    return [f"{_number(math.sqrt(2 / n))} * cos({' + '.join(f'{_number(w)} * {c}' for w, c in zip(ws, cols))} + {_number(b)})"
            for ws, b in fourier_weights(len(cols), n, gamma, seed)]


def poly_expressions(cols: Sequence[str], degree: int, gamma: float, coef0: float, buckets: int | None, seed: int) -> list[str]:
    """SQL text of the monomials of (gamma x y + coef0)^degree, or of ``buckets`` signed sums of them."""
    monomials = []
    for powers in itertools.product(range(degree + 1), repeat=len(cols)):
        total = sum(powers)
        if total > degree or (total < degree and not coef0):
            continue
        ways = math.factorial(degree) / math.factorial(degree - total) / math.prod(map(math.factorial, powers))
        weight = math.sqrt(ways * gamma ** total * coef0 ** (degree - total))
        monomials.append((powers, " * ".join([_number(weight), *(c for c, p in zip(cols, powers) for _ in range(p))])))
    if buckets is None:
        return [m for _, m in monomials]
    out: list[list[str]] = [[] for _ in range(buckets)]
    for powers, m in monomials:
        h = int(hashlib.md5(f"{seed}|{powers}".encode()).hexdigest()[:15], 16)
        out[(h >> 1) % buckets].append(f"{'-' if h & 1 else ''}({m})")
    return [" + ".join(x) or _number(0.0) for x in out]


class KernelMap(Transformer):
    """Adds a vector column whose inner products follow a kernel of the given columns (double, without gaps)."""

    def __init__(self, cols: Sequence[str], kind: str = "rbf", n: int = 300, gamma: float = 1.0, degree: int = 2, coef0: float = 1.0,
                 buckets: int | None = None, seed: int = 42, out: str = "features"):
        super().__init__()
        if kind not in ("rbf", "poly"):
            raise ValueError(kind)
        if kind == "poly" and degree not in (2, 3):
            raise ValueError("polynomial kernels of degree 2 or 3")
        names = [quoted(c) for c in cols]
        self.out = out
        each = rbf_expressions(names, n, gamma, seed) if kind == "rbf" else poly_expressions(names, degree, gamma, coef0, buckets, seed)
        # the lambda also keeps many features from becoming one method too large to be compiled to machine code
        self.features = (f"CASE WHEN exists(array({', '.join(names)}), x -> x IS NULL) THEN raise_error('a kernel column holds null') "
                         f"ELSE array({', '.join(each)}) END")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out, array_to_vector(F.expr(self.features)))


class CountedFit(Estimator):
    """Fits a learner with weights to the distinct rows of the named columns and the label, weighted by their number.

    ``maps`` give the learner's features from the columns; the model scores raw rows by them.
    """

    def __init__(self, cols: Sequence[str], maps: Sequence[Transformer], inner, label: str = "label"):
        super().__init__()
        self.cols, self.maps, self.inner, self.label = list(cols), list(maps), inner, label

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        from tablesmith.operators.select import bounded_partitions
        counted = dataset.groupBy(*[F.col(quoted(c)) for c in dict.fromkeys([*self.cols, self.label])]).agg(
            F.count(F.lit(1)).cast("double").alias("_weight"))
        rows = bounded_partitions(cut_lineage(counted))
        for m in self.maps:
            rows = m.transform(rows)
        return PipelineModel(stages=[*self.maps, self.inner.copy().setWeightCol("_weight").fit(rows)])


def kernel_svc(cols: Sequence[str], kind: str = "rbf", reg: float = 0.0, max_iter: int = 100, multiclass: bool = True, label: str = "label",
               **kernel) -> CountedFit:
    """M4 with a kernel: the map, then the linear SVM (one-vs-rest for more than two classes), fitted to distinct rows."""
    return CountedFit(cols, [KernelMap(cols, kind, out="_kernel", **kernel)], linear_svc(reg, max_iter, multiclass, "_kernel", label), label)
