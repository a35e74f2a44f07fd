"""Feature stages of every training split from one pass.

A cross-validated model must not see its validation rows in any stage, the means that fill gaps,
the scales and the category lists included.  One grouping by fold gives, per fold, the
moments of every numeric column and the counts of every category; the statistics of a
training split are those of the other folds, merged.  So k splits cost one pass, not k fits.

A split's stages are expressions and ML models with known labels: gaps become the
training mean, values are centred and divided by the training spread (a column without spread
is only centred), categories are numbered by training frequency (ties alphabetically) and
one-hot; a category that the training rows lack, and a missing one, share the last slot.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import nan_to_null, quoted


@dataclass(frozen=True)
class Moments:
    """Count, mean and sum of squared deviations; ``+`` merges two sets of rows."""
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        return Moments(n, self.mean + d * other.n / n, self.m2 + other.m2 + d * d * self.n * other.n / n)

    def spread(self) -> float:
        """Sample standard deviation, 1 where there is none."""
        s = math.sqrt(self.m2 / (self.n - 1)) if self.n > 1 else 0.0
        return s or 1.0


class FoldFeatures:
    """Statistics of all folds of a table, and the feature stages of each training split."""

    def __init__(self, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fold: str | None = None, out: str = "features"):
        self.numeric, self.categorical, self.out = list(numeric), list(categorical), out
        which = F.col(quoted(fold)).cast("int") if fold else F.lit(0)
        entries = [F.struct(F.lit(i).alias("no"), F.lit(None).cast("string").alias("value"),
                            nan_to_null(F.col(quoted(c)).cast("double")).alias("x")) for i, c in enumerate(self.numeric)]
        entries += [F.struct(F.lit(len(self.numeric) + i).alias("no"), F.col(quoted(c)).cast("string").alias("value"),
                             F.lit(None).cast("double").alias("x")) for i, c in enumerate(self.categorical)]
        rows = df.select(which.alias("fold"), F.explode(F.array(*entries)).alias("e")).select("fold", "e.*")
        grouped = rows.groupBy("fold", "no", "value").agg(
            F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.count(F.lit(1)).alias("rows"))
        self.moments: dict[int, dict[int, Moments]] = {}
        self.counts: dict[int, dict[int, dict[str, int]]] = {}
        for r in grouped.collect():  # folds x (numeric columns + categories)
            if r.no < len(self.numeric):
                self.moments.setdefault(r.fold, {})[r.no] = Moments(r.n, r["mean"] or 0.0, (r["var"] or 0.0) * r.n)
            else:
                own = self.counts.setdefault(r.fold, {}).setdefault(r.no - len(self.numeric), {})
                if r.value is not None:
                    own[r.value] = r.rows

    def renamed(self, numeric: Sequence[str], categorical: Sequence[str]) -> FoldFeatures:
        """The same statistics for a table that calls its columns otherwise."""
        other = copy.copy(self)
        other.numeric, other.categorical = list(numeric), list(categorical)
        return other

    def training_moments(self, without: int | None) -> list[Moments]:
        """Moments of each numeric column over all folds but ``without``."""
        out = []
        for i in range(len(self.numeric)):
            total = Moments()
            for f in sorted(self.moments):
                if f != without and i in self.moments[f]:
                    total = total + self.moments[f][i]
            out.append(total)
        return out

    def training_labels(self, without: int | None) -> list[list[str]]:
        """Categories of each categorical column in the training rows, the most frequent first."""
        out = []
        for i in range(len(self.categorical)):
            total: dict[str, int] = {}
            for f, per in self.counts.items():
                if f != without:
                    for value, n in per.get(i, {}).items():
                        total[value] = total.get(value, 0) + n
            out.append(sorted(total, key=lambda v: (-total[v], v)))
        return out

    def transform(self, df: DataFrame, without: int | None = None) -> DataFrame:
        """``df`` with the feature vector of the training split without fold ``without`` (None: of all rows)."""
        scaled = {}
        for i, (c, m) in enumerate(zip(self.numeric, self.training_moments(without))):
            x = F.coalesce(nan_to_null(F.col(quoted(c)).cast("double")), F.lit(m.mean))
            scaled[f"__num{i}"] = (x - F.lit(m.mean)) / F.lit(m.spread())
        # a mark before every category: Spark's encoder cannot name a slot after an empty string
        text = {f"__cat{i}": F.concat(F.lit("="), F.col(quoted(c)).cast("string")) for i, c in enumerate(self.categorical)}
        df = df.withColumns(scaled | text)
        inputs = list(scaled)
        if text:
            index, hot = [f"__idx{i}" for i in range(len(text))], [f"__hot{i}" for i in range(len(text))]
            # a column without any category still has a slot for what is unknown
            labels = [[f"={v}" for v in x] or ["none"] for x in self.training_labels(without)]
            for c, i, x in zip(text, index, labels):  # a model each: PySpark passes lists of unequal length on with gaps
                df = StringIndexerModel.from_labels(x, c, i, handleInvalid="keep").transform(df)
            df = OneHotEncoder(inputCols=index, outputCols=hot, dropLast=False).fit(df).transform(df)  # sizes from the labels: no pass
            inputs += hot
        out = VectorAssembler(inputCols=inputs, outputCol=self.out).transform(df)
        return out.drop(*scaled, *text, *(f"__idx{i}" for i in range(len(text))), *(f"__hot{i}" for i in range(len(text))))
