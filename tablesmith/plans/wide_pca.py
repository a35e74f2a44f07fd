"""Principal components of wide vectors without a d x d matrix.

A randomised range finder: a d x l block (l a little over the wanted components) is
multiplied by the covariance a few times, made orthonormal between the passes, and the covariance in
its span (l x l) gives the components.  A pass is one scan: every task multiplies its rows with the block in
sparse form and emits one row per column that it met, and Spark sums those rows.  The driver holds
d x l numbers; rows stay where they are.

Rules: vectors are centred (by their mean, never made dense for it); each component's largest loading is
positive; a null vector is left out; variances divide by n - 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 4096


@dataclass
class WideComponents:
    """Loadings (d x k), variances of the components, their shares of the total variance, the mean, and rows."""
    loadings: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    mean: np.ndarray
    rows: int


def _entries(df: DataFrame, vec: str) -> DataFrame:
    """Vectors as (at, value) lists of their entries that are not zero, and their length."""
    dense = vector_to_array(vec)
    pairs = F.filter(F.transform(dense, lambda x, i: F.struct(i.alias("at"), x.alias("value"))), lambda p: p["value"] != 0)
    return df.where(F.col(vec).isNotNull()).select(pairs.alias("e")).select(
        F.col("e.at").alias("at"), F.col("e.value").alias("value"))


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row of each entry, column, value) of about ``CHUNK_ROWS`` rows each."""
    for lo in range(0, batch.num_rows, CHUNK_ROWS):
        part = batch.slice(lo, CHUNK_ROWS)
        at, value = part.column(0), part.column(1)
        sizes = np.diff(at.offsets.to_numpy())
        start, stop = at.offsets[0].as_py(), at.offsets[-1].as_py()
        yield (part.num_rows, np.repeat(np.arange(part.num_rows), sizes), at.values.slice(start, stop - start).to_numpy(),
               value.values.slice(value.offsets[0].as_py(), stop - start).to_numpy())


def _moments(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, and per column the sum and the sum of squares."""
    flat = rows.select(F.explode(F.arrays_zip("at", "value")).alias("p"))
    found = flat.groupBy(F.col("p.at").alias("j")).agg(F.sum("p.value").alias("s"), F.sum(F.col("p.value") ** 2).alias("ss")).collect()
    s, ss = np.zeros(d), np.zeros(d)
    for r in found:  # d rows
        s[r.j], ss[r.j] = r.s, r.ss
    return rows.count(), s, ss


def _times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """Sum over the rows of x (x . block): d x l, one scan."""
    shared = rows.sparkSession.sparkContext.broadcast(block)  # d x l numbers
    width = block.shape[1]
    names = [f"z{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        total = np.zeros(b.shape)
        seen = np.zeros(len(b), dtype=bool)
        for batch in batches:
            for n, row, column, value in _rows_of(batch):
                product = np.zeros((n, width))
                np.add.at(product, row, value[:, None] * b[column])
                np.add.at(total, column, value[:, None] * product[row])
                seen[column] = True
        j = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(j), *(pa.array(total[j, i]) for i in range(width))], names=["j", *names])

    sums = rows.mapInArrow(run, "j long, " + ", ".join(f"{c} double" for c in names)).groupBy("j").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros(block.shape)
    for r in sums.collect():  # at most d rows
        out[r.j] = [r[c] for c in names]
    return out


def pca_wide(df: DataFrame, vec: str, k: int, oversample: int = 10, passes: int = 6, seed: int = 42) -> WideComponents:
    """The ``k`` leading components of a vector column, by ``passes`` scans of it."""
    from tablesmith.session import cut_lineage
    first = df.where(F.col(vec).isNotNull()).select(F.size(vector_to_array(vec)).alias("d")).first()
    if first is None:
        raise ValueError("no vectors")
    d = first.d
    width = min(d, k + oversample)
    rows = cut_lineage(_entries(df, vec))
    n, s, ss = _moments(rows, d)
    mean, over = s / n, max(1, n - 1)
    total = float(((ss - s * mean) / over).sum())

    def covariance(block: np.ndarray) -> np.ndarray:
        # centred: sum of (x - m)(x - m)' b = sum of x (x' b) - n m (m' b)
        return (_times(rows, block) - n * np.outer(mean, mean @ block)) / over

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for _ in range(max(1, passes) - 1):
        q = np.linalg.qr(covariance(q))[0]
    small = q.T @ covariance(q)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-value)[:k]
    loadings = q @ vector[:, order]
    loadings = loadings * np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])] < 0, -1.0, 1.0)
    return WideComponents(loadings, value[order], value[order] / total if total else np.zeros(len(order)), mean, n)


def project(df: DataFrame, vec: str, found: WideComponents, out: str = "pca") -> DataFrame:
    """``df`` with the centred vectors' components as an array column (null for a null vector)."""
    shared = df.sparkSession.sparkContext.broadcast((found.loadings, found.mean @ found.loadings))

    @F.pandas_udf("array<double>")
    def components(x):
        import pandas as pd
        loadings, shift = shared.value
        return pd.Series([None if v is None else v @ loadings - shift for v in x])
    return df.withColumn(out, components(F.when(F.col(vec).isNotNull(), vector_to_array(vec))))
