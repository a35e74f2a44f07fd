"""Approximate nearest neighbours by stable projections and a kd-tree (operator 2).

Nearness is the inner product.  Vectors get one more coordinate that makes all norms equal, so the
largest inner product is the smallest distance.  A Gaussian (2-stable) projection to a few dimensions
keeps distances in law: projected over true squared distance is chi-square with as many
degrees of freedom.  A point nearer than the present k-th neighbour therefore lies, with probability
``confidence``, within sqrt(quantile) times that distance in the projected space.

Every distinct vector is indexed.  The kd-tree's upper levels, cut on a bounded sample, deal the
projected points into blocks; inside a block the tree goes on to small leaves.  A query first searches its home
block.  The bound found there picks the further blocks whose boxes come near enough.  In a block, leaves are taken
by projected distance, a few more each time; their points are verified with the original vectors until the
chi-square test holds for the next leaf.

Rules: null, zero, or not wholly finite vectors, vectors not of the usual length (the most frequent one) and
rows without an id take no part, neither as queries nor as candidates.  Rows with equal ids and vectors are one
row.  Copies are one point with the k + 1 smallest of its ids (others cannot be among the k nearest).  Ties go to
the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.base import ship_package
from tablesmith.session import cut_lineage

DIMENSIONS = 10
CONFIDENCE = 0.97
#: Distinct vectors a block holds on average.
BLOCK_ROWS = 4096
#: Vectors of the sample that cuts the tree's upper levels (collected to the driver).
SAMPLE_ROWS = 20_000
#: Queries that search one block in one task unit; more are dealt to several units with a copy of the block.
UNIT_QUERIES = 4096
LEAF = 64
#: Queries that advance together inside a block.
QUERY_BATCH = 512


def chi_square_quantile(p: float, dimensions: int) -> float:
    """x with P(chi-square <= x) = p, for an even number of dimensions (closed sum), by bisection."""
    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dimensions // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


# --- vectors -----------------------------------------------------------------

def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, vkey) of the rows that take part; vkey is a digest of the vector."""
    vec = F.col(vec_col).cast("array<double>")
    infinite = float("inf")
    fine = (F.col("vec_id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
            & F.exists("vec", lambda x: x != 0))
    found = rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where("vec is not null").where(fine)
    sizes = found.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    found = found.where(F.size("vec") == (sizes["n"] if sizes else 0))
    return found.withColumn("vkey", F.md5(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")))


def distinct_vectors(rows: DataFrame, keep_ids: int, every: int) -> DataFrame:
    """One row per distinct vector: vkey, vec (packed doubles), norm2, its ``keep_ids`` smallest ids, and whether it is a query.

    Copies are combined inside each batch before the shuffle, so a very common vector brings few rows.
    """
    ship_package(rows.sparkSession)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy()
            vectors = flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 1)
            order = np.lexsort((ids, keys))
            heads = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(ids) else order
            groups = np.split(ids[order], heads[1:]) if len(ids) else []
            own = [np.unique(g) for g in groups]
            first = order[heads]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[first], pa.string()), pa.array([v.tobytes() for v in vectors[first]], pa.binary()),
                 pa.array((vectors[first] ** 2).sum(axis=1)), pa.array([g[:keep_ids].tolist() for g in own], pa.list_(pa.int64())),
                 pa.array([bool((g % every == 0).any()) for g in own], pa.bool_())],
                names=["vkey", "vec", "norm2", "ids", "is_query"])

    parts = rows.select("vec_id", "vec", "vkey").mapInArrow(
        combine, "vkey string, vec binary, norm2 double, ids array<long>, is_query boolean")
    few = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep_ids)
    return parts.groupBy("vkey").agg(F.first("vec").alias("vec"), F.first("norm2").alias("norm2"), few.alias("ids"),
                                     F.max("is_query").alias("is_query"))


def unpack(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype="<f8").reshape(len(packed), -1)


class Projection:
    """Points (with the equalising coordinate) and queries (without) in the projected space."""

    def __init__(self, size: int, top_norm2: float, dimensions: int, seed: int):
        self.matrix = np.random.default_rng(seed).standard_normal((size + 1, dimensions))
        self.top = top_norm2

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - (x ** 2).sum(axis=1), 0.0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.matrix[:-1]


# --- kd-tree -----------------------------------------------------------------

class UpperTree:
    """The levels above the blocks: splits by position (children 2 i + 1 and 2 i + 2), and each block's box."""

    def __init__(self, sample: np.ndarray, depth: int):
        dims = sample.shape[1]
        self.depth = depth
        self.dim = np.zeros(2 ** depth - 1, dtype=np.int64)
        self.cut = np.zeros(2 ** depth - 1)
        self.low = np.full((2 ** depth, dims), -np.inf)
        self.high = np.full((2 ** depth, dims), np.inf)

        def split(node: int, level: int, part: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            if level == depth:
                self.low[node - (2 ** depth - 1)], self.high[node - (2 ** depth - 1)] = lo, hi
                return
            j = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if len(part) else 0
            cut = float(np.median(part[:, j])) if len(part) else 0.0
            self.dim[node], self.cut[node] = j, cut
            left = part[:, j] <= cut
            hi_left, lo_right = hi.copy(), lo.copy()
            hi_left[j] = lo_right[j] = cut
            split(2 * node + 1, level + 1, part[left], lo, hi_left)
            split(2 * node + 2, level + 1, part[~left], lo_right, hi)

        split(0, 0, sample, np.full(dims, -np.inf), np.full(dims, np.inf))

    def block(self, y: np.ndarray) -> np.ndarray:
        at = np.zeros(len(y), dtype=np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (y[np.arange(len(y)), self.dim[at]] > self.cut[at])
        return at - (2 ** self.depth - 1)

    def near(self, y: np.ndarray, reach2: float) -> np.ndarray:
        """Blocks whose box comes within sqrt(reach2) of the point."""
        gap = np.maximum(np.maximum(self.low - y, y - self.high), 0.0)
        return np.flatnonzero((gap ** 2).sum(axis=1) <= reach2)


class BlockTree:
    """kd-tree leaves of one block's projected points, with the points' vectors in leaf order."""

    def __init__(self, x: np.ndarray, y: np.ndarray, names: np.ndarray):
        """``names``: each point's smallest id, which breaks ties."""
        parts, leaves = [np.arange(len(y))], []
        while parts:
            p = parts.pop()
            if len(p) <= LEAF:
                leaves.append(p)
                continue
            j = int(np.argmax(y[p].max(axis=0) - y[p].min(axis=0)))
            order = p[np.argsort(y[p, j], kind="stable")]
            parts += [order[:len(p) // 2], order[len(p) // 2:]]
        self.row = np.concatenate(leaves)          # point at each place of the leaf order
        self.x, self.names = x[self.row], names[self.row]
        self.start = np.cumsum([0] + [len(p) for p in leaves])
        self.low = np.array([y[p].min(axis=0) for p in leaves])
        self.high = np.array([y[p].max(axis=0) for p in leaves])

    def _top(self, scores: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of each row by score; where the k-th is tied, by the smaller name."""
        if scores.shape[1] <= k:
            return scores, places
        pick = np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]
        best = np.take_along_axis(scores, pick, axis=1)
        least = best.min(axis=1)
        for r in np.flatnonzero(((scores >= least[:, None]).sum(axis=1) > k) & (least > -np.inf)):
            tied = np.flatnonzero(scores[r] >= least[r])
            pick[r] = tied[np.lexsort((self.names[places[r, tied]], -scores[r, tied]))[:k]]
        return np.take_along_axis(scores, pick, axis=1), np.take_along_axis(places, pick, axis=1)

    def search(self, queries: np.ndarray, at: np.ndarray, k: int, bounds: np.ndarray, quantile: float, norms: np.ndarray) -> list:
        """Per query the (rows, scores) of its k best found.  ``bounds``: k-th scores known already; ``norms``:
        squared norms of query and points together, so squared distance = norms - 2 * score.

        All queries advance together: each takes its next leaves by projected distance, and a leaf is verified for
        the queries that reach it in one product, until the test holds for every query's next leaf.
        """
        gap = np.maximum(self.low[None] - at[:, None], at[:, None] - self.high[None])
        near = (np.maximum(gap, 0.0) ** 2).sum(axis=2)
        order = np.argsort(near, axis=1, kind="stable")
        n, leaves = near.shape
        best, place = np.full((n, 0), -np.inf), np.zeros((n, 0), dtype=np.int64)
        bounds, active, i, step = bounds.copy(), np.arange(n), 0, 4
        while i < leaves and len(active):
            with np.errstate(invalid="ignore"):
                reach = np.where(bounds > -np.inf, quantile * np.maximum(norms - 2 * bounds, 0.0), np.inf)
            chunk = order[active, i:i + step]
            due = near[active[:, None], chunk] <= reach[active, None]
            keep = due[:, 0]  # for the others the chi-square test holds for all that is left
            active, chunk, due = active[keep], chunk[keep], due[keep]
            if not len(active):
                break
            width = chunk.shape[1]
            scores = np.full((len(active), width, LEAF), -np.inf)
            places = np.zeros((len(active), width, LEAF), dtype=np.int64)
            rows, cols = np.nonzero(due)
            which = chunk[rows, cols]
            by_leaf = np.argsort(which, kind="stable")
            cuts = np.flatnonzero(np.diff(which[by_leaf])) + 1
            for group in np.split(by_leaf, cuts):
                leaf = which[group[0]]
                lo, hi = self.start[leaf], self.start[leaf + 1]
                r, c = rows[group], cols[group]
                scores[r, c, :hi - lo] = queries[active[r]] @ self.x[lo:hi].T
                places[r, c, :hi - lo] = np.arange(lo, hi)
            if best.shape[1] < k:
                grow = k - best.shape[1]
                best = np.hstack([best, np.full((n, grow), -np.inf)])
                place = np.hstack([place, np.zeros((n, grow), dtype=np.int64)])
            top, where = self._top(np.hstack([best[active], scores.reshape(len(active), -1)]),
                                   np.hstack([place[active], places.reshape(len(active), -1)]), k)
            best[active], place[active] = top, where
            bounds[active] = np.maximum(bounds[active], top.min(axis=1))
            i, step = i + step, step * 2
        out = []
        for q, found, p in zip(queries, best, place):
            p = p[found > -np.inf]
            out.append((self.row[p], (self.x[p] * q).sum(axis=1)))  # the score itself: one way for every point
        return out


# --- Spark operator ----------------------------------------------------------

FOUND = "qkey string, ids array<long>, scores array<double>"


def nearest(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20,
            dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, seed: int = 7) -> DataFrame:
    """The ``k`` nearest rows found for each row whose id is divisible by ``every``:
    query_id, rank (from 1), vec_id, score."""
    spark = rows.sparkSession
    ship_package(spark)
    fine = valid_vectors(rows, id_col, vec_col)
    points = cut_lineage(distinct_vectors(fine, k + 1, every))
    facts = points.agg(F.count("*").alias("n"), F.max("norm2").alias("top"), F.max(F.octet_length("vec")).alias("bytes")).first()
    n, size = facts["n"], (facts["bytes"] or 8) // 8
    projection = Projection(size, facts["top"] or 0.0, dimensions, seed)
    quantile = chi_square_quantile(confidence, dimensions)
    depth = max(0, -(-n // BLOCK_ROWS) - 1).bit_length()
    thin = max(1, -(-n // SAMPLE_ROWS))
    sample = [r["vec"] for r in points.where(F.pmod(F.xxhash64("vkey"), F.lit(thin)) == 0).select("vec").collect()]  # about SAMPLE_ROWS
    upper = UpperTree(projection.points(unpack(sample)) if sample else np.zeros((0, dimensions)), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = upper.block(projection.points(unpack(batch.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(blocks), *batch.columns], names=["block", "vkey", "vec", "ids", "is_query"])

    placed = cut_lineage(points.select("vkey", "vec", "ids", "is_query").mapInArrow(
        place, "block long, vkey string, vec binary, ids array<long>, is_query boolean"))

    def best(ids: list, rows_: np.ndarray, scores: np.ndarray) -> tuple[list, list]:
        """Ids and scores of the k + 1 best, copies spread out."""
        every_id = np.concatenate([ids[r] for r in rows_]) if len(rows_) else np.zeros(0, dtype=np.int64)
        every_score = np.repeat(scores, [len(ids[r]) for r in rows_]) if len(rows_) else np.zeros(0)
        order = np.lexsort((every_id, -every_score))[:k + 1]
        return every_id[order].tolist(), every_score[order].tolist()

    def search(data: pd.DataFrame, keys, queries: np.ndarray, bounds: np.ndarray):
        """(qkey, ids, scores, the query's projection, norms) for each query over one block."""
        x, ids = unpack(data["vec"].tolist()), data["ids"].tolist()
        tree = BlockTree(x, projection.points(x), np.array([i[0] for i in ids]))
        at = projection.queries(queries)
        norms = (queries ** 2).sum(axis=1) + projection.top
        for i in range(0, len(queries), QUERY_BATCH):
            part = slice(i, i + QUERY_BATCH)
            found = tree.search(queries[part], at[part], k + 1, bounds[part], quantile, norms[part])
            for key, (rows_, scores), y, norm in zip(keys[part], found, at[part], norms[part]):
                yield key, *best(ids, rows_, scores), y, float(norm)

    def home(data: pd.DataFrame) -> pd.DataFrame:
        """Searches of the block's own queries, and the further blocks each has to see."""
        block = data["block"].iloc[0]
        mine = data[data["is_query"]]
        out = []
        if len(mine):
            queries = unpack(mine["vec"].tolist())
            found = search(data, mine["vkey"].tolist(), queries, np.full(len(mine), -np.inf))
            for (key, ids, scores, y, norms), vec in zip(found, mine["vec"]):
                bound = scores[k] if len(scores) > k else -np.inf
                reach = quantile * max(norms - 2 * bound, 0.0) if bound > -np.inf else np.inf
                others = [int(b) for b in upper.near(y, reach) if b != block]
                out.append((key, ids, scores, vec, float(bound), others))
        return pd.DataFrame(out, columns=["qkey", "ids", "scores", "qvec", "bound", "others"])

    first = cut_lineage(placed.groupBy("block").applyInPandas(
        home, FOUND + ", qvec binary, bound double, others array<long>"))
    routed = first.select("qkey", "qvec", "bound", F.explode("others").alias("block"))
    units = routed.groupBy("block").agg(F.ceil(F.count("*") / UNIT_QUERIES).alias("units"))
    asked = routed.join(units, "block").withColumn("unit", F.pmod(F.xxhash64("qkey"), "units")).drop("units")
    held = placed.join(units, "block").select("block", "vec", "ids", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"))

    def visit(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(queries):
            found = search(data, queries["qkey"].tolist(), unpack(queries["qvec"].tolist()), queries["bound"].to_numpy())
            out = [(key, ids, scores) for key, ids, scores, _, _ in found if ids]
        return pd.DataFrame(out, columns=["qkey", "ids", "scores"])

    away = held.groupBy("block", "unit").cogroup(asked.groupBy("block", "unit")).applyInPandas(visit, FOUND)
    pairs = F.arrays_zip("scores", "ids")
    merged = first.select("qkey", pairs.alias("p")).unionByName(away.select("qkey", pairs.alias("p")))
    merged = merged.groupBy("qkey").agg(F.flatten(F.collect_list("p")).alias("p"))  # at most k + 1 of each block visited
    nearest_first = F.array_sort(F.transform("p", lambda x: F.struct((-x["scores"]).alias("far"), x["ids"].alias("id"))))
    merged = merged.select("qkey", F.slice(nearest_first, 1, k + 1).alias("p"))
    queries = fine.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vkey").alias("qkey")).distinct()
    others = F.slice(F.filter("p", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = queries.join(merged, "qkey").select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))
