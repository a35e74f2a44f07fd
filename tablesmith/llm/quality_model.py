"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 8).

Every document becomes a short row of statistics of its whole text.  Trees are grown on a bounded
sample of labelled rows: features are cut into quantile bins, each level of a tree sums gradients
and hessians per (node, feature, bin) and takes the best split of every node.  A fitted
ensemble is flattened into arrays (feature, threshold and children by position, leaf values), and a
batch of documents walks all trees at once, one numpy step per level.

Rules: a null text is empty (all statistics zero); null labels are ignored, of repeated labels the larger
counts; without labels of both kinds every score is the share of good labels (0.5 without any); every input
row gives one row; whole texts are read, long ones in parts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.base import ship_package, slices, text_of
from tablesmith.llm.bpe import CHUNK_CHARS
from tablesmith.llm.toxicity import fold, labelled, thinned

#: Labelled documents per class that the trees are grown on (only their statistics are collected).
TRAIN_DOCS = 10_000

STATISTICS = ["log_chars", "log_words", "word_length", "word_spread", "unique_words", "top_word", "adjacent_repeats",
              "symbols", "punctuation", "exclamations", "digits", "upper", "non_ascii", "log_lines", "repeated_lines", "bars"]


# --- statistics --------------------------------------------------------------

def _byte_classes() -> np.ndarray:
    """One column per class of bytes: symbols, punctuation, '!', digits, A-Z, a-z, non-ASCII, '|', blanks."""
    groups = [b"#*$%&|<>@^~_=+\\{}", b".,;:?'\"()-", b"!", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)),
              bytes(range(128, 256)), b"|", b" \t\n\r\x0b\x0c"]
    out = np.zeros((256, len(groups)))
    for k, group in enumerate(groups):
        out[list(group), k] = 1
    return out


_CLASSES = _byte_classes()


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    data = text.encode("utf-8")
    words = data.split()
    n = len(words)
    if not n:
        return [np.log1p(len(data))] + [0.0] * (len(STATISTICS) - 1)
    totals = np.zeros(256, dtype=np.int64)
    octets = np.frombuffer(data, dtype=np.uint8)
    for i in range(0, len(octets), 1 << 22):
        totals += np.bincount(octets[i:i + (1 << 22)], minlength=256)
    symbols, punctuation, exclamations, digits, upper, lower, wide, bars, _ = (totals @ _CLASSES).tolist()
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = float(lengths.sum())
    return [np.log1p(len(data)), np.log1p(n), lengths.mean(), lengths.std(), len(counts) / n, max(counts.values()) / n,
            repeats / n, symbols / n, punctuation / n, exclamations / n, digits / chars, upper / max(1.0, upper + lower),
            wide / chars, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), bars / n]


# --- trees -------------------------------------------------------------------

@dataclass
class Trees:
    """Complete binary trees by position: children of i are 2 i + 1 and 2 i + 2; leaves follow the splits."""
    feature: np.ndarray    # trees x splits
    threshold: np.ndarray  # trees x splits; go right if the value is above it
    leaf: np.ndarray       # trees x leaves
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of all trees' leaves for each row: one step per level, all trees at once."""
        trees, splits = self.feature.shape
        at = np.zeros((len(x), trees), dtype=np.int64)
        column = np.arange(trees)
        row = np.arange(len(x))[:, None]
        while splits and at.min() < splits:
            f = self.feature[column, at]
            at = 2 * at + 1 + (x[row, f] > self.threshold[column, at])
        return self.base + self.leaf[column, at - splits].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64,
         rate: float = 0.15, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)  # bin > b: value above edge b
    n, k = x.shape
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    splits = 2 ** depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(splits, dtype=np.int64), np.full(splits, np.inf)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            local = node - first
            g, h = np.zeros((width, k, bins)), np.zeros((width, k, bins))
            for j in range(k):
                key = local * bins + binned[:, j]
                g[:, j] = np.bincount(key, grad, width * bins).reshape(width, bins)
                h[:, j] = np.bincount(key, hess, width * bins).reshape(width, bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
            for j in range(k):
                gain[:, j, len(edges[j]):] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for q in range(width):
                j, b = divmod(int(best[q]), bins)
                if gain[q, j, b] > 1e-9:
                    feature[first + q], threshold[first + q] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - splits
        leaf = -rate * np.bincount(at, grad, splits + 1) / (np.bincount(at, hess, splits + 1) + ridge)
        score += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


# --- Spark operators ---------------------------------------------------------

def _statistics(docs: DataFrame, keep: list[str], finish, column: str, kind: str) -> DataFrame:
    """Columns ``keep`` and one more: ``finish`` of the statistics matrix of a chunk of documents."""
    ship_package(docs.sparkSession)
    src = docs.select(*keep, text_of().alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(keep)
        for batch in batches:
            texts = batch.column(last)
            for lo, hi in slices(batch, [len(x.as_buffer()) for x in texts], CHUNK_CHARS):
                x = np.array([statistics(t) for t in texts.slice(lo, hi - lo).to_pylist()])
                rest = [c.slice(lo, hi - lo) for c in batch.columns[:last]]
                yield pa.RecordBatch.from_arrays([*rest, finish(x)], names=[*keep, column])

    return src.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in src.dtypes[:-1]) + f", {column} {kind}")


def train(docs: DataFrame, labels: DataFrame, train_fold, column: str = "quality") -> bytes:
    """The model, pickled: trees, or a constant if the labels are all alike."""
    known = labelled(labels, column, train_fold)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not sizes.get(0) or not sizes.get(1):
        return pickle.dumps(sizes.get(1, 0) / total if total else 0.5)
    chosen = thinned(known, sizes, TRAIN_DOCS, "trees")  # about 2 * TRAIN_DOCS ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = _statistics(rows, ["doc_id", "label"], lambda x: pa.array(x.tolist(), pa.list_(pa.float64())),
                        "x", "array<double>").collect()
    found = sorted((r["doc_id"], r["label"], r["x"]) for r in found)
    y = np.array([k for _, k, _ in found], dtype=float)
    if not 0 < y.sum() < len(y):
        return pickle.dumps(sizes[1] / total)
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (len(y) - y.sum()))
    return pickle.dumps(grow(np.array([x for _, _, x in found]), y, weight / weight.mean()))


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every document; one Arrow pass over the texts."""
    def finish(x: np.ndarray) -> pa.Array:
        m = pickle.loads(model)
        return pa.array(m.probability(x) if isinstance(m, Trees) else np.full(len(x), m))

    return _statistics(docs, ["doc_id"], finish, "score", "double")


def predictions(docs: DataFrame, labels: DataFrame, buckets: int = 5, held: int = 0, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of the held-out fold are never read."""
    model = train(docs, labels, fold(buckets) != held)
    return score(docs, model).select(
        "doc_id", (fold(buckets) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
