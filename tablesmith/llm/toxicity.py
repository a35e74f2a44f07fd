"""Toxicity by compression distance (operator 7).

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  A window of the
text is compressed with each; its gain is the length under the ordinary dictionary less the
length under the toxic one.  A window is one word behind a carrier that both dictionaries hold, as
zstandard only compresses a block that has something to refer to, and an insult is one word.
Equal windows have equal gains, so each distinct one is compressed once per worker.

A dictionary is zstandard's own training result on the documents' windows, followed by the windows that
recur most.  For the toxic one, windows that ordinary text also holds are left out first, and
training documents that mostly repeat another one count once, so that copied prose does not pass for toxic.

A document's score is a logistic function of how many of its windows reach each gain threshold,
calibrated on labelled documents that the dictionaries have not seen.

Rules: a null or empty text has no windows (its score comes from the intercept); labels that are null are
ignored, of repeated labels the larger counts; without labels of both kinds every score is the
share of toxic labels (0.5 without any); every input row gives one row; whole texts are scored.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.base import ship_package, slices, text_of
from tablesmith.llm.bpe import CHUNK_CHARS, PieceCache, safe_parts

#: Labelled documents per class that train the dictionaries, and the longest text among them (collected to the driver).
TRAIN_DOCS = 1500
TRAIN_CHARS = 10_000
#: Labelled documents that calibrate the score (only their counts are collected).
CALIBRATE_DOCS = 8_000
LEVEL = 13
THRESHOLDS = (4, 5, 6, 7)
CARRIER = b"<|window|window|window|window|> "
MARK = b"\x01\x02\x03"
EDGES = b".,;:!?\"'()[]"


# --- dictionaries ------------------------------------------------------------

def windows(text: str) -> list[bytes]:
    return [w.strip(EDGES) for w in text.lower().encode("utf-8").split()]


def _sample(words: set[bytes]) -> bytes:
    """Distinct windows of a document in hashed order, so that only windows recur, not their neighbours."""
    return b" " + b" ".join(sorted(words, key=lambda w: (zlib.crc32(w), w))) + b" "


def _dictionary(samples: list[bytes], size: int, recurring: list[bytes]) -> bytes:
    """zstandard's trained dictionary (where there is enough to train on) and the recurring windows, best last."""
    import zstandard
    trained = b""
    if len(samples) >= 8 and sum(map(len, samples)) > 8 * size:
        try:
            trained = zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
        except zstandard.ZstdError:  # nothing recurs in the samples
            trained = b""
    return trained + b"".join(MARK + w + b" " for w in recurring) + CARRIER


def train_dictionaries(toxic: list[str], ordinary: list[str], size: int = 1024, frequent: int = 400) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries from two lists of texts."""
    plain = [set(windows(t)) for t in ordinary]
    common = Counter(w for s in plain for w in s)
    seen, rest = set(), []
    for words in (set(windows(t)) for t in toxic):
        own = {w for w in words if w and w not in common}
        if len(own) > 8 and len(own & seen) > 0.35 * len(own):
            continue  # mostly another document's words
        rest.append(own)
        seen |= own
    counts = Counter(w for s in rest for w in s)
    least = max(3, len(rest) // 60)
    marked = sorted((n, w) for w, n in counts.items() if n >= least)
    kept = {w for _, w in marked}
    samples = [_sample(s & kept) for s in rest if s & kept]
    usual = [w for w, _ in common.most_common(frequent)][::-1]
    return (_dictionary([_sample(s) for s in plain], 2 * size, usual),
            _dictionary(samples, size, [w for _, w in marked]))


class Gains:
    """Gain of each window, by the two dictionaries; distinct windows are compressed once."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        def compressor(content: bytes):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False,
                                            write_content_size=False, write_dict_id=False).compress
        self.plain, self.toxic = compressor(ordinary), compressor(toxic)
        self.cache = PieceCache(self._gain)

    def _gain(self, word: bytes) -> int:
        window = CARRIER + MARK + word.strip(EDGES) + b" "
        return len(self.plain(window)) - len(self.toxic(window))

    def counts(self, text: str) -> np.ndarray:
        """Windows, windows that reach each threshold, and the largest gain."""
        self.cache.turn()
        out = np.zeros(len(THRESHOLDS) + 2)
        for part in safe_parts(text):
            words = part.lower().encode("utf-8").split()
            if not words:
                continue
            gains = np.fromiter(map(self.cache.__getitem__, words), dtype=np.int32, count=len(words))
            out[0] += len(words)
            out[1:-1] += [np.count_nonzero(gains >= t) for t in THRESHOLDS]
            out[-1] = max(out[-1], gains.max())
        return out


@functools.lru_cache(maxsize=2)
def _gains(ordinary: bytes, toxic: bytes) -> Gains:
    return Gains(ordinary, toxic)


# --- calibration -------------------------------------------------------------

def features(counts: np.ndarray) -> np.ndarray:
    """Share of windows at each threshold (log), whether any is, and the largest gain."""
    share = counts[:, 1:-1] / np.maximum(counts[:, :1], 1)
    return np.hstack([np.log1p(200 * share), np.minimum(counts[:, 1:-1], 3), np.clip(counts[:, -1:], 0, 10)])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> dict:
    """Weighted logistic regression by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    penalty = ridge * np.append(np.ones(x.shape[1]), 0.0) * weight.sum() / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty * beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "beta": beta}


def logistic(model: dict, x: np.ndarray) -> np.ndarray:
    z = (x - model["mean"]) / model["scale"] @ model["beta"][:-1] + model["beta"][-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# --- Spark operators ---------------------------------------------------------

def fold(buckets: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``buckets`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % buckets


def labelled(labels: DataFrame, column: str, train: Column) -> DataFrame:
    """(doc_id, label) of the training fold, one row per document."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & train)
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))


def thinned(known: DataFrame, counts: dict[int, int], most: int, salt: str) -> DataFrame:
    """About ``most`` rows of each label, by hash of the id (all of them, if there are fewer)."""
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, min(1.0, most / max(n, 1))).otherwise(share)
    return known.where(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))


def _counts(docs: DataFrame, dictionaries: tuple[bytes, bytes], keep: list[str]) -> DataFrame:
    ship_package(docs.sparkSession)
    src = docs.select(*keep, text_of().alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = _gains(*dictionaries)
        for batch in batches:
            found = [gains.counts(x.as_py()).tolist() for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "counts"])

    schema = ", ".join(f"`{c}` {t}" for c, t in src.dtypes[:-1]) + ", counts array<double>"
    return src.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, train_fold: Column, column: str = "toxic") -> bytes:
    """The model: dictionaries and calibration, pickled.  ``train_fold`` selects label rows by doc_id."""
    known = labelled(labels, column, train_fold)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        total = sum(sizes.values())
        return pickle.dumps({"constant": sizes.get(1, 0) / total if total else 0.5})
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    first = thinned(known, sizes, TRAIN_DOCS, "dictionary").withColumn("half", half)
    # of a longer text a window of TRAIN_CHARS, at a place that its id decides
    over = F.greatest(F.lit(0), F.length("text") - TRAIN_CHARS)
    window = F.substr("text", (F.pmod(F.xxhash64(F.lit("window"), "doc_id"), over + 1) + 1).cast("int"), F.lit(TRAIN_CHARS))
    rows = (texts.join(F.broadcast(first), "doc_id")
            .select("doc_id", window.alias("text"), "label", "half").collect())  # about 2 * TRAIN_DOCS rows
    rows = sorted((r["doc_id"], r["text"], r["label"], r["half"]) for r in rows)

    def fitted(halves: tuple[int, ...]) -> tuple[bytes, bytes]:
        return train_dictionaries(*([t for _, t, k, h in rows if k == kind and h in halves] for kind in (1, 0)))

    # Calibrated on the half that the dictionaries have not seen; then dictionaries of both halves serve.
    dictionaries = fitted((0,))
    second = thinned(known.where(half == 1), {k: n // 2 for k, n in sizes.items()}, CALIBRATE_DOCS // 2, "calibrate")
    held = texts.join(F.broadcast(second), "doc_id")  # about CALIBRATE_DOCS ids
    found = _counts(held, dictionaries, ["doc_id", "label"]).select("doc_id", "label", "counts").collect()
    found = sorted((r["doc_id"], r["label"], r["counts"]) for r in found)
    y = np.array([k for _, k, _ in found], dtype=float)
    if not 0 < y.sum() < len(y):
        return pickle.dumps({"constant": sizes[1] / (sizes[0] + sizes[1])})
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (len(y) - y.sum()))
    model = fit_logistic(features(np.array([c for _, _, c in found])), y, weight / weight.mean())
    return pickle.dumps({"dictionaries": fitted((0, 1)), "logistic": model})


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and score (0 to 1) of every document; one Arrow pass over the texts."""
    ship_package(docs.sparkSession)
    src = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model)
        for batch in batches:
            lengths = batch.column(1)
            for lo, hi in slices(batch, [len(x.as_buffer()) for x in lengths], CHUNK_CHARS):
                texts = lengths.slice(lo, hi - lo).to_pylist()
                if "constant" in m:
                    values = np.full(len(texts), m["constant"])
                else:
                    gains = _gains(*m["dictionaries"])
                    values = logistic(m["logistic"], features(np.array([gains.counts(t) for t in texts])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(values)],
                                                 names=["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def predictions(docs: DataFrame, labels: DataFrame, buckets: int = 3, held: int = 1, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of the held-out fold are never read."""
    model = train(docs, labels, fold(buckets) != held)
    return score(docs, model).select(
        "doc_id", (fold(buckets) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
