"""Ranked lexical search over bit-sliced Bloom signatures (operator 11).

Index: documents of like vocabulary size form blocks.  A block keeps one Bloom filter per
document, stored by slices: slice r is the bitmap of all documents whose filter has bit r.
A term is entered once for each power of two up to its count, so the AND of a term's slices
at level l holds every document with at least 2^l occurrences, and perhaps a few more.
Beside the slices stand the block's dictionary and the exact counts.

Search: a level's bitmap times the most that such a count can add to the score (at the
block's shortest length), summed over an item's terms, bounds every document's score from
above.  Documents whose bound stays below an item's known k-th best score cannot be among
its k best; all others are scored exactly from the counts.  The known score comes from one
block in ``SEED_PART`` first, then from what a task has seen; it only saves work, results do
not depend on it.  Items are taken in blocks of bounded size, each against all documents.

Score (64-bit integers, div rounds down): sum over the item's terms, repeats included, of
w * ((10^9 tf) div (1000 tf + 12 m)), w = floor(1000 ln((2 N + 2) / (2 df + 1))),
m = 75 + (25 n N) div L.

Rules: a null text has no terms; documents without a term do not count and never appear;
rows are documents of their own, and so are items, whatever their ids; equal scores go by
doc_id, null last; items without terms or hits give no rows.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.base import ship_package, slices, text_of
from tablesmith.session import ensure_checkpoint_dir

#: Bytes that part terms become spaces, A-Z become a-z, all others stay (UTF-8 bytes of other characters included).
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

LEVELS = 4             # a term's entries: counts of at least 1, 2, 4 and 8
HASHES = 3             # slices of an entry
BITS = 8               # slices per entry of the block's richest document
BLOCK_DOCS = 512       # documents of a block
BLOCK_CELLS = 1 << 21  # slices times documents of a block; a richer document is a block of its own
CHUNK_BYTES = 1 << 22  # texts that are split at once; a longer one is taken in parts
ROW_GROUP = 1 << 23    # bytes of a row group of the index: what a reader holds at once
SEED_PART = 16         # one block in so many gives the first known scores
ITEM_BLOCK = 1000      # items searched together,
ITEM_BYTES = 1 << 18   # or so many bytes of their texts

INDEX = ("seed boolean, docs int, width int, max_tf int, doc_ids array<bigint>, sizes binary, terms binary, dfs binary, "
         "offsets binary, codes binary, tfs binary, slices binary")


def terms_of(text: str) -> list[bytes]:
    """Terms in order: maximal runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased."""
    return text.encode().translate(FOLD).split()


# --- index ---------------------------------------------------------------------

def _hashes(terms: Sequence[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest
    return np.fromiter((xxh64_intdigest(t, 11) for t in terms), dtype=np.uint64, count=len(terms))


def slice_rows(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """Slices of each term's entry at a level, shape (terms, HASHES)."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2 ** 64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(width)).astype(np.int64)


def _counts(texts: Sequence[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dictionary, then per (text, term): text number, term number, count; and each text's number of terms."""
    if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
        found: Counter[bytes] = Counter()
        text, at = texts[0], 0
        while at < len(text):
            cut = min(at + CHUNK_BYTES, len(text))
            while cut < len(text) and not (text[cut].isascii() and not text[cut].isalnum()):
                cut += 1
            found.update(terms_of(text[at:cut]))
            at = cut
        tf = np.fromiter(found.values(), dtype=np.int64, count=len(found))
        return list(found), np.zeros(len(tf), dtype=np.int64), np.arange(len(tf)), tf, np.array([tf.sum()])
    lists = [terms_of(t) for t in texts]
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    coded = pa.array([t for x in lists for t in x], pa.large_binary()).dictionary_encode()
    dictionary = coded.dictionary.to_pylist()
    key = np.repeat(np.arange(len(lists)), sizes) * len(dictionary) + coded.indices.to_numpy(zero_copy_only=False)
    key, tf = np.unique(key, return_counts=True)
    text, term = np.divmod(key, max(1, len(dictionary)))
    return dictionary, text, term, tf, sizes


def _block(ids: list, sizes: np.ndarray, dictionary: list[bytes], hashes: np.ndarray, owner: np.ndarray, code: np.ndarray,
           tf: np.ndarray, width: int) -> dict:
    """One row of the index; ``owner`` numbers the block's documents."""
    n = len(ids)
    used, code = np.unique(code, return_inverse=True)
    cells = np.zeros((width, n), dtype=bool)
    for level in range(LEVELS):
        has = np.flatnonzero(tf >> level)
        rows = slice_rows(hashes[used], level, width)[code[has]]
        cells[rows, owner[has, None]] = True
    return {"docs": n, "width": width, "max_tf": int(tf.max()), "doc_ids": ids, "sizes": sizes.astype("<i8").tobytes(),
            "terms": b" ".join(dictionary[i] for i in used.tolist()),
            "dfs": np.bincount(code, minlength=len(used)).astype("<i4").tobytes(),
            "offsets": np.searchsorted(owner, np.arange(n + 1)).astype("<i8").tobytes(),
            "codes": code.astype("<i4").tobytes(), "tfs": tf.astype("<i4").tobytes(),
            "slices": np.packbits(cells, axis=1, bitorder="little").tobytes()}


def _blocks(ids: list, texts: Sequence[str]) -> Iterator[dict]:
    """Blocks of a chunk's documents, those of like numbers of entries together."""
    dictionary, text, term, tf, sizes = _counts(texts)
    if not len(tf):
        return
    hashes = _hashes(dictionary)
    entries = np.bincount(text, weights=np.minimum(np.frexp(tf)[1], LEVELS), minlength=len(texts)).astype(np.int64)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    order = np.argsort(entries, kind="stable")
    order = order[entries[order] > 0]
    band = np.frexp(entries[order])[1]
    at = 0
    while at < len(order):
        stop = at + 1
        while (stop < len(order) and band[stop] == band[at] and stop - at < BLOCK_DOCS
               and BITS * entries[order[stop]] * (stop + 1 - at) <= BLOCK_CELLS):
            stop += 1
        docs = order[at:stop]
        where = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
        owner = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
        yield _block([ids[d] for d in docs], sizes[docs], dictionary, hashes, owner, term[where], tf[where],
                     int(BITS * entries[docs[-1]]))
        at = stop


def build_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """The signature index of a documents table: one row per block, written to the shared folder.  No shuffle."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(None, pc.binary_length(batch.column(1)).to_pylist(), CHUNK_BYTES):
                ids, texts = (c.slice(lo, hi - lo).to_pylist() for c in batch.columns)
                for block in _blocks(ids, texts):
                    # Which blocks are searched first only decides how soon scores are known.
                    block = {"seed": zlib.crc32(block["terms"]) % SEED_PART == 0} | block
                    yield pa.RecordBatch.from_pylist([block], schema=INDEX_ARROW)

    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/tablesmith-tables/{uuid.uuid4().hex}"
    src.mapInArrow(run, INDEX).write.partitionBy("seed").option("parquet.block.size", ROW_GROUP).parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


INDEX_ARROW = pa.schema([("seed", pa.bool_()), ("docs", pa.int32()), ("width", pa.int32()), ("max_tf", pa.int32()),
                         ("doc_ids", pa.list_(pa.int64())),
                         *((c, pa.binary()) for c in ("sizes", "terms", "dfs", "offsets", "codes", "tfs", "slices"))])


# --- search --------------------------------------------------------------------

class Items:
    """A block of items: their distinct terms, and per item term numbers with the item's counts."""

    def __init__(self, rows: Sequence[tuple[int | None, str]]):
        self.ids = [i for i, _ in rows]
        self.number: dict[bytes, int] = {}
        self.wanted = []
        for _, text in rows:
            counts = Counter(self.number.setdefault(t, len(self.number)) for t in terms_of(text))
            self.wanted.append((np.fromiter(counts, dtype=np.int64, count=len(counts)),
                                np.fromiter(counts.values(), dtype=np.int64, count=len(counts))))
        self.hashes = _hashes(list(self.number))


def _document_counts(index: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each of the items' terms: one aggregate over dictionaries and sizes."""
    shared = index.sparkSession.sparkContext.broadcast(items.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        total = np.zeros(len(number) + 2, dtype=np.int64)
        for batch in batches:
            for terms, dfs, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.frombuffer(sizes, "<i8")
                total[-2:] += (len(n), n.sum())
                at = np.fromiter((number.get(t, -1) for t in terms.split(b" ")), dtype=np.int64)
                known = at >= 0
                total[at[known]] += np.frombuffer(dfs, "<i4")[known]
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    sums = index.select("terms", "dfs", "sizes").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    out = np.zeros(len(items.number) + 2, dtype=np.int64)
    for r in sums.collect():  # at most one row per term of a bounded block of items
        out[r.k] = r.n
    return int(out[-2]), int(out[-1]), out[:-2]


def added(tf: np.ndarray | int, m: np.ndarray | int):
    """What a count adds to the score per unit of weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Searcher:
    """Scores blocks of the index for a block of items; keeps the best ``k`` of each."""

    def __init__(self, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, k: int, known: np.ndarray):
        self.items, self.weight, self.n_docs, self.n_terms, self.k = items, weight, n_docs, n_terms, k
        self.known = known.copy()  # a document that scores less is not among the k best
        self.best: list[list[tuple]] = [[] for _ in items.ids]
        self.scored = self.seen = 0

    def bounds(self, block: dict, m: np.ndarray) -> np.ndarray:
        """Upper bound of each (item, document) score from the slices."""
        docs, width = block["docs"], block["width"]
        packed = np.frombuffer(block["slices"], np.uint8).reshape(width, -1)
        out = np.zeros((len(self.items.ids), docs))
        before = 0
        for level in range(LEVELS):
            if block["max_tf"] < 1 << level:
                break
            most = min(block["max_tf"], (2 << level) - 1) if level < LEVELS - 1 else block["max_tf"]
            now = int(added(most, int(m.min())))
            rows = slice_rows(self.items.hashes, level, width)
            bits = packed[rows[:, 0]]
            for j in range(1, HASHES):
                bits = bits & packed[rows[:, j]]
            held = bits.any(axis=1)  # terms that some document may hold
            gain = self.weight * float(now - before)
            for i, (terms, counts) in enumerate(self.items.wanted):
                at = np.flatnonzero(held[terms])
                for j in range(0, len(at), 4096):
                    t = terms[at[j:j + 4096]]
                    flags = np.unpackbits(bits[t], axis=1, count=docs, bitorder="little")
                    out[i] += (counts[at[j:j + 4096]] * gain[t]) @ flags
            before = now
        return np.ceil(out * (1 + 1e-9))  # sums of doubles: rounded up past their error

    def take(self, block: dict) -> None:
        """Score exactly what the bounds do not exclude."""
        docs = block["docs"]
        m = 75 + (25 * np.frombuffer(block["sizes"], "<i8") * self.n_docs) // self.n_terms
        bound = self.bounds(block, m)
        open_ = (bound >= self.known[:, None]) & (bound > 0)
        self.seen += open_.size
        self.scored += int(open_.sum())
        need = open_.any(axis=0)
        if not need.any():
            return
        number = self.items.number
        at = np.fromiter((number.get(t, -1) for t in block["terms"].split(b" ")), dtype=np.int64)
        code, tf = np.frombuffer(block["codes"], "<i4"), np.frombuffer(block["tfs"], "<i4").astype(np.int64)
        owner = np.repeat(np.arange(docs), np.diff(np.frombuffer(block["offsets"], "<i8")))
        use = np.flatnonzero((at[code] >= 0) & need[owner])
        use = use[np.argsort(at[code[use]], kind="stable")]
        term, doc = at[code[use]], owner[use]
        adds = self.weight[term] * added(tf[use], m[doc])
        start = np.searchsorted(term, np.arange(len(number) + 1))
        ids = block["doc_ids"]
        for i in np.flatnonzero(open_.any(axis=1)).tolist():
            total = np.zeros(docs, dtype=np.int64)
            for t, count in zip(*(x.tolist() for x in self.items.wanted[i])):
                lo, hi = start[t], start[t + 1]
                if lo < hi:  # a document stands once in a term's list
                    total[doc[lo:hi]] += count * adds[lo:hi]
            which = np.flatnonzero(open_[i])
            score = total[which]
            good = np.flatnonzero((score > 0) & (score >= self.known[i]))
            if not len(good):
                continue
            if len(good) > self.k:  # all that reach the k-th here, ties included
                good = good[score[good] >= np.partition(score[good], len(good) - self.k)[len(good) - self.k]]
            new = [(-int(score[j]), ids[which[j]] is None, ids[which[j]] or 0) for j in good.tolist()]
            self.best[i] = sorted(self.best[i] + new)[:self.k]
            if len(self.best[i]) == self.k:
                self.known[i] = max(self.known[i], -self.best[i][-1][0])


def _candidates(index: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, k: int, known: np.ndarray) -> DataFrame:
    """(item number, item_id, doc_id, score): each task's best ``k`` that reach the known scores."""
    shared = index.sparkSession.sparkContext.broadcast((items, weight, known))  # one bounded block of items
    names = ["docs", "width", "max_tf", "doc_ids", "sizes", "terms", "offsets", "codes", "tfs", "slices"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        what, w, start = shared.value
        searcher = Searcher(what, w, n_docs, n_terms, k, start)
        for batch in batches:
            for at in range(batch.num_rows):
                searcher.take(dict(zip(names, (c[at].as_py() for c in batch.columns))))
        rows = [(i, what.ids[i], None if missing else doc, -score)
                for i, best in enumerate(searcher.best) for score, missing, doc in best]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_no", "item_id", "doc_id", "score"])

    return index.select(*names).mapInArrow(run, "item_no long, item_id long, doc_id long, score long")


def _item_blocks(items: DataFrame, text: str) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of bounded size, one at a time on the driver."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("i"), text_of(text).alias("t")).toLocalIterator():
        if block and (len(block) == ITEM_BLOCK or size + len(r.t) > ITEM_BYTES):
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = 20, text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item with a score above 0."""
    spark = index.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablesmith-tables/{uuid.uuid4().hex}"
    schema = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = F.row_number().over(order).alias("rank")
    for rows in _item_blocks(items, text):
        block = Items(rows)
        n_docs, n_terms, df = _document_counts(index, block)
        if not n_terms or not block.number:
            continue
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        known = np.zeros(len(rows), dtype=np.int64)
        first = _candidates(index.where("seed"), block, weight, n_docs, n_terms, k, known)
        for r in first.select("*", ranked).where(F.col("rank") == k).collect():  # at most one row per item of the block
            known[r.item_no] = r.score
        best = _candidates(index, block, weight, n_docs, n_terms, k, known).select("*", ranked).where(F.col("rank") <= k)
        best.select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
