"""Periodic runs of words by recompression (operator 12).

A run is a maximal stretch of words with smallest period q and at least max(6, 4 q)
words.  Texts become numbers, one per distinct word; many texts are laid end to end
with a number of its own after each, and the whole is recompressed: block compression
replaces repeats of one symbol by one symbol, pair compression replaces neighbours
whose symbols fall into the left and the right half of a partition.  Both are decided
by the symbols alone, so equal stretches are parsed alike but at their ends.

The longest common extension of two positions climbs that grammar while both stand at a
symbol's border, takes at most one step a level, and descends at the first difference:
two or three comparisons a level, for all queried pairs at once.

A run of period p and at least 4 p words holds some multiple i of 3 p together with
i + p.  So for each p the pairs (i, i + p) on that grid are candidates where four words
in a row, p apart, agree; the extensions to both sides give the run's exact ends.  A run found for a
multiple of its period has the same ends; the smallest period stays.

Rules: a null text has no words; every input row gives one output row (repeated rows and
null ids included); texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablesmith.llm.base import ship_package, slices, text_of

MIN_WORDS, MIN_EXPONENT = 6, 4
#: Texts are worked on together up to about so many bytes; a longer one is alone.
BATCH_BYTES = 1 << 20
#: So many pairs of the grid are extended at once.
GRID_PAIRS = 1 << 20


# --- the grammar ---------------------------------------------------------------

class Level:
    """One sequence of symbols; each symbol of the next level stands for one or more neighbours of this one."""

    __slots__ = ("symbol", "width", "parent", "opens", "closes", "first", "last", "ahead", "behind")

    def __init__(self, symbol: np.ndarray, width: np.ndarray):
        self.symbol, self.width = symbol, width
        self.first = self.last = None  # the children in the level below
        self.ahead = self.behind = None  # symbols up to the block's end and since its start, below a block step

    def grouped(self, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Note the groups that start where ``opens``; their first and last places."""
        self.opens = opens
        self.closes = np.append(opens[1:], True)
        self.parent = np.cumsum(opens, dtype=np.int32) - 1
        return np.flatnonzero(opens).astype(np.int32), np.flatnonzero(self.closes).astype(np.int32)


def _half(symbol: np.ndarray, salt: int) -> np.ndarray:
    """Left or right half of each symbol, a mixed bit of its number and the level's."""
    x = (symbol.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(60)) & np.uint64(1) == 1


def _above(level: Level, first: np.ndarray, last: np.ndarray, key: np.ndarray) -> Level:
    """The next level: groups with the same key are the same symbol."""
    _, symbol = np.unique(key, return_inverse=True)
    ends = np.cumsum(level.width)
    up = Level(symbol.astype(np.int32), (ends[last] - ends[first] + level.width[first]).astype(np.int32))
    up.first, up.last = first, last
    return up


def grammar(symbol: np.ndarray) -> list[Level]:
    """Levels of the run-length grammar, until no symbol occurs twice: then no two places can be equal."""
    symbol = np.unique(symbol, return_inverse=True)[1].astype(np.int32)
    levels = [Level(symbol, np.ones(len(symbol), dtype=np.int32))]
    step, idle = 0, 0
    while True:
        level = levels[-1]
        s = level.symbol.astype(np.int64)
        n = len(s)
        if n < 2 or int(s.max()) == n - 1:
            return levels  # symbols are numbered without gaps
        step += 1
        opens = np.ones(n, dtype=bool)
        if step % 2:  # blocks
            opens[1:] = s[1:] != s[:-1]
            if opens.all():
                continue
            first, last = level.grouped(opens)
            size = last - first + 1
            at = np.arange(n, dtype=np.int32)
            level.ahead, level.behind = last[level.parent] - at + 1, at - first[level.parent] + 1
            key = s[first] * (int(size.max()) + 1) + size
        else:  # pairs: a left symbol, then a right one
            right = _half(level.symbol, step) if idle < 4 else s != s[0]  # the latter parts the first pair for sure
            opens[1:] = right[:-1] | ~right[1:]
            idle = idle + 1 if opens.all() else 0
            if idle:
                continue
            first, last = level.grouped(opens)
            key = s[first] * (int(s.max()) + 2) + np.where(last > first, s[last] + 1, 0)
        levels.append(_above(level, first, last, key))


def extensions(levels: Sequence[Level], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """Words that agree from places ``a`` and ``b`` on (``a < b``): to the right with them, or to the left with them.

    Both lists may hold places outside the sequence; those agree in nothing.
    """
    out = np.zeros(len(a), dtype=np.int64)
    step = 1 if forward else -1
    # Climb: pairs that still agree are kept in (index, x, y); those that differ wait at their level.
    index = np.flatnonzero((a >= 0) & (b < len(levels[0].symbol)))
    x, y = a[index].astype(np.int64), b[index].astype(np.int64)
    waiting: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in levels]
    for no, level in enumerate(levels):
        if not len(index):
            break
        same = level.symbol[x] == level.symbol[y]
        waiting[no].append((index[~same], x[~same], y[~same]))
        index, x, y = index[same], x[same], y[same]
        if no + 1 == len(levels) or not len(index):
            break  # at the top no symbol occurs twice
        border = level.opens if forward else level.closes
        aligned = border[x] & border[y]
        if not aligned.all():
            m = np.flatnonzero(~aligned)
            if level.ahead is None:  # inside a pair: one symbol on
                out[index[m]] += level.width[x[m]]
                x[m] += step
                y[m] += step
            else:  # inside a block: as far as the shorter rest
                rest = level.ahead if forward else level.behind
                rx, ry = rest[x[m]], rest[y[m]]
                n = np.minimum(rx, ry)
                out[index[m]] += level.width[x[m]].astype(np.int64) * n
                x[m] += step * n
                y[m] += step * n
            inside = (x >= 0) & (x < len(level.symbol)) & (y >= 0) & (y < len(level.symbol))
            if level.ahead is not None:  # the shorter block has ended, the longer one goes on
                stop = np.zeros(len(x), dtype=bool)
                stop[m[rx != ry]] = True
                stop &= inside
                waiting[no].append((index[stop], x[stop], y[stop]))
                inside &= ~stop
            index, x, y = index[inside], x[inside], y[inside]
        x, y = level.parent[x].astype(np.int64), level.parent[y].astype(np.int64)
    # Descend: two different symbols may still share the beginning (or end) of what they stand for.
    index, x, y = (np.zeros(0, dtype=np.int64) for _ in range(3))
    for no in range(len(levels) - 1, 0, -1):
        parts = [(index, x, y), *waiting[no]]
        index, x, y = (np.concatenate(p) for p in zip(*parts))
        if not len(index):
            continue
        level, below = levels[no], levels[no - 1]
        child = level.first if forward else level.last
        x, y = child[x].astype(np.int64), child[y].astype(np.int64)
        same = np.flatnonzero(below.symbol[x] == below.symbol[y])
        if len(same):
            n = 1
            if below.ahead is not None:
                rest = below.ahead if forward else below.behind
                n = np.minimum(rest[x[same]], rest[y[same]])
            out[index[same]] += below.width[x[same]].astype(np.int64) * n
            x[same] += step * n
            y[same] += step * n
            inside = (x >= 0) & (x < len(below.symbol)) & (y >= 0) & (y < len(below.symbol))
            index, x, y = index[inside], x[inside], y[inside]
    return out


# --- runs ------------------------------------------------------------------------

def grid_pairs(symbol: np.ndarray, p: int, stop: int) -> np.ndarray:
    """Places i on the grid of 3 p, below ``stop``, that a run of period p may hold together with i + p.

    Such a run holds at least four places i + j p in a row, j = 0 and 1 among them; they carry the same symbol.
    """
    i = np.flatnonzero(symbol[0:stop - p:3 * p] == symbol[p:stop:3 * p]) * (3 * p)
    if not len(i):
        return i

    def same(j: int) -> np.ndarray:
        a, b = i + j * p, i + (j + 1) * p
        inside = (a >= 0) & (b < stop)
        return inside & (symbol[np.where(inside, a, 0)] == symbol[np.where(inside, b, 0)])
    before, after = same(-1), same(1)
    return i[(before & after) | (before & same(-2)) | (after & same(2))]


def find_runs(symbol: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence, by start and period.

    ``symbol`` holds texts of ``lengths`` symbols, longest first, each followed by a symbol that occurs once.  The
    grammar is built over the texts that have candidates.
    """
    def periods(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Each period with the end of the texts that are long enough for it."""
        upto = np.cumsum(sizes + 1)
        for p in range(1, (int(sizes[0]) if len(sizes) else 0) // MIN_EXPONENT + 1):
            yield p, int(upto[np.searchsorted(-sizes, -MIN_EXPONENT * p, side="right") - 1])

    ends = np.cumsum(lengths + 1)
    hopeful = np.zeros(len(lengths), dtype=bool)
    for p, stop in periods(lengths):
        hopeful[np.searchsorted(ends, grid_pairs(symbol, p, stop), side="right")] = True
    if not hopeful.any():
        return (np.zeros(0, dtype=np.int64),) * 3
    kept = np.repeat(hopeful, lengths + 1)
    place = np.flatnonzero(kept)  # of each symbol that is left, its place in the whole
    symbol, lengths = symbol[kept], lengths[hopeful]
    levels = grammar(symbol)
    found = [np.zeros((0, 3), dtype=np.int64)]
    grid: list[tuple[np.ndarray, int]] = []

    def extend() -> None:
        i = np.concatenate([at for at, _ in grid])
        p = np.repeat(np.array([p for _, p in grid]), [len(at) for at, _ in grid])
        grid.clear()
        back = extensions(levels, i - 1, i + p - 1, forward=False)
        on = extensions(levels, i, i + p, forward=True)
        runs = np.stack([i - back, back + p + on, p], axis=1)
        found.append(np.unique(runs[runs[:, 1] >= np.maximum(MIN_WORDS, MIN_EXPONENT * p)], axis=0))

    held = 0
    for p, stop in periods(lengths):
        at = grid_pairs(symbol, p, stop)
        if len(at):
            grid.append((at, p))
            held += len(at)
            if held > GRID_PAIRS:
                extend()
                held = 0
    if grid:
        extend()
    runs = np.unique(np.concatenate(found), axis=0)  # by start, length and period
    new = np.ones(len(runs), dtype=bool)  # of the same stretch the smallest period
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return place[runs[:, 0]], runs[:, 1], runs[:, 2]


def made_periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One id in ten (by CRC32 of its digits) has its words from some place on replaced by repeats of those that stand there."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    times = -(-(n - a) // p)
    return words[:a] + (unit * times)[:n - a]


def runs_of(texts: Sequence[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start and period."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= MIN_WORDS]
    if not len(order):
        return out
    sizes = lengths[order]
    flat = [w for k in order.tolist() for w in texts[k]]
    coded = pa.array(flat, pa.large_binary()).dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes + 1) - 1
    symbol = np.empty(len(word) + len(sizes), dtype=np.int32)
    is_end = np.zeros(len(symbol), dtype=bool)
    is_end[ends] = True
    symbol[~is_end] = word
    symbol[ends] = len(coded.dictionary) + np.arange(len(sizes))
    start, length, period = find_runs(symbol, sizes)
    owner = np.searchsorted(ends, start, side="right")
    first = ends - sizes
    for k, s, n, p in zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[int(order[k])].append((s - int(first[k]), n, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for s, n, p in runs:
        keep[s + p:s + n] = False
    return [words[i] for i in np.flatnonzero(keep)]


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


# --- Spark operators -------------------------------------------------------------

FOUND = [T.StructField("n_runs", T.LongType(), False), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
         T.StructField("period", T.LongType()), T.StructField("exponent_milli", T.LongType())]


def _batches(texts: pa.Array, ids: pa.Array | None) -> Iterator[tuple[int, int, list[list[bytes]], list]]:
    """Row ranges of a text column with words and runs; ``ids`` make some texts periodic first."""
    for lo, hi in slices(None, pc.binary_length(texts).to_pylist(), BATCH_BYTES):
        words = [t.encode().split() for t in texts.slice(lo, hi - lo).to_pylist()]  # bytes split at ASCII white space only
        if ids is not None:
            words = [made_periodic(w, i) for w, i in zip(words, ids.slice(lo, hi - lo).to_pylist())]
        yield lo, hi, words, runs_of(words)


def _summary(runs: list) -> list[pa.Array]:
    best = [greatest(r) for r in runs]
    columns = [[len(r) for r in runs], *([None if b is None else b[k] for b in best] for k in range(3)),
               [None if b is None else 1000 * b[1] // b[2] for b in best]]
    return [pa.array(c, pa.int64()) for c in columns]


def periodic_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, ``runs`` (start, length, period in words), the greatest run and ``collapsed`` text.

    One Arrow pass without a shuffle; only the named columns are read, so further columns never clash.
    """
    ship_package(docs.sparkSession)
    src = docs.select(docs[id_col].alias(id_col), text_of(text).alias("__text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([src.schema[id_col], T.StructField("runs", T.ArrayType(run), False), *FOUND,
                           T.StructField("collapsed", T.StringType(), False)])
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, runs in _batches(batch.column(1), None):
                listed = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs]
                texts = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(listed, arrow), *_summary(runs), pa.array(texts, pa.string())],
                    names=schema.names)
    return src.mapInArrow(work, schema)


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document, one in ten made periodic: number of runs, the greatest one, digests of all runs and of the collapsed text."""
    ship_package(docs.sparkSession)
    src = docs.select("doc_id", text_of().alias("__text"))
    schema = T.StructType([src.schema["doc_id"], *FOUND, T.StructField("runs_sha256", T.StringType(), False),
                           T.StructField("collapsed_sha256", T.StringType(), False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, runs in _batches(batch.column(1), batch.column(0)):
                listed = [hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in r).encode()).hexdigest() for r in runs]
                texts = [hashlib.sha256(b" ".join(collapsed(w, r))).hexdigest() for w, r in zip(words, runs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *_summary(runs), pa.array(listed, pa.string()), pa.array(texts, pa.string())],
                    names=schema.names)
    return src.mapInArrow(work, schema)
