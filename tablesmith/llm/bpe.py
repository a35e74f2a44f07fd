"""Byte-level BPE encoding and decoding (operator 5).

Pre-tokenisation is done without a regular expression.  Every code point gets a
class (letter, number, white space, other; the few characters that the pattern
looks ahead to are folded into the class).  A small automaton reads the classes
and says where a piece starts.  Its transition functions form a finite monoid,
and composing them is associative, so a whole batch of texts is scanned at once:
prefix products inside rows of a matrix, a doubling scan over the row products,
then one lookup gives the state before every character.

The pieces (UTF-8 slices) go through a cache of merged pieces; a new piece is
merged pair by pair, lowest rank first.  Each token keeps its byte offset, and
decoding copies the tokens' bytes to their offsets.

Rules: a null text is empty and has no tokens; every input row gives one output
row (repeated rows and null ids included); texts are never cut, a long text is
only worked on in parts that end where a piece surely ends; special-token
strings are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.llm.base import ship_package, slices, text_of

# Unicode's White_Space property.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002,
               0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029,
               0x202F, 0x205F, 0x3000]
# Endings that follow an apostrophe in the public pattern.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

#: Classes of a character; the last five need a look at its neighbours.
LETTER, NUMBER, OTHER, WHITE, APOS1, APOS2, SPACE_LAST, WHITE_LAST, BREAK = range(9)
#: States of the automaton before a character.
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, JOINING, IN_WHITE, END1, END2 = range(8)

CHUNK_CHARS = 1 << 20
CACHE_PIECES = 200_000


# --- classes -----------------------------------------------------------------

@functools.lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], dtype="<u4")
    text = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start():m.end()]] = kind
    out[WHITE_SPACE] = WHITE
    return out


def classify(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Class of each character, with look-ahead; ``breaks`` are positions between texts."""
    kind = class_table()[points]
    is_white = kind == WHITE
    is_white[breaks] = False
    # A white character whose next one is neither white nor an end is the run's last one.
    after = np.ones(len(points), dtype=bool)
    after[:-1] = is_white[1:]
    after[breaks[breaks > 0] - 1] = True
    last = is_white & ~after
    kind[last] = WHITE_LAST
    kind[last & (points == 0x20)] = SPACE_LAST
    apostrophes = np.flatnonzero(points == 0x27)
    if len(apostrophes):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        first, second = padded[apostrophes + 1], padded[apostrophes + 2]
        for end in ENDINGS:
            hit = first == ord(end[0])
            if len(end) == 2:
                hit &= second == ord(end[1])
            kind[apostrophes[hit]] = APOS1 if len(end) == 1 else APOS2
    kind[breaks] = BREAK
    return kind


# --- the automaton and its monoid --------------------------------------------

def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this character."""
    if kind == BREAK:
        return FRESH, True
    if state == END2:
        return END1, False
    if state == END1:
        return FRESH, False
    if kind == WHITE:
        return IN_WHITE, state != IN_WHITE
    if kind == SPACE_LAST:
        return JOINING, True
    if kind == WHITE_LAST:
        return FRESH, True
    if kind in (APOS1, APOS2) and state not in (IN_OTHER, JOINING):
        return (END1 if kind == APOS1 else END2), True
    run = {LETTER: IN_LETTER, NUMBER: IN_NUMBER}.get(kind, IN_OTHER)
    return run, state not in (JOINING, run)


@functools.lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, products, action [element, state], starts [state, class]).

    Elements are numbered; an element ``e`` is kept as ``e * 512``, so that
    ``products[a + b // 512]`` is the element of "first a, then b", also times 512.
    """
    gens = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    elements = [tuple(range(8))]
    index = {elements[0]: 0}
    for e in elements:  # grows while it is walked
        for g in gens:
            f = tuple(g[s] for s in e)
            if f not in index:
                index[f] = len(elements)
                elements.append(f)
    assert len(elements) <= 512
    product = np.zeros((len(elements), 512), dtype=np.int32)
    for i, a in enumerate(elements):
        for j, b in enumerate(elements):
            product[i, j] = index[tuple(b[s] for s in a)] * 512
    starts = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)])
    return (np.array([index[g] for g in gens], dtype=np.int32), product.ravel(),
            np.array(elements, dtype=np.uint8).ravel(), starts.ravel())


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Positions where pieces start, by an associative scan of transition functions."""
    n = len(kinds)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    element, product, action, starts = _monoid()
    width = max(1, min(256, int(n ** 0.5)))
    rows = -(-n // width)
    padded = np.full(rows * width, BREAK, dtype=np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    total = np.zeros(rows, dtype=np.int32)  # the identity
    before = np.empty((width, rows), dtype=np.int32)
    for c in range(width):
        before[c] = total
        total = product.take(total + element.take(columns[c]))
    carry = total.copy()
    step = 1
    while step < rows:  # doubling scan over the rows' products
        carry[step:] = product.take(carry[:-step] + (carry[step:] >> 9))
        step *= 2
    at_row = np.zeros(rows, dtype=np.int32)
    at_row[1:] = action.take((carry[:-1] >> 6) + FRESH)
    flags = np.empty((width, rows), dtype=bool)
    for c in range(width):
        state = action.take((before[c] >> 6) + at_row)
        flags[c] = starts.take(state * np.uint8(9) + columns[c])
    return np.flatnonzero(flags.T.ravel()[:n])


def cut_pieces(texts: Sequence[str]) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Pieces of the texts as UTF-8 slices, and each text's range in that list."""
    joined = "\0".join(texts)
    if not joined:
        return [], [(0, 0)] * len(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    breaks = (np.cumsum(lengths + 1) - 1)[:-1]
    starts = piece_starts(classify(points, breaks))
    data = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
    at = starts if len(data) == len(joined) else np.flatnonzero((data & 0xC0) != 0x80)[starts]
    # A byte that UTF-8 never uses goes before every piece; then one split cuts them all.
    body = np.ones(len(data) + len(at), dtype=bool)
    body[at + np.arange(len(at))] = False
    marked = np.full(len(body), 0xFF, dtype=np.uint8)
    marked[body] = data
    pieces = marked.tobytes().split(b"\xff")[1:]
    seams = np.searchsorted(starts, breaks).tolist()
    return pieces, list(zip([0] + [x + 1 for x in seams], seams + [len(pieces)]))


def safe_parts(text: str, limit: int = CHUNK_CHARS) -> list[str]:
    """The text in parts of about ``limit`` characters that end before a white run."""
    parts = []
    at = 0
    while len(text) - at > limit:
        cut = at + limit
        while cut < len(text) and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut += 1
        parts.append(text[at:cut])
        at = cut
    parts.append(text[at:])
    return parts


# --- merging -----------------------------------------------------------------

def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: join the adjacent pair of lowest rank (leftmost first) until none is known."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n > 48:
        return _merge_long(piece, ranks)
    none = 1 << 60
    parts = [piece[i:i + 1] for i in range(n)]
    cost = [ranks.get(piece[i:i + 2], none) for i in range(n - 1)]
    while cost:
        low = min(cost)
        if low == none:
            break
        i = cost.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del cost[i]
        if i < len(cost):
            cost[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            cost[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same result with a heap of pairs over a linked list, for pieces of any length."""
    n = len(piece)
    end = list(range(1, n + 1))      # end of the part that starts at i; 0 once it is gone
    left = list(range(-1, n - 1))    # start of the part before
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            left[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if left[i] >= 0:
            p = left[i]
            if (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class PieceCache(dict):
    """Piece -> packed ids.  Two generations bound its size: what is still used survives."""

    def __init__(self, make, limit: int = CACHE_PIECES):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, piece: bytes) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = self.make(piece)
        if len(piece) > 64:
            return packed
        self[piece] = packed
        return packed

    def turn(self) -> None:
        """Start a new generation when this one is full; called between batches."""
        if len(self) >= self.limit // 2:
            self.older = dict(self)
            self.clear()


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks file: one base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """Encoder and decoder over one ranks file."""

    def __init__(self, data: bytes):
        self.ranks = read_ranks(data)
        self.cache = PieceCache(lambda p: struct.pack(f"<{len(x := merge_piece(p, self.ranks))}I", *x))
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        size = tokens[-1][1] + 1
        self.length = np.zeros(size, dtype=np.int64)
        self.length[[i for _, i in tokens]] = [len(t) for t, _ in tokens]
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(t for t, _ in tokens), dtype=np.uint8)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each text."""
        self.cache.turn()
        pieces, ranges = cut_pieces(texts)
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces[a:b])) for a, b in ranges]

    def encode_whole(self, text: str) -> bytes:
        return b"".join(self.encode([p])[0] for p in safe_parts(text))

    def offsets(self, ids: bytes) -> bytes:
        """Byte offset of each token in the UTF-8 text, packed like the ids (64-bit beyond 4 GB)."""
        lengths = self.length[np.frombuffer(ids, dtype="<u4")]
        ends = np.cumsum(lengths)
        wide = len(ends) and ends[-1] >= 1 << 32
        return (ends - lengths).astype("<u8" if wide else "<u4").tobytes()

    def decode(self, ids: bytes, offsets: bytes, step: int = 1 << 18) -> bytes:
        """The text's bytes: every token's bytes copied to its offset."""
        tokens = np.frombuffer(ids, dtype="<u4")
        at = np.frombuffer(offsets, dtype="<u4" if len(offsets) == len(ids) else "<u8").astype(np.int64)
        out = []
        for i in range(0, len(tokens), step):
            part = tokens[i:i + step]
            lengths = self.length[part]
            base = at[i]
            source = np.repeat(self.start[part] - (at[i:i + step] - base), lengths)
            source += np.arange(len(source))
            out.append(self.flat[source].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def codec(data: bytes) -> Codec:
    """One codec per Python worker and ranks file; its cache lives on between tasks."""
    return Codec(data)


# --- Spark operators ---------------------------------------------------------

def _ranks(df: DataFrame, path: str):
    ship_package(df.sparkSession)
    with open(path, "rb") as f:  # a public vocabulary file on the driver, under 1 MB
        return df.sparkSession.sparkContext.broadcast(f.read())


def _encoded(c: Codec, batches: Iterator[pa.RecordBatch], keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (keep..., text) as (keep..., ids, offsets), about a million characters at a time."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for lo, hi in slices(batch, pc.binary_length(column).to_pylist(), CHUNK_CHARS):
            part = column.slice(lo, hi - lo).to_pylist()
            ids = [c.encode_whole(part[0])] if len(part) == 1 else c.encode(part)
            rest = [x.slice(lo, hi - lo) for x in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(ids, pa.binary()), pa.array([c.offsets(x) for x in ids], pa.binary())],
                names=[*keep, "ids", "offsets"])


def _decoded(c: Codec, batches: Iterator[pa.RecordBatch], keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (keep..., ids, offsets) as (keep..., decoded)."""
    k = len(keep)
    for batch in batches:
        for lo, hi in slices(batch, pc.binary_length(batch.column(k)).to_pylist(), 4 * CHUNK_CHARS):
            part = batch.slice(lo, hi - lo)
            texts = [c.decode(a, b) for a, b in zip(part.column(k).to_pylist(), part.column(k + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(texts, pa.binary())], names=[*keep, "decoded"])


def encode(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` plus ids and offsets, both packed little-endian in a binary column.

    No shuffle: one Arrow pass over the texts.  Only the named columns are read, so further columns never clash.
    """
    shared = _ranks(docs, path)
    src = docs.select(*keep, text_of(text).alias("__text"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("ids", T.BinaryType(), False),
                                                           T.StructField("offsets", T.BinaryType(), False)])
    return src.mapInArrow(lambda batches: _encoded(codec(shared.value), batches, keep), schema)


def decode(encoded: DataFrame, path: str, keep: Sequence[str] = ("doc_id", "ids")) -> DataFrame:
    """Columns ``keep`` plus ``decoded``, the bytes of the text behind ids and offsets."""
    shared = _ranks(encoded, path)
    src = encoded.select(*keep, F.col("ids").alias("__ids"), F.col("offsets").alias("__offsets"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType(), False)])
    return src.mapInArrow(lambda batches: _decoded(codec(shared.value), batches, keep), schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the packed ids and of the decoded bytes.

    ``encode`` and ``decode`` in one Arrow pass, so that a task needs one Python worker and the ids cross to it once.
    """
    shared = _ranks(docs, path)
    src = docs.select("doc_id", text_of().alias("__text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("ids", T.BinaryType(), False),
                           T.StructField("decoded", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for found in _encoded(c, batches, ["doc_id"]):
            back = _decoded(c, [found.select([0, 1, 1, 2]).rename_columns(["doc_id", "ids", "__ids", "__offsets"])], ["doc_id", "ids"])
            yield from back

    both = src.mapInArrow(run, schema)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
