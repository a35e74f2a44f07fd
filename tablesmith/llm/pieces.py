"""SentencePiece BPE encoding and decoding (operator 13).

Merging by score gives every prefix of a text one encoding, so the last token of each
prefix is unique: the token t that ends there and forms a compatible pair with the
last token of the prefix before t.  A string automaton reports all tokens that end at
each character; a pair (u, t) is compatible when merging u + t leaves the two apart.
One pass fills the table of last tokens, and walking it backwards gives the ids.

A pair is tested on how its two tokens came about: the symbols at u's right edge and at
t's left edge, each with the rank of the merge that consumes it.  Replaying both lists
by rank shows whether some merge across the border comes first.

Before that, texts are cut where no token of the vocabulary holds both neighbouring
characters: no merge crosses such a place.  The parts go through a bounded cache; a
character that the vocabulary lacks is a part of its own and becomes its UTF-8 bytes.

Rules: a null text is empty; an empty text has the end id only; every input row gives
one output row (repeated rows and null ids included); texts are never shortened, a
long one is only worked on in parts that end at such a place.  Internally a space
stands for the library's space symbol, which reads as a space wherever it occurs.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.llm.base import ship_package, slices, text_of
from tablesmith.llm.bpe import PieceCache

SPACE = "▁"       # fixed value: the library's space symbol
UNKNOWN = " ⁇ "   # fixed value: what the library decodes the unknown id to
CHUNK_CHARS = 1 << 20
NEVER = 1 << 60
NORMAL, CONTROL, BYTE, UNK = range(4)

codecs.register_error("tablesmith_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def read_model(path: str) -> bytes:
    """Pieces, scores and kinds of a model file, packed for the executors (under 2 MB for 32,000 pieces)."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    if m.normalize("ﬁ  x ") != f"{SPACE}ﬁ{SPACE}{SPACE}x{SPACE}":
        raise ValueError("only models without normalisation that put a space before the text are read")
    size = m.get_piece_size()
    if any(m.is_unused(i) for i in range(size)):
        raise ValueError("models with unused pieces are not read")
    kinds = [BYTE if m.is_byte(i) else UNK if m.is_unknown(i) else CONTROL if m.is_control(i) else NORMAL for i in range(size)]
    if kinds.count(BYTE) != 256:
        raise ValueError("only models with byte fallback are read")
    return json.dumps({"pieces": [m.id_to_piece(i) for i in range(size)], "scores": [m.get_score(i) for i in range(size)],
                       "kinds": kinds, "end": m.eos_id()}).encode()


class Merges:
    """Merge ranks of a vocabulary, and which pairs of its tokens can stand next to each other."""

    def __init__(self, scores: dict[str, float]):
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: order[s] for p, s in scores.items()}
        self.split: dict[str, tuple[str, str]] = {}
        self.reached = [p for p in self.ranks if self.merged(p) == [p]]
        # Tokens made of parts that rank before them, all the way down: their ranks are the merges' times.
        self.ordered: set[str] = set()
        for p in sorted(self.reached, key=len):
            if len(p) == 1 or all(x in self.ordered and (len(x) == 1 or self.ranks[x] < self.ranks[p]) for x in self.split[p]):
                self.ordered.add(p)
        self.left, self.right = functools.cache(self._edge(0)), functools.cache(self._edge(1))

    def merged(self, text: str) -> list[str]:
        """Tokens by plain merging: the pair of lowest rank first, the leftmost of equals."""
        parts = list(text)
        cost = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while cost and (low := min(cost)) != NEVER:
            i = cost.index(low)
            self.split.setdefault(parts[i] + parts[i + 1], (parts[i], parts[i + 1]))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del cost[i]
            if i < len(cost):
                cost[i] = self.ranks.get(parts[i] + parts[i + 1], NEVER)
            if i:
                cost[i - 1] = self.ranks.get(parts[i - 1] + parts[i], NEVER)
        return parts

    def _edge(self, side: int):
        """Symbols at one edge of a token, the first character up to the token, each with the rank that consumes it."""
        def edge(token: str) -> list[tuple[str, int]]:
            out, until = [], NEVER
            while True:
                out.append((token, until))
                if len(token) == 1:
                    return out[::-1]
                until = self.ranks[token]
                token = self.split[token][side]
        return edge

    def compatible(self, u: str, t: str) -> bool:
        """Whether merging u + t leaves exactly u and t."""
        if u not in self.ordered or t not in self.ordered:
            return self.merged(u + t) == [u, t]
        lefts, rights = self.right(u), self.left(t)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = lefts[i], rights[j]
            across = self.ranks.get(a + b, NEVER)
            if across < a_until and (across < b_until or across == b_until != NEVER):
                return False  # of equal ranks the leftmost goes first: u's own, then the border, then t's
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, packed: bytes):
        import ahocorasick
        model = json.loads(packed)
        kinds = np.array(model["kinds"])
        self.end = model["end"]
        surface = [p.replace(SPACE, " ") for p in model["pieces"]]
        self.ids = {p: i for i, p in enumerate(surface) if kinds[i] == NORMAL}
        self.merges = Merges({p: model["scores"][i] for p, i in self.ids.items()})
        self.text = surface
        self.byte_id = [int(i) for i in np.flatnonzero(kinds == BYTE)]
        self.automaton = ahocorasick.Automaton()
        for p in self.merges.reached:
            self.automaton.add_word(p, self.ids[p])
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache = PieceCache(lambda p: np.array(self.encode_part(p.decode()), "<u4").tobytes())
        # Characters of the vocabulary get numbers; 0 is any other character.
        chars = sorted({c for p in self.merges.reached for c in p})
        self.char_no = np.zeros(0x110000, dtype=np.int32)
        self.char_no[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        joins = np.zeros((self.width, self.width), dtype=bool)
        pairs = {p[i:i + 2] for p in self.merges.reached for i in range(len(p) - 1)}
        a, b = (self.char_no[[ord(p[k]) for p in pairs]] for k in (0, 1))
        joins[a, b] = True
        self.joins = joins.ravel()
        # Bytes of every token when decoded, and its decimal digits with a space.
        blank = {CONTROL: b"", UNK: UNKNOWN.encode()}
        self.bytes_of = _Flat([blank[k] if k in blank else bytes([int(p[1:-1], 16)]) if k == BYTE else s.encode()
                               for k, p, s in zip(model["kinds"], model["pieces"], surface)])
        self.digits_of = _Flat([b"%d " % i for i in range(len(surface))])
        self.is_control = kinds == CONTROL
        self.opens_with_space = np.array([k == NORMAL and s.startswith(" ") for k, s in zip(model["kinds"], surface)])

    # --- encoding

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part by the table of each prefix's last token."""
        if len(part) == 1 and part not in self.ids:
            return [self.byte_id[b] for b in part.encode()]
        last = [-1] * (len(part) + 1)
        text, fits = self.text, self.fits
        if len(fits) > 2_000_000:
            fits.clear()
        for stop, token in self.automaton.iter(part):
            stop += 1
            if last[stop] >= 0:
                continue  # the prefix has its token
            start = stop - len(text[token])
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = fits.get((before, token))
                if ok is None:
                    ok = fits[before, token] = self.merges.compatible(text[before], text[token])
                if not ok:
                    continue
            last[stop] = token
        out, at = [], len(part)
        while at:
            out.append(last[at])
            at -= len(text[last[at]])
        return out[::-1]

    def parts(self, texts: Sequence[str]) -> tuple[list[bytes], list[tuple[int, int]]]:
        """UTF-8 parts between which no merge happens, and each text's range in that list."""
        joined = "\0".join(texts)
        if not joined:
            return [], [(0, 0)] * len(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        number = self.char_no[points]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        seams = (np.cumsum(lengths + 1) - 1)[:-1]
        number[seams] = 0
        cut = np.ones(len(points), dtype=bool)
        cut[1:] = ~self.joins.take(number[:-1] * self.width + number[1:])
        starts = np.flatnonzero(cut)
        data = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
        at = starts if len(data) == len(points) else np.flatnonzero((data & 0xC0) != 0x80)[starts]
        # A byte that UTF-8 never uses goes before every part; then one split cuts them all.
        body = np.ones(len(data) + len(at), dtype=bool)
        body[at + np.arange(len(at))] = False
        marked = np.full(len(body), 0xFF, dtype=np.uint8)
        marked[body] = data
        found = marked.tobytes().split(b"\xff")[1:]
        places = np.searchsorted(starts, seams).tolist()
        return found, list(zip([0] + [x + 1 for x in places], places + [len(found)]))

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text, the end id included."""
        self.cache.turn()
        parts, ranges = self.parts([" " + t.replace(SPACE, " ") if t else "" for t in texts])
        get, end = self.cache.__getitem__, np.array([self.end], "<u4").tobytes()
        return [np.frombuffer(b"".join(map(get, parts[a:b])) + end, "<u4") for a, b in ranges]

    def encode_long(self, text: str, limit: int = CHUNK_CHARS) -> np.ndarray:
        """The same for one text of any length, about ``limit`` characters at a time."""
        text = " " + text.replace(SPACE, " ") if text else ""
        self.cache.turn()
        out, at = [], 0
        while at < len(text):
            cut = min(at + limit, len(text))
            while cut < len(text) and self.joins[self.char_no[ord(text[cut - 1])] * self.width + self.char_no[ord(text[cut])]]:
                cut += 1
            out += map(self.cache.__getitem__, self.parts([text[at:cut]])[0])
            at = cut
        return np.frombuffer(b"".join(out) + np.array([self.end], "<u4").tobytes(), "<u4")

    # --- decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of the ids; control ids are silent, byte runs that are not UTF-8 give U+FFFD per byte."""
        data = self.bytes_of.joined(ids)
        spoken = np.flatnonzero(~self.is_control[ids[:64]])
        first = int(ids[spoken[0]]) if len(spoken) else next((int(i) for i in ids if not self.is_control[i]), -1)
        if first >= 0 and self.opens_with_space[first]:
            data = data[1:]
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            data = data.decode("utf-8", "tablesmith_each_byte").encode()
        return data

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        return self.digits_of.joined(ids)[:-1]


class _Flat:
    """Byte strings by number, copied out in one gather."""

    def __init__(self, strings: Sequence[bytes]):
        self.length = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def joined(self, numbers: np.ndarray, step: int = 1 << 17) -> bytes:
        out = []
        for i in range(0, len(numbers), step):
            part = numbers[i:i + step]
            lengths = self.length[part]
            source = np.repeat(self.start[part] - (np.cumsum(lengths) - lengths), lengths)
            source += np.arange(len(source))
            out.append(self.flat[source].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def codec(packed: bytes) -> Codec:
    """One codec per Python worker and model; its cache lives on between tasks."""
    return Codec(packed)


# --- Spark operators ---------------------------------------------------------

def _encoded(c: Codec, column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row ranges of a text column with their ids, about a million characters at a time."""
    for lo, hi in slices(None, pc.binary_length(column).to_pylist(), CHUNK_CHARS):
        texts = column.slice(lo, hi - lo).to_pylist()
        yield lo, hi, [c.encode_long(texts[0])] if len(texts) == 1 else c.encode(texts)


def _pass(df: DataFrame, path: str, keep: Sequence[str], made: list[T.StructField], last, work) -> DataFrame:
    """One Arrow pass: columns ``keep`` plus what ``work(codec, column)`` yields as (from, to, arrays)."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_model(path))  # a public vocabulary, under 2 MB
    src = df.select(*keep, last.alias("__last"))
    schema = T.StructType([src.schema[c] for c in keep] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for lo, hi, arrays in work(c, batch.column(len(keep))):
                kept = [x.slice(lo, hi - lo) for x in batch.columns[:len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=schema.names)
    return src.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` plus ``ids`` (packed little-endian unsigned 32-bit, end id included).

    No shuffle: one Arrow pass.  Only the named columns are read, so further columns never clash.
    """
    def work(c: Codec, column: pa.Array):
        for lo, hi, ids in _encoded(c, column):
            yield lo, hi, [pa.array([x.tobytes() for x in ids], pa.binary())]
    return _pass(docs, path, keep, [T.StructField("ids", T.BinaryType(), False)], text_of(text), work)


def decode(encoded: DataFrame, path: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` plus ``decoded``, the text behind ``ids``."""
    def work(c: Codec, column: pa.Array):
        for lo, hi in slices(None, pc.binary_length(column).to_pylist(), 4 * CHUNK_CHARS):
            texts = [c.decode(np.frombuffer(x, "<u4")).decode() for x in column.slice(lo, hi - lo).to_pylist()]
            yield lo, hi, [pa.array(texts, pa.string())]
    return _pass(encoded, path, keep, [T.StructField("decoded", T.StringType(), False)], F.col("ids"), work)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the decimal ids and of the decoded text, in one Arrow pass."""
    def work(c: Codec, column: pa.Array):
        for lo, hi, ids in _encoded(c, column):
            yield lo, hi, [pa.array([len(x) for x in ids], pa.int64()),
                           pa.array([hashlib.sha256(c.decimals(x)).hexdigest() for x in ids], pa.string()),
                           pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())]
    made = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False),
            T.StructField("decoded_sha256", T.StringType(), False)]
    return _pass(docs, path, ["doc_id"], made, text_of(), work)
