"""Token-id files in bit or byte planes (operator 10).

``write_tokens`` encodes texts with a ``tokenizers`` file, appends an end id to each
document, and writes the ids in ascending document order; ``read_tokens`` reads the
files back.  Files go through Spark's own writer and reader, so they may live in
any store that Spark reaches, and a lost task is simply written again.

A task writes one range of document ids; after ``FILE_BYTES`` of planes or ``FILE_DOCS`` documents it
ends the file and starts another, so files do not grow with the table, the length of its
texts or the number of tasks.  A file's bytes:

    chunk*  padding*  footer  footer length (u64)  b"PLANES01"

each followed by one newline (the writer's record end).  Spark's writer starts a file after a fixed
number of records; empty records fill a file that ends earlier up to that number.  A chunk holds a
fixed number of ids (the last one fewer), transposed into byte or bit planes of the id's
width (16 bits, or 32 for vocabularies over 65,536) and compressed plane by plane with
zstandard.  The footer, compressed too, is a JSON header and two tables: the chunk
index (offset and length of every plane, number of ids) and the document index
(id, first position in the file, number of ids).

Rules: a null text is empty (its document holds the end id only); null ids come first;
rows with equal ids are ordered by their text's hash; every row is one document.
"""

from __future__ import annotations

import functools
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm.base import ship_package, slices, text_of
from tablesmith.llm.bpe import CHUNK_CHARS, PieceCache, cut_pieces, safe_parts
from tablesmith.session import cut_lineage, ensure_checkpoint_dir

MAGIC = b"PLANES01"
BLOCK_IDS = 1 << 16
#: A file ends with the document that brings it to so many bytes of planes, so many ids, or so many documents.
FILE_BYTES = 1 << 28
FILE_DOCS = 1 << 20
LONGEST_TEXT = 1 << 31  # bytes that one row can hold
#: Pieces whose ids a worker remembers (about 200 bytes each); asking the library again costs ten lookups.
KNOWN_PIECES = 800_000


# --- planes ------------------------------------------------------------------

def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """A block of little-endian unsigned ids as byte planes, or as bit planes (packed)."""
    columns = np.ascontiguousarray(ids.view(np.uint8).reshape(len(ids), ids.itemsize).T)
    if not bits:
        return [c.tobytes() for c in columns]
    return [np.packbits((c >> b) & 1).tobytes() for c in columns for b in range(8)]


def from_planes(planes: list[bytes], count: int, dtype: str, bits: bool) -> np.ndarray:
    """The ids behind ``to_planes``."""
    width = np.dtype(dtype).itemsize
    out = np.zeros((width, count), dtype=np.uint8)
    for k, plane in enumerate(planes):
        if bits:
            out[k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=count) << (k % 8)
        else:
            out[k] = np.frombuffer(plane, np.uint8)
    return np.ascontiguousarray(out.T).view(dtype).ravel()


# --- encoding ----------------------------------------------------------------

def byte_alphabet() -> dict[int, str]:
    """The library's character for each byte: printable Latin-1 stays, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}


class LibraryEncoder:
    """Ids by the ``tokenizers`` library, asked once per piece.

    The file's pre-tokeniser must be the byte-level one whose pieces ``cut_pieces`` finds;
    each piece is then encoded by the library's model and cached.  Texts that contain an
    added token, and files with another pre-tokeniser, go to the library whole.
    """

    def __init__(self, config: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(config)
        self.library.no_padding()
        self.library.no_truncation()
        spec = json.loads(config)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space") and not spec.get("normalizer"))
        self.alphabet = byte_alphabet()
        self.width = np.dtype(self.id_type).itemsize
        self.model = self.library.model
        self.cache = PieceCache(self._piece, KNOWN_PIECES)

    @property
    def id_type(self) -> str:
        return "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.id_type).tobytes() for x in found]

    def _piece(self, piece: bytes) -> bytes:
        """Ids of one piece, by the library's model over its byte alphabet."""
        found = self.model.tokenize(piece.decode("latin-1").translate(self.alphabet))
        return struct.pack(f"<{len(found)}{'H' if self.width == 2 else 'I'}", *[x.id for x in found])

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """Packed ids of each text followed by ``end``."""
        whole = [not self.by_piece or any(a in t for a in self.added) for t in texts]
        self.cache.turn()
        pieces, ranges = cut_pieces(["" if w else t for t, w in zip(texts, whole)])
        get = self.cache.__getitem__
        out = [b"".join(map(get, pieces[a:b])) for a, b in ranges]
        for i, w in enumerate(whole):
            if w:
                out[i] = self._ask([texts[i]])[0]
        return [x + end for x in out]

    def encode_long(self, text: str, end: bytes) -> bytes:
        if not self.by_piece or any(a in text for a in self.added):
            return self._ask([text])[0] + end
        return b"".join(self.encode([p], b"")[0] for p in safe_parts(text)) + end


@functools.lru_cache(maxsize=2)
def library_encoder(config: str) -> LibraryEncoder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return LibraryEncoder(config)


# --- files -------------------------------------------------------------------

def file_records(block: int) -> int:
    """Records of a full file: chunks up to the limit of ids, those of the longest text a row can hold, and the footer."""
    return FILE_BYTES // block + LONGEST_TEXT // block + 20


class _FileBytes:
    """Turns a stream of documents into the records of files, one after the other."""

    def __init__(self, dtype: str, bits: bool, block: int, part: int, file_bytes: int, file_docs: int, records: int):
        import zstandard
        self.dtype, self.bits, self.block = np.dtype(dtype), bits, block
        self.file_bytes, self.file_docs, self.records = file_bytes, file_docs, records
        self.part = part << 32  # the files of a task follow each other
        self.zip = zstandard.ZstdCompressor(level=1)
        self._empty()

    def _empty(self) -> None:
        self.pending, self.waiting = [], 0
        self.chunks, self.at, self.total = [], 0, 0
        self.known, self.doc_ids, self.counts = bytearray(), array("q"), array("q")

    def add(self, doc_id, ids: bytes) -> Iterator[bytes]:
        n = len(ids) // self.dtype.itemsize
        self.known.append(doc_id is not None)
        self.doc_ids.append(doc_id or 0)
        self.counts.append(n)
        self.total += n
        self.pending.append(ids)
        self.waiting += n
        if self.waiting >= 16 * self.block:
            yield from self._flush(False)
        if max(self.at, self.total) >= self.file_bytes or len(self.counts) >= self.file_docs:
            yield from self._flush(True)
            missing = self.records - 1 - len(self.chunks)
            assert missing >= 0, "a file with more chunks than records"
            yield from [b""] * missing
            yield from self.finish()
            self.part += 1
            self._empty()

    def _flush(self, last: bool) -> Iterator[bytes]:
        ids = np.frombuffer(b"".join(self.pending), dtype=self.dtype)
        full = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, full, self.block):
            part = ids[i:min(i + self.block, full)]
            planes = [self.zip.compress(p) for p in to_planes(part, self.bits)]
            record = b"".join(planes)
            self.chunks.append([self.at, len(part), *map(len, planes)])
            self.at += len(record) + 1
            yield record
        self.pending, self.waiting = [ids[full:].tobytes()], len(ids) - full

    def finish(self) -> Iterator[bytes]:
        yield from self._flush(True)
        known = np.frombuffer(bytes(self.known), dtype=np.uint8)
        doc_ids, counts = np.array(self.doc_ids, dtype="<i8"), np.array(self.counts, dtype="<i8")
        chunks = np.array(self.chunks, dtype="<i8").ravel()
        header = json.dumps({"part": self.part, "ids": self.total, "dtype": self.dtype.str,
                             "bits": self.bits, "block": self.block, "docs": len(counts),
                             "chunks": len(self.chunks)}).encode()
        footer = self.zip.compress(struct.pack("<Q", len(header)) + header + chunks.tobytes()
                                   + known.tobytes() + doc_ids.tobytes() + counts.tobytes())
        yield footer + struct.pack("<Q", len(footer)) + MAGIC


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, planes: str = "byte",
                 block: int = BLOCK_IDS, files: int | None = None, file_bytes: int = FILE_BYTES, file_docs: int = FILE_DOCS,
                 records: int | None = None) -> None:
    """Write the ids of ``docs`` (doc_id, text) under ``path``.

    The texts are ordered by one range shuffle on (doc_id, hash of the text), before encoding, so
    that the sampling of the ranges reads no tokens and the ids are never shuffled.  ``files`` is the
    number of ranges (default: the shuffle partitions); a range's files end by size, each after ``records`` records.
    """
    assert planes in ("byte", "bit")
    spark = docs.sparkSession
    ship_package(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = records or file_records(block)
    with open(tokenizer, encoding="utf-8") as f:  # a public vocabulary file, a few MB
        config = spark.sparkContext.broadcast(f.read())
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    src = src.withColumn("tie", F.xxhash64("text"))
    src = src.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(config.value)
        end = np.array([end_id], dtype=enc.id_type).tobytes()
        out = _FileBytes(enc.id_type, planes == "bit", block, TaskContext.get().partitionId(), file_bytes, file_docs, records)

        def lines() -> Iterator[bytes]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for lo, hi in slices(batch, pc.binary_length(texts).to_pylist(), CHUNK_CHARS):
                    part = texts.slice(lo, hi - lo).to_pylist()
                    packed = [enc.encode_long(part[0], end)] if len(part) == 1 else enc.encode(part, end)
                    for doc_id, x in zip(ids[lo:hi], packed):
                        yield from out.add(doc_id, x)
            yield from out.finish()

        for record in lines():
            yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["record"])

    frames = src.select("doc_id", "text").mapInArrow(run, "record binary")
    # Text files of raw bytes: a binary cast to string keeps its bytes as they are.
    frames.select(F.col("record").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", records).text(path)


def read_file(content: bytes) -> Iterator[tuple[int, int, int | None, int, np.ndarray]]:
    """(part, ordinal, doc_id, first position in the file, ids) of every document of one file."""
    import zstandard
    unzip = zstandard.ZstdDecompressor()
    content = memoryview(content)
    content = content[:-1] if content[-1:] == b"\n" else content
    assert bytes(content[-8:]) == MAGIC, "not a token file"
    size = struct.unpack("<Q", content[-16:-8])[0]
    footer = unzip.decompress(content[-16 - size:-16])
    n = struct.unpack("<Q", footer[:8])[0]
    head = json.loads(footer[8:8 + n])
    dtype, bits = np.dtype(head["dtype"]), head["bits"]
    width = 2 + dtype.itemsize * (8 if bits else 1)
    at = 8 + n
    chunks = np.frombuffer(footer, "<i8", head["chunks"] * width, at).reshape(-1, width)
    at += chunks.nbytes
    known = np.frombuffer(footer, np.uint8, head["docs"], at)
    doc_ids = np.frombuffer(footer, "<i8", head["docs"], at + len(known))
    counts = np.frombuffer(footer, "<i8", head["docs"], at + len(known) + doc_ids.nbytes)

    def blocks() -> Iterator[np.ndarray]:
        for row in chunks.tolist():
            planes, p = [], row[0]
            for length in row[2:]:
                planes.append(unzip.decompress(content[p:p + length]))
                p += length
            yield from_planes(planes, row[1], dtype.str, bits)

    stream, left, start = blocks(), np.zeros(0, dtype), 0
    for k, (count, doc_id, ok) in enumerate(zip(counts.tolist(), doc_ids.tolist(), known.tolist())):
        parts, need = [], count
        while need:
            if not len(left):
                left = next(stream)
            parts.append(left[:need])
            left = left[need:]
            need -= len(parts[-1])
        ids = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else left[:0]
        yield head["part"], k, doc_id if ok else None, start, ids
        start += count


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: part, ordinal, doc_id, file_start, n_tokens, ids_crc32 (and ids)."""
    ship_package(spark)
    schema = "part long, ordinal long, doc_id long, file_start long, n_tokens long, ids_crc32 long"
    schema += ", ids array<long>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                buffer = content.as_buffer()
                rows, held = [], 0
                for part, k, doc_id, start, ids in read_file(buffer):
                    wide = ids.astype("<u4")
                    row = [part, k, doc_id, start, len(ids), zlib.crc32(wide.tobytes())]
                    rows.append(row + [wide.astype("i8")] if with_ids else row)
                    held += len(ids) * with_ids + 1
                    if held >= 1 << 19:
                        yield _batch(rows, with_ids)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, with_ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.where(F.col("length") > 0).select("content").mapInArrow(run, schema)


def _batch(rows: list[list], with_ids: bool) -> pa.RecordBatch:
    names = ["part", "ordinal", "doc_id", "file_start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64()] * 6 + [pa.list_(pa.int64())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    One pass over the files; the per-file totals (one row per file) give each file its offset.
    """
    found = cut_lineage(read_tokens(spark, path, with_ids=False))
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, planes: str = "byte") -> DataFrame:
    """Write the files into the shared checkpoint folder and index what they hold."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablesmith-tokens/{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id, planes)
    return token_index(spark, path)
