"""SimHash near-duplicates by covering locality-sensitive hashing (operator 6).

Fingerprint: majority bits of the XXH64 values of a text's word shingles.  Two
fingerprints link when they differ in at most ``radius`` bits.

Covering hashing gives every bit position a non-zero vector of ``radius + 1`` bits.
For each non-zero v there is one table, keyed by the fingerprint's bits whose vectors
have an odd inner product with v.  The at most ``radius`` positions in which two linked
fingerprints differ span less than the whole space, so some v is orthogonal to all of
them, and in that table the two keys agree: no linked pair is missed.

Only distinct fingerprints are hashed (exact copies and other equal fingerprints are
one point).  A bucket yields a spanning forest of its links, never its pairs; a bucket
over ``block`` points is verified block against block in separate tasks, with the same
links.  Links are closed into components by alternating star steps on Spark tables.

Rules: a null text is empty; texts without a word have fingerprint zero; rows without a
doc_id are members too, but never name a component (null if no member has an id); repeated
rows are equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.base import shielded, ship_package, text_of
from tablesmith.session import cut_lineage

BLOCK = 2048


# --- fingerprints ------------------------------------------------------------

def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest
    joined = b" ".join(text.encode("utf-8").lower().split())  # bytes: only A-Z and ASCII blanks change
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 0x20)
    if len(gaps) + 1 < width:
        return xxh64_intdigest(joined, seed)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)][width - 1:]
    n = len(ends)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[i:i + (1 << 16)], ends[i:i + (1 << 16)])]
        octets = np.array(part, dtype="<u8").view(np.uint8)
        bits = np.unpackbits(octets, bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) per row; one pass, no shuffle."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    src = src.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), width, seed) for x in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))],
                names=["doc_id", "text_hash", "fp"])

    return src.mapInArrow(run, "doc_id long, text_hash long, fp long")


# --- covering tables ---------------------------------------------------------

def covering_masks(radius: int) -> list[int]:
    """One 64-bit mask for each non-zero vector of radius + 1 bits, as signed longs."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(64)]
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def forest(points: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (two arrays) that connect whatever links within ``radius`` connect; at most len - 1 of them."""
    out, left = [], points
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            part, front = front[:256], front[256:]
            near = np.bitwise_count(part[:, None] ^ left[None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                out.append((part[near[:, hit].argmax(axis=0)], left[hit]))
                front = np.concatenate([front, left[hit]])
                left = left[~hit]
    return out


def _bucket_links(radius: int, block: int | None):
    """Arrow pass over rows sorted by bucket: (kind, a, b); kind 0 links a and b, kind 1 defers bucket (a, b)."""
    def emit(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
            names=["kind", "a", "b"])

    def groups(keys: np.ndarray, points: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        first = np.concatenate([[0], cuts])
        size = np.diff(np.append(first, len(keys)))
        two = first[size == 2]
        a, b = points[two], points[two + 1]
        near = np.bitwise_count(a ^ b) <= radius
        parts = [(a[near], b[near])]
        for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            if block and n > block:
                yield emit(1, keys[i:i + 1, 0].copy(), keys[i:i + 1, 1].copy())
            else:
                parts += forest(points[i:i + n], radius)
        a, b = (np.concatenate(x) for x in zip(*parts))
        if len(a):
            yield emit(0, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = points = None
        skip = None  # a deferred bucket whose further rows are passed over
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            k = np.stack(columns[:-1], axis=1)
            p = columns[-1].view(np.uint64)
            if skip is not None:
                rest = np.flatnonzero((k != skip).any(axis=1))
                at = rest[0] if len(rest) else len(k)
                k, p, skip = k[at:], p[at:], skip if at == len(k) else None
            if keys is not None and len(keys):
                k, p = np.concatenate([keys, k]), np.concatenate([points, p])
            if not len(k):
                keys, points = k, p
                continue
            same = np.flatnonzero((k != k[-1]).any(axis=1))
            last = same[-1] + 1 if len(same) else 0
            if last:
                yield from groups(k[:last], p[:last])
            keys, points = k[last:], p[last:]
            if block and len(keys) > block:
                yield emit(1, keys[:1, 0].copy(), keys[:1, 1].copy())
                skip, keys, points = keys[0], keys[:0], points[:0]
        if keys is not None and len(keys):
            yield from groups(keys, points)

    return run


def links(points: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a < b, signed longs) whose closure equals that of all pairs of ``fp`` within ``radius``.

    One shuffle of (table, key, fp) rows.  Buckets over ``block`` points are then taken
    apart: their points go to ceil(n / block) blocks by hash, and each pair of blocks is a task
    unit of its own, so memory and emitted rows stay bounded whatever the bucket holds.
    """
    ship_package(points.sparkSession)
    masks = covering_masks(radius)
    keyed = points.select(
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"), "fp"
    ).select(F.col("t").cast("long").alias("t"), "key", "fp")
    schema = "kind int, a long, b long"
    found = cut_lineage(keyed.repartition("t", "key").sortWithinPartitions("t", "key")
                        .mapInArrow(_bucket_links(radius, block), schema))
    out = found.where("kind = 0").select("a", "b")
    deferred = found.where("kind = 1").select(F.col("a").alias("t"), F.col("b").alias("key"))
    if not deferred.isEmpty():
        rows = keyed.join(deferred, ["t", "key"], "left_semi")
        sizes = rows.groupBy("t", "key").agg(F.ceil(F.count("*") / block).alias("blocks"))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        units = rows.join(sizes, ["t", "key"]).withColumn("own", own).select(
            "t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "fp")
        units = units.select("t", "key", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("w"), "fp")
        more = (units.repartition("t", "key", "u", "w").sortWithinPartitions("t", "key", "u", "w")
                .mapInArrow(_bucket_links(radius, None), schema))
        out = out.unionByName(more.select("a", "b"))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --- components --------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links but the roots themselves.

    Alternating star steps: each node's larger neighbours, then its smaller ones, are
    linked to the smallest neighbour, until nothing changes.  Every round is written to the
    shared folder; group minima combine map-side and joins leave a hot node to AQE.
    """
    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut_lineage(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))  # u > v
    before = stamp(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                            F.col("m").alias("v"))
        edges = cut_lineage(small.where("u != v").distinct())
        after = stamp(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """Per row: doc_id, text_hash, fp, root (the component's key) and component_id (its smallest doc_id)."""
    members = cut_lineage(fingerprints(docs, width, seed))
    points = members.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    parts = components(links(points.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = points.join(parts, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    placed = cut_lineage(placed)
    names = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = placed.select("fp", "root").join(names, "root")
    return members.join(labels, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def fp_hex(fp: str | Column = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the smallest (doc_id, text hash).

    Ids that are null come last.  Of rows that agree in id and text one stays.
    """
    return keep_smallest(docs, lambda rows: near_duplicates(rows, radius, width))


def keep_smallest(docs: DataFrame, groups: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``keep_one`` for any grouping into doc_id, text_hash and root."""
    docs, back = shielded(docs)
    found = groups(docs)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    kept = best.select(F.col("best.doc_id").alias("_kept_id"), F.col("best.text_hash").alias("_kept_hash"))
    keyed = docs.withColumns({"_own_id": F.col("doc_id").cast("long"), "_own_hash": F.xxhash64(text_of())})
    on = keyed["_own_id"].eqNullSafe(kept["_kept_id"]) & (keyed["_own_hash"] == kept["_kept_hash"])
    return back(keyed.join(kept, on, "left_semi").dropDuplicates(["_own_id", "_own_hash"]))
