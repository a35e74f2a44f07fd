"""Mixing sources to target weights by a low-discrepancy schedule (operator 1).

1. Every source's documents are put in a hashed order and laid end to end; the stream of
   words is cut into blocks of ``block`` words (a source's last one may be shorter).
2. Targets in words come from the weights, capped at ``max_repeat`` times a source's size,
   the excess reshared by weight (``plan_sources``).
3. Slot i of the schedule has the van der Corput point of i (its bits reversed).  The point
   falls into the cumulative weights of the sources, which names the slot's source; the
   number of earlier points in that interval, which has a closed form, is the slot's rank there.
4. Rank r of a source takes its block r modulo the number of blocks, in pass r // blocks.
   Slots join blocks on (source, block).  Slots beyond a source's target are left out, and
   what the schedule left short follows at its end, so a source's words meet its target.

Rules: a null text has no words; a null source is a source of its own, after all others; documents
without words take part with nothing to take; rows with equal ids are separate documents; rows that
agree in id and text share their order and are interchangeable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.llm.base import shielded, ship_package, text_of, word_count
from tablesmith.session import cut_lineage

BITS = 40
BLOCK_WORDS = 256
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Documents a bucket of the hashed order holds on average (one window group).
BUCKET_DOCS = 2048


# --- sources -----------------------------------------------------------------

@dataclass
class Sources:
    """The sources as a table: source_no, _name, source_size, target, words to take, need (slots), the points from lo to hi
    that are theirs, the got slots among the first ``length`` points, what is short, and the short slots before them."""
    table: DataFrame
    length: int
    block: int


def _running(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all smaller source_no, by totals of stretches of 65,536 numbers."""
    cut = rows.withColumn("_stretch", F.shiftright("source_no", 16))
    totals = cut.groupBy("_stretch").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row per 65,536 sources
    offsets = totals.select("_stretch", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_stretch").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    return (cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets, "_stretch")
            .withColumn(out, F.col("_offset") + F.col("_inside")).drop("_stretch", "_inside", "_offset"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """(source_no, _name, source_size): names in code point order, null last."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    missing = F.col("_name").isNull()
    ranged = cut_lineage(sizes.repartitionByRange(parts, missing, "_name").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(missing, "_name")) - 1
    return cut_lineage(ranged.withColumn("_place", place).join(offsets, "_part").select(
        (F.col("_offset") + F.col("_place")).alias("source_no"), "_name", "source_size"))


def plan_sources(rows: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK_WORDS) -> Sources:
    """Targets and points of every source of ``rows`` (_source, _size), on Spark; only totals reach the driver.

    Shares of all words by weight, none above ``max_repeat`` times its source's size: those above leave the sharing at
    their cap, until none is above.  Sums and comparisons are exact (decimals); the last division is a double's.
    """
    sizes = rows.groupBy(F.col("_source").alias("_name")).agg(F.sum("_size").alias("source_size"))
    named = _numbered(sizes)
    own = F.get(F.array(*map(F.lit, weights)), F.pmod("source_no", F.lit(len(weights))).cast("int"))
    named = named.withColumns({"_w": own, "_cap": F.col("source_size") * max_repeat})

    def sums(where: str) -> tuple[int, int, int]:
        r = named.where(where).agg(F.sum(F.col("source_size").cast("decimal(38,0)")), F.sum("_cap").cast("decimal(38,0)"), F.sum("_w")).first()
        return tuple(int(x or 0) for x in r)

    everything, _, all_weight = sums("true")
    money, weight = everything, all_weight
    while True:
        capped = f"CAST(_cap AS DECIMAL(19,0)) * CAST({weight} AS DECIMAL(18,0)) <= CAST(_w AS DECIMAL(9,0)) * CAST({money} AS DECIMAL(28,0))"
        _, gone, gone_weight = sums(capped)
        if (everything - gone, all_weight - gone_weight) == (money, weight):
            break
        money, weight = everything - gone, all_weight - gone_weight
        if not weight:
            break
    capped = capped if weight else "true"
    target = F.expr(f"CASE WHEN {capped} THEN CAST(_cap AS DOUBLE) ELSE CAST(CAST(_w AS DECIMAL(9,0)) * CAST({money} AS DECIMAL(28,0)) AS DOUBLE) "
                    f"/ {float(max(1, weight))!r}D END")
    size = F.col("source_size")
    parts = named.select("source_no", "_name", "source_size", target.alias("target")).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    parts = parts.withColumn("need", F.when(size > 0, F.expr(
        f"words div source_size * ((source_size + {block - 1}) div {block}) + (words % source_size + {block - 1}) div {block}")).otherwise(F.lit(0)))
    placed = cut_lineage(_running(parts, "need", "_before"))
    length = int(placed.agg(F.sum("need")).first()[0] or 0)
    assert length < 1 << BITS

    def point(n: str) -> Column:
        return F.expr(f"CAST({n} AS DECIMAL(20,0)) * CAST({1 << BITS} AS DECIMAL(14,0)) div CAST({max(1, length)} AS DECIMAL(20,0))")

    ship_package(rows.sparkSession)
    placed = placed.withColumns({"lo": point("_before"), "hi": point("_before + need")}).drop("_before")
    schema = T.StructType([*placed.schema.fields, T.StructField("got", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            n = np.full(len(lo), length, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(points_below(n, hi) - points_below(n, lo))], names=schema.names)

    counted = placed.mapInArrow(count, schema).withColumn("short", F.greatest(F.col("need") - F.col("got"), F.lit(0)))
    return Sources(cut_lineage(_running(cut_lineage(counted), "short", "short_before")), length, block)


# --- the schedule ------------------------------------------------------------

def reverse_bits(i: np.ndarray) -> np.ndarray:
    """The van der Corput point of each number, times 2 ** BITS."""
    out = np.zeros_like(i)
    for k in range(BITS):
        out |= ((i >> k) & 1) << (BITS - 1 - k)
    return out


def points_below(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many of the first n points lie below x: one closed count for each set bit of n."""
    total, offset = np.zeros_like(n), np.zeros_like(n)
    for k in range(BITS - 1, -1, -1):
        bit = (n >> k) & 1
        inside = -((offset - x) >> (BITS - k))  # ceil((x - offset) / 2 ** (BITS - k))
        total += bit * np.clip(inside, 0, 1 << k)
        offset += bit << (BITS - 1 - k)
    return total


def schedule(plan: Sources) -> DataFrame:
    """One row per slot: slot, source_no, pass_no, block_no and the words lo to hi of the source's stream.

    Points meet their source in buckets of the point space that hold about 64 points, and so at most as many sources.
    """
    spark = plan.table.sparkSession
    ship_package(spark)
    size, length = plan.block, plan.length
    shift = BITS - min(BITS, (length // 64).bit_length())

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = reverse_bits(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(x >> shift)], names=["slot", "x", "bucket"])

    slots = spark.range(length).mapInArrow(points, "slot long, x long, bucket long")
    spread = plan.table.where("hi > lo").withColumn("bucket", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
    met = slots.join(spread, "bucket").where("x >= lo AND x < hi").select("slot", "source_no", "source_size", "words", "need", "lo", "hi")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, lo, hi, need = (batch.column(c).to_numpy() for c in ("slot", "lo", "hi", "need"))
            rank = points_below(slot, hi) - points_below(slot, lo)
            keep = pa.array(rank < need)
            columns = [batch.column(c) for c in ("slot", "source_no", "source_size", "words")]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in [*columns, pa.array(rank)]],
                                             names=["slot", "source_no", "source_size", "words", "rank"])

    planned = met.mapInArrow(ranked, "slot long, source_no long, source_size long, words long, rank long")
    extra = plan.table.where("short > 0").withColumn("_extra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("short") - 1)))
    late = extra.select((F.lit(length) + F.col("short_before") + F.col("_extra")).alias("slot"), "source_no", "source_size", "words",
                        (F.col("got") + F.col("_extra")).alias("rank"))
    blocks = F.expr(f"(source_size + {size - 1}) div {size}")
    rows = planned.unionByName(late).withColumns({"pass_no": F.expr(f"rank div ((source_size + {size - 1}) div {size})"),
                                                  "block_no": F.col("rank") % blocks})
    lo = F.col("block_no") * size
    limit = F.when(F.col("pass_no") == F.expr("words div source_size"), F.col("words") % F.col("source_size")).otherwise(F.col("source_size"))
    return rows.select("slot", "source_no", "pass_no", "block_no", lo.alias("lo"), F.least(lo + size, limit).alias("hi"))


# --- documents ---------------------------------------------------------------

def measured(docs: DataFrame, keep_columns: bool = False) -> DataFrame:
    """doc_id, source, size in words and a 60-bit order key of every row (and all its own columns)."""
    text = text_of()
    key = F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    cols = {"_id": F.col("doc_id").cast("long"), "_source": F.col("source").cast("string"), "_size": word_count(text),
            "_order": F.conv(F.substring(key, 1, 15), 16, 10).cast("long")}
    return docs.select(*(docs.columns if keep_columns else []), *[c.alias(k) for k, c in cols.items()])


def positions(rows: DataFrame, plan: Sources, documents: int) -> DataFrame:
    """``rows`` with source_no, source_size, target and _start, the words before it in its source's hashed order.

    The order key, uniform by construction, is cut into buckets of about ``BUCKET_DOCS`` documents;
    a small table of (source, bucket) totals gives each its offset, so a source of any size
    spreads over many tasks.  Rows meet their source by an equi-join, whose side and skew are left to AQE.
    """
    names = plan.table.select("_name", "source_no", "source_size", "target")
    shift = 60 - max(0, (max(1, documents) // BUCKET_DOCS).bit_length())
    placed = (rows.join(names, F.col("_source").eqNullSafe(F.col("_name")))
              .drop("_name").withColumn("_bucket", F.shiftright("_order", shift)))
    totals = placed.groupBy("source_no", "_bucket").agg(F.sum("_size").alias("_words"))
    earlier = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source_no", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"))
    offsets = cut_lineage(offsets)
    inside = (Window.partitionBy("source_no", "_bucket").orderBy("_order", "_id", "_size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (placed.withColumn("_upto", F.sum("_size").over(inside)).join(offsets, ["source_no", "_bucket"])
            .withColumn("_start", F.col("_offset") + F.col("_upto") - F.col("_size"))
            .drop("_bucket", "_upto", "_offset"))


def mix_segments(placed: DataFrame, plan: Sources) -> DataFrame:
    """The mix: rows (slot, source_no, pass_no, block_no, _start, from_word, to_word), words counted in the document.

    Documents are cut where blocks end; slots and pieces join on (source, block), where a block
    meets at most its repeats and holds at most ``block`` documents.
    """
    size = plan.block
    end = F.col("_start") + F.col("_size")
    pieces = placed.where("_size > 0").select(
        "source_no", "_start", end.alias("_end"),
        F.explode(F.sequence(F.floor(F.col("_start") / size), F.floor((end - 1) / size))).alias("block_no"))
    slots = schedule(plan)
    lo = F.greatest("lo", "_start")
    hi = F.least("hi", "_end")
    return (slots.join(pieces, ["source_no", "block_no"]).where(lo < hi)
            .select("slot", "source_no", "pass_no", "block_no", "_start",
                    (lo - F.col("_start")).alias("from_word"), (hi - F.col("_start")).alias("to_word")))


def mix_counts(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and taken (words in the mix)."""
    rows = cut_lineage(measured(docs))
    plan = plan_sources(rows, weights, max_repeat, block)
    placed = cut_lineage(positions(rows, plan, rows.count()))
    taken = (mix_segments(placed, plan).groupBy("source_no", "_start")
             .agg(F.sum(F.col("to_word") - F.col("from_word")).alias("_taken")))
    return (placed.join(taken, ["source_no", "_start"], "left")
            .select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
                    F.when(F.col("_size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken")))


def mix_texts(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK_WORDS,
              whole_documents: bool = False) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: one row for each document and pass that takes it.

    A document at the end of a source's last pass keeps only its taken words (a prefix, as a
    pass takes blocks in order), joined by single spaces; its n_chars, if there is such a column, follows the text.
    With ``whole_documents`` it is taken as it is, or not at all if that leaves its source nearer its target.
    """
    docs, back = shielded(docs)
    cols = docs.columns
    rows = cut_lineage(measured(docs))
    plan = plan_sources(rows, weights, max_repeat, block)
    count = rows.count()
    placed = cut_lineage(positions(rows, plan, count))
    taken = (mix_segments(placed, plan).groupBy("source_no", "_start", "pass_no")
             .agg(F.max("to_word").alias("_upto_word")))
    carried = positions(measured(docs, keep_columns=True), plan, count).where("_size > 0")
    mixed = carried.join(taken, ["source_no", "_start"])
    if whole_documents:
        return back(mixed.where(2 * F.col("_upto_word") >= F.col("_size")).select(*cols))
    whole = F.col("_upto_word") >= F.col("_size")
    words = F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"),
                    F.lit(1), F.col("_upto_word").cast("int"))
    text = F.when(whole, F.col("text")).otherwise(F.array_join(words, " "))
    out = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in cols else {})
    return back(mixed.select(*[out[c].alias(c) if c in out else F.col(c) for c in cols]))
