"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, so that tasks can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="tablesmith-"), "tablesmith_source.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "tablesmith")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, with a missing one read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: Columns of the documents table; a table may have more.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its further columns under names that nothing else uses, and how to get its columns back."""
    names = [c if c in DOCUMENT_COLUMNS else f"_further_{i}" for i, c in enumerate(docs.columns)]

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
    return docs.toDF(*names), back


def word_count(text: Column) -> Column:
    """Number of words, without building them: gaps become single spaces."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def slices(batch: pa.RecordBatch, sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of about ``budget`` size units each (at least one row)."""
    lo, used = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and used + n > budget:
            yield lo, i
            lo, used = i, 0
        used += n
    if lo < len(sizes):
        yield lo, len(sizes)
