"""Corpus pipeline over the documents table: five stages, each fed with all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  ``run`` writes every stage's rows as Parquet into the shared checkpoint folder and
reads them back, so a lost executor costs no more than a stage; what a stage leaves besides its rows is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablesmith.llm import bpe, mixing, quality_rules, secrets, simhash
from tablesmith.llm.base import table
from tablesmith.llm.registry import vocabulary
from tablesmith.session import cut_lineage, temporary_tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links (four-word shingles, at most 4 of 64 bits): the smallest id."""
    return simhash.keep_one(docs, radius=4, width=4)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark (n_chars follows the text)."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: one row per document and pass, texts unchanged."""
    return mixing.mix_texts(docs, whole_documents=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again: doc_id, n_tokens, digests of ids and text."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix),
    ("byte_bpe", tokens),
]

#: SQL expresses neither the fingerprints nor the tokens; tests/llm/test_pipeline.py holds the rows against a plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with temporary_tables(spark) as tables:
        for _, stage in STAGES:
            docs = cut_lineage(stage(spark, docs, sf_dir))
            tables.release(keep=docs)  # a stage's own tables and its input have served
    return docs
