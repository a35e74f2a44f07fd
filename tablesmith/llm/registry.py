"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablesmith.llm import oracles
from tablesmith.llm.base import table

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_mix_sources", oracles.MIX)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import mixing
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


@register("op6_simhash_groups")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import simhash
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fp_hex().alias("fingerprint"), "component_id")


@register("op2_nearest_vectors")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import ann
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@register("op3_quality_cascade", oracles.QUALITY)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import quality_rules
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@register("op4_secret_scan", oracles.SECRETS)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import secrets
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


@register("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import toxicity
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op8_quality_trees")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import quality_model
    return quality_model.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op9_chat_examples", oracles.CHAT)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import chat
    return chat.digests(chat.with_tricky(spark, table(spark, sf_dir, "conversations")))


@register("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import bpe
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


@register("op10_token_planes")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import token_files
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@register("op11_lexical_search", oracles.LEXICAL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import lexical
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


@register("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import runs
    return runs.run_digests(table(spark, sf_dir, "documents"))


@register("op13_piece_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablesmith.llm import pieces
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, QueryFn]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
