"""Helpers shared by the query modules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablesmith.session import ensure_checkpoint_dir

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

LINEITEM_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART_NUM = ["p_size", "p_retailprice"]


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tablesmith-scratch/{name}-{uuid.uuid4().hex[:12]}"


def sql_round(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"
