"""Repeatable splits (L1-L4).

``randomSplit`` depends on partitioning (D14), so the default rule is a hash
of a key: the same row lands on the same side on any cluster layout, and the
rule can be checked in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import hash_bucket, hash_unit, in_share
from tablesmith.plans.ranking import hash_order_ranks, null_safe_join


def split_random(df: DataFrame, key: Sequence[str], train_share: float = 0.8, salt: str = "",
                 out: str = "split") -> DataFrame:
    """L1: 'train' when the key's 32-bit hash is below train_share * 2^32."""
    return df.withColumn(out, F.when(in_share(key, train_share, salt), "train").otherwise("test"))


def split_stratified(df: DataFrame, stratum: str | Sequence[str], key: Sequence[str], train_share: float = 0.8,
                     salt: str = "", out: str = "split") -> DataFrame:
    """L2: round(train_share * n_s) rows of every stratum go to train, chosen by hash order of the key (ties by key).
    A missing stratum is one too.

    Rows with the same key stay together: with unique keys the number is exact, with repeated ones the
    boundary key's rows all go to train.  Ranks are taken over (stratum, hash, key) only, spread over hash ranges
    (``hash_order_ranks``); they give each stratum the last (hash, key) of its train
    rows, and the rows themselves are only compared with that threshold.
    """
    names = df.columns
    strata = [f"c{names.index(c)}" for c in ([stratum] if isinstance(stratum, str) else stratum)]
    keys = [F.col(f"c{names.index(k)}") for k in key]
    order = F.struct(F.col("_h").alias("h"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    # columns by number, so that no name of the table meets a helper's
    hashed = df.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("_h", hash_unit(keys, salt))
    narrow = hashed.select(*strata, "_h", order.alias("_last"))
    ranked = hash_order_ranks(narrow, strata, "_h", ["_last"], out="_rank")
    n_train = F.floor(F.col("_group_n") * F.lit(train_share) + F.lit(0.5))
    last = ranked.where(F.col("_rank") == n_train - 1).select(*strata, "_last")
    placed = null_safe_join(hashed, last, strata, "left")
    train = F.coalesce(order <= F.col("_last"), F.lit(False))
    return placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != out],
                         F.when(train, "train").otherwise("test").alias(out))


def split_chronological(df: DataFrame, ts: str, train_share: float = 0.8, out: str = "split") -> DataFrame:
    """L3: time <= min + share * (max - min) -> train (epoch seconds); a missing time gives null.

    A wall-clock ``timestamp_ntz`` is measured from 1970-01-01 00:00 wall time,
    so the cut does not depend on the session time zone.
    """
    from pyspark.sql.types import TimestampNTZType
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        secs = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)") / F.lit(1e6)
    else:
        secs = F.col(ts).cast("timestamp").cast("double")
    mm = df.agg(F.min(secs).alias("lo"), F.max(secs).alias("hi")).collect()[0]
    if mm["lo"] is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    cutoff = mm["lo"] + train_share * (mm["hi"] - mm["lo"])
    return df.withColumn(out, F.when(secs <= F.lit(cutoff), "train").when(secs.isNotNull(), "test"))


def kfold(df: DataFrame, key: Sequence[str], k: int = 5, salt: str = "fold", out: str = "fold") -> DataFrame:
    """L4: fold number 0..k-1 from the key hash (an int column for foldCol)."""
    return df.withColumn(out, hash_bucket(key, k, salt))
