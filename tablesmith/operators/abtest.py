"""A/B assignment and per-variant metrics.

Assignment is a hash of the request (or user) id into 100 buckets, so it is
stateless, layout-free and the same in batch, in a stream and in SQL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.columns import hash_bucket, known
from tablesmith.operators.evaluate import eval_auc, eval_multiclass, eval_regression


def _variant_of(bucket: Column, shares: Mapping[str, int]) -> Column:
    if sum(shares.values()) != 100:
        raise ValueError("shares must add up to 100")
    expr, acc = None, 0
    for name, share in shares.items():
        acc += share
        cond = bucket < F.lit(acc)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def ab_assign_random(df: DataFrame, request_id: Sequence[str] | str, shares: Mapping[str, int],
                     salt: str = "ab", out: str = "variant") -> DataFrame:
    """Per request, variant by cumulative percentage (e.g. {"A": 90, "B": 10})."""
    key = [request_id] if isinstance(request_id, str) else list(request_id)
    return df.withColumn(out, _variant_of(hash_bucket(key, 100, salt), shares))


def ab_assign_sticky(df: DataFrame, user_id: str, shares: Mapping[str, int], experiment: str,
                     out: str = "variant") -> DataFrame:
    """The same user always gets the same variant within one experiment
    (hash of experiment salt + user id)."""
    return df.withColumn(out, _variant_of(hash_bucket([user_id], 100, f"{experiment}:"), shares))


def force_variant(df: DataFrame, requested: str | Column, assigned: str = "variant",
                  out: str = "variant") -> DataFrame:
    """An explicit variant in the request overrides the split."""
    req = F.col(requested) if isinstance(requested, str) else requested
    return df.withColumn(out, F.coalesce(req, F.col(assigned)))


def ab_metrics(feedback: DataFrame, variant: str = "variant", prediction: str = "prediction",
               truth: str = "ground_truth", control: str | None = None) -> DataFrame:
    """Per variant n, accuracy, mean prediction; difference in accuracy to
    the control variant with its standard error sqrt(p1 q1 / n1 + p0 q0 / n0) (null if the control has no rows).
    Rows that miss the prediction or the truth (null or NaN) are left out, as in V1-V4."""
    correct = (F.col(prediction) == F.col(truth)).cast("double")
    feedback = feedback.where(known(feedback, prediction).isNotNull() & known(feedback, truth).isNotNull())
    per = feedback.groupBy(variant).agg(F.count(F.lit(1)).alias("n"), F.avg(correct).alias("accuracy"),
                                        F.avg(F.col(prediction).cast("double")).alias("mean_prediction"))
    if control is None:
        return per
    every = Window.partitionBy()  # one row per variant
    is_control = F.col(variant) == control
    n0, p0 = (F.max(F.when(is_control, F.col(c))).over(every) for c in ("n", "accuracy"))
    p1 = F.col("accuracy")
    return per.select(variant, "n", "accuracy", "mean_prediction", (p1 - p0).alias("diff_vs_control"),
                      F.sqrt(p1 * (1 - p1) / F.col("n") + p0 * (1 - p0) / n0).alias("se_vs_control"))


def ab_evaluate(feedback: DataFrame, variant: str = "variant", prediction: str = "prediction",
                truth: str = "ground_truth", score: str | None = None) -> DataFrame:
    """B7 with V1-V3: per variant accuracy and weighted F1, RMSE, MAE and R^2, and with ``score`` the AUC."""
    out = eval_multiclass(feedback, truth, prediction, variant).join(
        eval_regression(feedback, truth, prediction, variant).drop("n"), variant, "left")
    return out.join(eval_auc(feedback, truth, score, variant), variant, "left") if score else out
