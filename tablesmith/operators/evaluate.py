"""Evaluation (V1-V4) as aggregates over (label, prediction / score) rows.

Each metric is one aggregate (or one grouping plus one aggregate), so it is
checkable in SQL and works on any number of rows; Spark's evaluators are
offered alongside for use inside tuning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import known, nan_to_null
from tablesmith.plans.ranking import cumulative_by_value


def eval_multiclass(df: DataFrame, label: str = "label", prediction: str = "prediction",
                    group: str | None = None) -> DataFrame:
    """V1: accuracy and weighted F1 (weights = class support), one row (or one per ``group``).

    Rows that miss the label or the prediction (null or NaN) are left out.

    Per class: precision = tp / predicted, recall = tp / actual, F1 = 0 when
    both are 0.  Built from the confusion counts (A17): a grouping whose size is
    classes^2.
    """
    g = [group] if group else []
    pairs = df.select(*g, known(df, label).alias("y"), known(df, prediction).alias("p")).dropna(subset=["y", "p"])
    cm = pairs.groupBy(*g, "y", "p").agg(F.count(F.lit(1)).alias("n"))
    side = F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("p").cast(dict(cm.dtypes)["y"]).alias("c"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"))))
    per = cm.select(*g, side.alias("s")).select(*g, "s.*").groupBy(*g, "c").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return per.groupBy(*g).agg(F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
                               F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("weighted_f1"),
                               F.sum("support").alias("n"))


def eval_auc(df: DataFrame, label: str = "label", score: str = "score", group: str | None = None) -> DataFrame:
    """V2: exact area under the ROC curve, ties counted one half.

    AUC = sum_v pos(v) * (neg(< v) + neg(v) / 2) / (P * N): per distinct score
    the positives and negatives, and the negatives below it from a
    range-partitioned running sum (``cumulative_by_value``), so no window holds
    all scores in one task.  Null with one class only; rows that miss label or score are left out.
    """
    g = [group] if group else []
    w = df.where(F.col(label).isNotNull()).select(
        *g, nan_to_null(F.col(score).cast("double")).alias("_s"), (F.col(label) == 1).cast("double").alias("pos"),
        (F.col(label) != 1).cast("double").alias("neg")).where(F.col("_s").isNotNull())
    cum = cumulative_by_value(w, "_s", ["pos", "neg"], g)
    return cum.groupBy(*g).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)),
                                F.first("total_pos") * F.first("total_neg")).alias("auc"),
                   F.first("total_pos").cast("long").alias("n_pos"),
                   F.first("total_neg").cast("long").alias("n_neg"))


def eval_regression(df: DataFrame, label: str = "label", prediction: str = "prediction",
                    group: str | None = None) -> DataFrame:
    """V3: RMSE, MAE and R^2 in one aggregate; R^2 = 1 - SS_res / SS_tot (null for a constant label).

    Rows that miss the label or the prediction (null or NaN) are left out of all four figures.
    """
    g = [group] if group else []
    pairs = df.select(*g, nan_to_null(F.col(label).cast("double")).alias("y"),
                      nan_to_null(F.col(prediction).cast("double")).alias("p")).dropna(subset=["y", "p"])
    err = F.col("y") - F.col("p")
    return pairs.groupBy(*g).agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
                     (F.lit(1.0) - F.try_divide(F.sum(err * err), F.var_pop("y") * F.count("y"))).alias("r2"),
                     F.count("y").alias("n"))


def eval_smape(df: DataFrame, label: str = "label", prediction: str = "prediction",
               group: str | None = None) -> DataFrame:
    """V4: symmetric MAPE = mean(2 |y - p| / (|y| + |p|)); pairs with y = p = 0 count 0, and those that miss either
    (null or NaN) do not count."""
    y, p = nan_to_null(F.col(label).cast("double")), nan_to_null(F.col(prediction).cast("double"))
    den = F.abs(y) + F.abs(p)
    term = F.when(den == 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.abs(y - p) / den)
    g = [group] if group else []
    return df.groupBy(*g).agg(F.avg(term).alias("smape"), F.count(term).alias("n"))
