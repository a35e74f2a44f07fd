"""Feature selection (K1-K10) and the two joins it needs.

Statistic-based scores (correlation, F, variance, chi-square, mutual
information) are computed for all features in one aggregate or one
unpivoted grouping; model-based scores fit Spark ML learners.  Score tables
are (feature, score, ...) DataFrames with one row per feature.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.columns import equal_width_bin, nan_free, quoted, round_half_away, safe_corr
from tablesmith.plans import quantiles as Q
from tablesmith.plans.boosting import boosted_importances

#: Rows that a task of a learner holds, whatever the size of the input's files and splits.
ROWS_PER_TASK = 250_000


def select_by_correlation(df: DataFrame, features: Sequence[str], target: str,
                          threshold: float = 0.3) -> DataFrame:
    """K1: |corr(x, target)| for every feature from one aggregate; keep > threshold."""
    one = nan_free(df, [*features, target]).agg(*[safe_corr(F.col(quoted(c)), F.col(quoted(target))).alias(f"r{i}") for i, c in enumerate(features)])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("corr")) for i, c in enumerate(features)]
    long = one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return (long.withColumn("abs_corr", F.abs("corr"))
            .withColumn("selected", (F.col("abs_corr") > F.lit(threshold)).cast("int")))


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10,
                       target_bins: int | None = None, equal_width: bool = False) -> DataFrame:
    """K2: plug-in mutual information (nats) between each binned feature and
    the (binned, if ``target_bins``) target.  (``plans.neighbours`` has the
    nearest-neighbour estimator.)

    Features are cut into
    ``bins`` quantile bins (equal cuts merge), or with ``equal_width`` into bins of equal
    width over [min, max]; MI = sum p(x,y) log(p(x,y) / (p(x) p(y))).  Rows that miss the feature or
    the target (null or NaN) are left out for that feature.  The totals come from groupings of the
    joint counts, joined on their keys, so no window holds a feature's whole table.
    """
    cols = list(features) + ([target] if target_bins else [])
    wanted = {c: target_bins if target_bins and i == len(features) else bins for i, c in enumerate(cols)}
    if equal_width:
        one = df.agg(*[e for i, c in enumerate(cols) for e in (F.min(Q.valid_value(c)).alias(f"lo{i}"),
                                                               F.max(Q.valid_value(c)).alias(f"hi{i}"))]).collect()[0]
        binned = [equal_width_bin(F.col(c), one[f"lo{i}"], one[f"hi{i}"], wanted[c])
                  if one[f"lo{i}"] is not None else F.lit(None).cast("int") for i, c in enumerate(cols)]
    else:
        most = sorted({i / n for n in wanted.values() for i in range(1, n)})
        found = Q.exact_quantiles(df, list(dict.fromkeys(cols)), most)
        at = {p: i for i, p in enumerate(most)}
        # a value's bin is the number of cuts below it: of the doubles after the cuts, those at most the value
        edges = {f"_v{j}": [math.nextafter(x, math.inf) for x in sorted({found[c][at[i / wanted[c]]] for i in range(1, wanted[c])} - {None})]
                 for j, c in enumerate(cols)}
        df = Q.placed(df.select(F.col(target).alias("_target"), *[Q.valid_value(c).alias(f"_v{j}") for j, c in enumerate(cols)]),
                      edges, {v: f"_b{v}" for v in edges})
        binned, target = [F.col(f"_b{v}") for v in edges], "_target"
    y = binned[-1] if target_bins else F.col(target)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), x.cast("int").alias("xb")) for c, x in zip(features, binned)])
    long = (df.select(y.alias("_y"), F.explode(pairs).alias("s")).select("s.feature", "s.xb", "_y")
            .where(F.col("xb").isNotNull() & F.col("_y").isNotNull()))
    if not target_bins:
        long = nan_free(long, ["_y"]).where(F.col("_y").isNotNull())
    from tablesmith.session import cut_lineage
    joint = cut_lineage(long.groupBy("feature", "xb", "_y").agg(F.count(F.lit(1)).cast("double").alias("nxy")))
    nx = joint.groupBy("feature", "xb").agg(F.sum("nxy").alias("nx"))
    ny = joint.groupBy("feature", "_y").agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy("feature").agg(F.sum("nxy").alias("n"))
    j = joint.join(nx, ["feature", "xb"]).join(ny, ["feature", "_y"]).join(n, "feature")
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return j.groupBy("feature").agg(F.sum(term).alias("mi"))


def rfe(df: DataFrame, features: Sequence[str], label: str, n_keep: int = 8, step: int = 1) -> DataFrame:
    """K3: recursive elimination with a linear model on standardised features:
    refit, drop the smallest |coefficient|, until ``n_keep`` remain.  Rank 1 =
    kept; higher ranks were dropped earlier.

    One aggregate gives all covariances (rows complete in features and label); every refit is
    the least-squares solution of the remaining features' normal equations, k x k numbers on the driver.
    """
    import numpy as np
    cols = [*features, label]
    rows = nan_free(df.select(*[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])).dropna()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    one = rows.agg(*[F.covar_samp(f"c{i}", f"c{j}").alias(f"v{k}") for k, (i, j) in enumerate(pairs)]).first()
    cov = np.zeros((len(cols), len(cols)))
    for k, (i, j) in enumerate(pairs):
        cov[i, j] = cov[j, i] = one[f"v{k}"] or 0.0
    spread = np.sqrt(np.diag(cov))
    scale = np.where(spread > 0, spread, 1.0)
    corr = cov / np.outer(scale, scale)
    remaining, ranks, rank = list(range(len(features))), {}, max(1, len(features) - n_keep + 1)
    while len(remaining) > n_keep:
        coef = np.abs(np.linalg.lstsq(corr[np.ix_(remaining, remaining)], corr[remaining, -1], rcond=None)[0])
        order = sorted(range(len(remaining)), key=lambda i: (coef[i], features[remaining[i]]))
        drop = [remaining[i] for i in order[:min(step, len(remaining) - n_keep)]]
        ranks.update({i: rank for i in drop})
        rank -= 1
        remaining = [i for i in remaining if i not in drop]
    return df.sparkSession.createDataFrame([(c, ranks.get(i, 1), int(i not in ranks)) for i, c in enumerate(features)],
                                           "feature string, rank int, selected int")


def bounded_partitions(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` in partitions of about ``rows`` rows, if it has fewer partitions: a learner's task reads its partition's cached rows."""
    needed = -(-df.count() // rows)
    return df.repartition(needed) if needed > df.rdd.getNumPartitions() else df


def tree_importance(df: DataFrame, features: Sequence[str], label: str, kind: str = "forest",
                    num_trees: int = 100, max_depth: int = 10, max_iter: int = 50, seed: int = 42,
                    boosted_depth: int = 5, max_bins: int = 32) -> DataFrame:
    """K4: forest (100 trees, depth 10) or boosted trees (50 rounds, depth 5) importances.

    Of equal gains of a boosted tree's node the first feature's lowest cut wins (``plans.boosting``).
    """
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    vec = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="skip").transform(df) \
        .select("_f", F.col(label).cast("double").alias("_label"))
    if kind == "forest":
        est = RandomForestRegressor(featuresCol="_f", labelCol="_label", numTrees=num_trees, maxDepth=max_depth,
                                    maxBins=max_bins, seed=seed)
        imp = est.fit(bounded_partitions(vec)).featureImportances.toArray()
    else:
        est = GBTRegressor(featuresCol="_f", labelCol="_label", maxIter=max_iter, maxDepth=boosted_depth, maxBins=max_bins,
                           seed=seed)
        imp = boosted_importances(vec, est)
    return df.sparkSession.createDataFrame([(c, float(imp[i])) for i, c in enumerate(features)],
                                           "feature string, importance double")


def select_from_model(importances: DataFrame, score: str = "importance") -> DataFrame:
    """K5: keep features whose importance is at least the median importance."""
    med = importances.agg(F.percentile(score, 0.5).alias("m")).collect()[0]["m"]  # one row per feature
    return importances.withColumn("selected", (F.col(score) >= F.lit(med)).cast("int"))


def select_k_best_f(df: DataFrame, features: Sequence[str], target: str, k: int = 10) -> DataFrame:
    """K6: univariate regression F statistic r^2 / (1 - r^2) * (n - 2), top k.

    n counts rows where both the feature and the target are present.  A feature with |r| = 1 (to 12 digits) has an
    infinite F and comes first; one without spread has none and comes last.
    """
    df, aggs = nan_free(df, [*features, target]), []
    for i, c in enumerate(features):
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        aggs += [safe_corr(F.col(quoted(c)), F.col(quoted(target))).alias(f"r{i}"), F.sum(both.cast("long")).alias(f"n{i}")]
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
               for i, c in enumerate(features)]
    long = one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    r2 = F.col("r") * F.col("r")
    f = F.when(F.abs(F.col("r")) >= 1 - 1e-12, F.lit(float("inf"))).otherwise(F.try_divide(r2, F.lit(1.0) - r2) * (F.col("n") - 2))
    scored = long.withColumn("f_score", f)
    w = Window.orderBy(F.col("f_score").desc_nulls_last(), F.col("feature"))  # one row per feature
    return scored.withColumn("rank", F.row_number().over(w)).withColumn(
        "selected", (F.col("rank") <= k).cast("int")).drop("n")


def variance_threshold(df: DataFrame, features: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """K7: sample variance per feature; keep variance > threshold (Spark's rule)."""
    one = nan_free(df, features).agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(features)])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(features)]
    long = one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return long.withColumn("selected", (F.col("variance") > F.lit(threshold)).cast("int"))


def chi_square_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """K8: Pearson chi-square of each (categorical / binned) feature against a
    categorical label, from contingency counts: one unpivoted grouping.

    Output: feature, chi2, dof.  Continuous features must be binned first (the
    reference's continuous label made Spark abort).
    """
    long = (df.select(F.col(label).cast("string").alias("_y"),
                      F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("x"))
                                          for c in features])).alias("s"))
            .select("s.feature", "s.x", "_y").where(F.col("x").isNotNull() & F.col("_y").isNotNull()))
    # the contingency table holds observed cells only; chi2 = n * (sum o^2 / (nx ny) - 1) over them
    from tablesmith.session import cut_lineage
    obs = cut_lineage(long.groupBy("feature", "x", "_y").agg(F.count(F.lit(1)).cast("double").alias("o")))
    xs = obs.groupBy("feature", "x").agg(F.sum("o").alias("nx"))
    ys = obs.groupBy("feature", "_y").agg(F.sum("o").alias("ny"))
    tot = (xs.groupBy("feature").agg(F.sum("nx").alias("n"), F.count(F.lit(1)).alias("kx"))
           .join(ys.groupBy("feature").agg(F.count(F.lit(1)).alias("ky")), "feature"))
    cells = obs.join(xs, ["feature", "x"]).join(ys, ["feature", "_y"])
    share = cells.groupBy("feature").agg(F.sum(F.col("o") * F.col("o") / (F.col("nx") * F.col("ny"))).alias("s"))
    return share.join(tot, "feature").select(
        "feature", (F.col("n") * (F.col("s") - 1)).alias("chi2"), ((F.col("kx") - 1) * (F.col("ky") - 1)).cast("int").alias("dof"))


def chi_square_select(df: DataFrame, features: Sequence[str], label: str, k: int = 10) -> DataFrame:
    s = chi_square_scores(df, features, label)
    w = Window.orderBy(F.col("chi2").desc_nulls_last(), F.col("feature"))  # one row per feature
    return s.withColumn("rank", F.row_number().over(w)).withColumn("selected", (F.col("rank") <= k).cast("int"))


def rank_align(rankings: dict[str, DataFrame], n: int = 10, score: str = "score",
               name: str = "feature") -> DataFrame:
    """Top-n of several rankings side by side by rank (one column per method).

    Each ranking is one row per feature; after top-n every side is at most n rows.
    """
    out = None
    for method, r in rankings.items():
        w = Window.orderBy(F.col(score).desc_nulls_last(), F.col(name))
        top = (r.select(name, score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
               .select("rank", F.col(name).alias(method)))
        out = top if out is None else out.join(top, "rank", "full")
    return out


def selection_summary(df: DataFrame, features: Sequence[str], target: str, n: int = 10, bins: int = 10,
                      target_bins: int | None = 10) -> DataFrame:
    """K9: top-n of correlation, F-test, mutual information and variance side by side.

    The target is binned like the features for MI unless ``target_bins`` is None
    (a categorical target)."""
    corr = select_by_correlation(df, features, target).select("feature", F.col("abs_corr").alias("score"))
    fs = select_k_best_f(df, features, target).select("feature", F.col("f_score").alias("score"))
    mi = mutual_information(df, features, target, bins, target_bins).select("feature", F.col("mi").alias("score"))
    var = variance_threshold(df, features).select("feature", F.col("variance").alias("score"))
    rounded = {k: v.withColumn("score", round_half_away("score", 9))
               for k, v in {"correlation": corr, "f_test": fs, "mutual_info": mi, "variance": var}.items()}
    return rank_align(rounded, n)


def append_columns(df: DataFrame, derived: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Bind derived columns to their rows: same lineage -> no join needed
    (pass ``key=None``); otherwise an equi-join on the key."""
    if key is None:
        new = [c for c in derived.columns if c not in df.columns]
        return derived.select(*df.columns, *new)
    return df.join(derived, list(key), "left")


def model_importance(model, names: Sequence[str], spark) -> DataFrame:
    """Importance of each named input of a fitted tree model, sorted."""
    imp = model.featureImportances.toArray()
    rows = sorted(((names[i], float(imp[i])) for i in range(len(names))), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame(rows, "feature string, importance double")
