"""Queries: learners (M1-M9) and tuning / comparison / automatic search / run log.

Learners without randomness are fitted a second time in SQL (``sql_models``) and compared by their predictions.
For the forests and the linear SVM the oracles state what must hold whatever the solver does: every input row is
scored with a finite prediction, the model is at least as good as the best constant on its rows, and a forest's
column expression equals the model; every setting of a search is tried and measured.
"""

from __future__ import annotations

from pyspark.ml.evaluation import (BinaryClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablesmith.functions.columns import round_half_away, sql_hash_bucket, sql_in_share
from tablesmith.operators import kernels as KN
from tablesmith.operators import models as M
from tablesmith.operators import split as SP
from tablesmith.operators import tune as TU
from tablesmith.operators.features import feature_pipeline
from tablesmith.queries import register
from tablesmith.plans.cells import CellFit, cells_of
from tablesmith.plans.trees import TreeModel, tree_score
from tablesmith.queries import sql_models as Q
from tablesmith.queries.common import T, scratch_path
from tablesmith.session import cut_lineage


def binary_frame(spark, sf):
    """Document quality label with length, language and source features."""
    d = T(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = T(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    df = d.join(lab, "doc_id").withColumn("log_chars", F.log1p(F.col("n_chars").cast("double")))
    feats = feature_pipeline(["log_chars"], ["lang", "source"], out="features").fit(df)
    return feats.transform(df).select("doc_id", "label", "features")


def multiclass_frame(spark, sf):
    e = T(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("label"),
                    array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


REG_NUM = ["l_quantity", "l_discount", "l_tax"]


def regression_frame(spark, sf):
    li = T(spark, sf, "lineitem")
    feats = feature_pipeline(REG_NUM, ["l_returnflag", "l_linestatus"], out="features", scale=False).fit(li)
    return feats.transform(li).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("label"),
                                      "features")


def _checked(df, key, classes: bool, *more):
    """key, label, scored (the prediction is finite) and at_least_constant (for all rows: no worse than the
    majority class, or than the mean)."""
    keys = [key] if isinstance(key, str) else list(key)
    p = df.select(*keys, "label", F.col("prediction").cast("double").alias("prediction"), *more)
    if classes:
        share = p.groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("s")).first()["s"]
        good = p.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a")).first()["a"] >= share - 1e-12
    else:
        r = p.agg(F.sum((F.col("label") - F.col("prediction")) ** 2).alias("e"),
                  (F.var_pop("label") * F.count("label")).alias("t")).first()
        good = r["e"] <= r["t"]
    finite = F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.abs("prediction") < float("inf"))
    return p.select(*keys, "label", finite.cast("int").alias("scored"), F.lit(int(good)).alias("at_least_constant"),
                    *[c for c in p.columns if c not in (*keys, "label", "prediction")])


_CLASSES = "SELECT vec_id, label::DOUBLE AS label, 1 AS scored, 1 AS at_least_constant FROM embeddings"


# --- frames whose features have few distinct values each (thresholds between all of them), also in SQL

PRICE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
PRICE_SQL = ("d AS (SELECT l_orderkey, l_linenumber AS line, l_extendedprice AS label, "
             + ", ".join(f"{c}::DOUBLE AS f_{j}" for j, c in enumerate(PRICE_FEATURES)) + " FROM lineitem)")
QUALITY_SQL = """d AS (
  SELECT q.*, labels.quality::DOUBLE AS label, 2 * labels.quality::DOUBLE - 1 AS sign FROM (
    SELECT doc_id, length(bin(greatest(n_chars, 1)))::DOUBLE AS f_0, dense_rank() OVER (ORDER BY coalesce(lang, ''))::DOUBLE AS f_1,
      dense_rank() OVER (ORDER BY coalesce(source, ''))::DOUBLE AS f_2 FROM documents) q JOIN labels USING (doc_id))"""


def price_frame(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    li = T(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("label"),
                                         *[F.col(c).cast("double").alias(f"f_{j}") for j, c in enumerate(PRICE_FEATURES)])
    return VectorAssembler(inputCols=[f"f_{j}" for j in range(len(PRICE_FEATURES))], outputCol="features").transform(li)


def quality_frame(spark, sf):
    """Labelled documents with the binary digits of their length, and language and source numbered alphabetically."""
    from pyspark.ml.feature import VectorAssembler
    d = T(spark, sf, "documents")

    def number(c):
        names = sorted(r[0] for r in d.select(F.coalesce(c, F.lit(""))).distinct().collect())  # a handful of names
        return F.array_position(F.array(*map(F.lit, names)), F.coalesce(c, F.lit(""))).cast("double")
    size = F.length(F.bin(F.greatest("n_chars", F.lit(1)))).cast("double")
    d = d.select("doc_id", size.alias("f_0"), number("lang").alias("f_1"), number("source").alias("f_2")).join(
        T(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    return VectorAssembler(inputCols=["f_0", "f_1", "f_2"], outputCol="features").transform(d)


def _expression(df, model, k, *keys, out="prediction", digits=4):
    """Keys, label and the prediction that the model's column expression gives."""
    names = [f"f_{j}" for j in range(k)]
    return tree_score(df, model, names).select(*keys, "label", round_half_away("prediction", digits).alias(out))


def _forest_checked(df, model, k, key, classes):
    """``_checked`` of the expression's predictions, and whether they equal the model's own."""
    both = model.transform(df).withColumn("_mine", TreeModel(model, [f"f_{j}" for j in range(k)]).prediction())
    same = (F.abs(F.col("_mine") - F.col("theirs")) < 1e-9).cast("int").alias("same_as_model")
    return _checked(both.withColumnRenamed("prediction", "theirs").withColumn("prediction", F.col("_mine")), key, classes, same)


@register("logistic_regression", f"""WITH {QUALITY_SQL},
{Q.logistic_ctes("d", ["f_0", "f_1", "f_2"], "label", 0.01)}
SELECT doc_id, label, round(1 / (1 + exp(-({" + ".join(f"nt_12.x_{j} * z_{j}" for j in range(4))}))), 4) AS probability FROM nt_z, nt_12""")
def q_lr(spark, sf):
    """Probability of quality; the oracle solves the same penalised likelihood by Newton's method."""
    from pyspark.ml.functions import vector_to_array
    d = quality_frame(spark, sf)
    m = M.logistic_regression(max_iter=500, reg=0.01).setTol(1e-14).fit(d)
    return m.transform(d).select("doc_id", "label", round_half_away(vector_to_array("probability")[1], 4).alias("probability"))


@register("decision_tree_classifier", f"""WITH {QUALITY_SQL},
{Q.tree_ctes("d", 3, "label", 4, True)}
SELECT doc_id, label, CASE WHEN leaf > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction, round(leaf, 6) AS probability FROM t""")
def q_dtc(spark, sf):
    """Class and leaf share, from the tree as a column expression; the oracle grows the tree in SQL."""
    d = quality_frame(spark, sf)
    tree = TreeModel(M.decision_tree_classifier(max_depth=4, max_bins=64).fit(d), ["f_0", "f_1", "f_2"])
    return d.select("doc_id", "label", tree.prediction().alias("prediction"), round_half_away(tree.probability()[1], 6).alias("probability"))


@register("random_forest_classifier", "SELECT doc_id, quality::DOUBLE AS label, 1 AS scored, 1 AS at_least_constant, 1 AS same_as_model "
                                      "FROM documents JOIN labels USING (doc_id)")
def q_rfc(spark, sf):
    d = quality_frame(spark, sf)
    return _forest_checked(d, M.random_forest_classifier(num_trees=20, max_depth=5).fit(d), 3, "doc_id", True)


@register("linear_svc", _CLASSES)
def q_svc(spark, sf):
    d = multiclass_frame(spark, sf)
    return _checked(M.fit_predict(M.linear_svc(reg=0.01, max_iter=20), d)[1], "vec_id", True)


_RING = {"a": "(l_quantity - 25.5) / 12.0", "b": "(l_discount - 0.05) / 0.025"}


def _kernel_sql(n, gamma, seed):
    maps = ["sqrt(2.0 / {}) * cos({} + {!r})".format(n, " + ".join(f"{w!r}::DOUBLE * ({e})" for w, e in zip(ws, _RING.values())), b)
            for ws, b in KN.fourier_weights(len(_RING), n, gamma, seed)]
    return "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [" + ", ".join(f"round({m}, 6)" for m in maps) + "] AS features FROM lineitem"


@register("kernel_features", _kernel_sql(4, 0.5, 7))
def q_kernel_features(spark, sf):
    """Four random Fourier features of every row; the constants stand in the oracle."""
    from pyspark.ml.functions import vector_to_array
    li = T(spark, sf, "lineitem").withColumns({c: F.expr(e).cast("double") for c, e in _RING.items()})
    out = KN.KernelMap(list(_RING), n=4, gamma=0.5, seed=7).transform(li)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.transform(vector_to_array("features"), lambda x: round_half_away(x, 6)).alias("features"))


@register("kernel_svc", """SELECT 'linear' AS machine, count(*) AS n, 0 AS separates FROM lineitem
UNION ALL SELECT 'rbf', count(*), 1 FROM lineitem""")
def q_kernel_svc(spark, sf):
    """Rows inside a ring of quantity and discount: the rbf machine tells at least 95 % of them from the others, the linear one does not."""
    li = T(spark, sf, "lineitem").select(*[F.expr(e).cast("double").alias(c) for c, e in _RING.items()])
    li = li.withColumn("label", (F.col("a") * F.col("a") + F.col("b") * F.col("b") < 1.6).cast("double"))
    from pyspark.ml.feature import VectorAssembler
    plain = VectorAssembler(inputCols=list(_RING), outputCol="features")
    scored = {"linear": KN.CountedFit(list(_RING), [plain], M.linear_svc(multiclass=False, max_iter=20)).fit(li).transform(li),
              "rbf": KN.kernel_svc(list(_RING), n=60, gamma=0.7, multiclass=False, max_iter=20).fit(li).transform(li)}
    out = [d.agg(F.lit(m).alias("machine"), F.count(F.lit(1)).alias("n"),
                 (F.avg((F.col("label") == F.col("prediction")).cast("double")) >= 0.95).cast("int").alias("separates")) for m, d in scored.items()]
    return out[0].unionByName(out[1])


@register("gbt_classifier", f"""WITH {QUALITY_SQL},
{Q.boosted_ctes("d", 3, "sign", 4, 3, 0.1, ["doc_id", "label"], logistic=True)}
SELECT doc_id, label, CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction, round(1 / (1 + exp(-2 * score)), 5) AS probability FROM boosted""")
def q_gbtc(spark, sf):
    """Four boosted trees as a column expression; the oracle boosts in SQL."""
    d = quality_frame(spark, sf)
    tree = TreeModel(M.gbt_classifier(max_iter=4, max_depth=3).setMaxBins(64).fit(d), ["f_0", "f_1", "f_2"])
    return d.select("doc_id", "label", tree.prediction().alias("prediction"), round_half_away(tree.probability()[1], 5).alias("probability"))


@register("decision_tree_regressor", f"""WITH {PRICE_SQL},
{Q.tree_ctes("d", 4, "label", 4, False)}
SELECT l_orderkey, line, label, round(leaf, 4) AS prediction FROM t""")
def q_dtr(spark, sf):
    """Leaf means from the tree as a column expression; the oracle grows the tree in SQL."""
    d = price_frame(spark, sf)
    return _expression(d, M.decision_tree_regressor(max_depth=4, max_bins=64).fit(d), 4, "l_orderkey", "line")


@register("decision_tree_text", f"""WITH {PRICE_SQL},
{Q.tree_ctes("d", 4, "label", 3, False)}
{" UNION ALL ".join(f"SELECT {lv} AS level, feature::INTEGER AS feature, round(threshold, 6) AS threshold FROM t_b{lv}" for lv in range(3))}""")
def q_dt_text(spark, sf):
    """The splits that the tree's text lists: level (from the indent), feature and threshold."""
    m = M.decision_tree_regressor(max_depth=3, max_bins=64).fit(price_frame(spark, sf))
    lines = spark.createDataFrame([(x,) for x in m.toDebugString.splitlines()], "text string")
    split = r"^( +)If \(feature (\d+) <= ([^)]+)\)"
    found = lines.where(F.col("text").rlike(split))
    part = [F.regexp_extract("text", split, i) for i in (1, 2, 3)]
    return found.select((F.length(part[0]) - 2).alias("level"), part[1].cast("int").alias("feature"),
                        round_half_away(part[2].cast("double"), 6).alias("threshold"))


@register("random_forest_regressor", "SELECT l_orderkey, l_linenumber AS line, l_extendedprice AS label, 1 AS scored, "
                                     "1 AS at_least_constant, 1 AS same_as_model FROM lineitem")
def q_rfr(spark, sf):
    d = price_frame(spark, sf)
    return _forest_checked(d, M.random_forest_regressor(num_trees=10, max_depth=5).fit(d), 4, ["l_orderkey", "line"], False)


@register("gbt_regressor", f"""WITH {PRICE_SQL},
{Q.boosted_ctes("d", 4, "label", 4, 3, 0.1, ["l_orderkey", "line"])}
SELECT l_orderkey, line, label, round(score, 3) AS prediction FROM boosted""")
def q_gbtr(spark, sf):
    """Four boosted trees as a column expression; the oracle boosts in SQL."""
    d = price_frame(spark, sf)
    return _expression(d, CellFit(M.gbt_regressor(max_iter=4, max_depth=3).setMaxBins(64)).fit(d), 4, "l_orderkey", "line", digits=3)


@register("linear_regression", f"""WITH {PRICE_SQL},
{Q.ridge_ctes("d", ["f_0", "f_1", "f_2", "f_3"], "label", 0.1)}
SELECT l_orderkey, line, label, round({Q.linear(["f_0", "f_1", "f_2", "f_3"], "ls")}, 2) AS prediction FROM d, ls""")
def q_linreg(spark, sf):
    """Ridge regression on four features; the oracle solves the normal equations."""
    d = price_frame(spark, sf)
    p = M.fit_predict(M.linear_regression(reg=0.1), d)[1]
    return p.select("l_orderkey", "line", "label", round_half_away("prediction", 2).alias("prediction"))


@register("linear_regression_1d", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def q_linreg_1d(spark, sf):
    """One-feature least squares: Spark ML's solution equals SQL regr_slope / regr_intercept."""
    from pyspark.ml.feature import VectorAssembler
    from tablesmith.functions.columns import round_half_away_value
    li = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(T(spark, sf, "lineitem")) \
        .withColumnRenamed("l_extendedprice", "label")
    m = M.linear_regression(features="features").fit(li)
    return spark.createDataFrame([(round_half_away_value(float(m.coefficients[0]), 4),
                                   round_half_away_value(float(m.intercept), 4))], "slope double, intercept double")


# ------------------------------------------------------------------ V5-V11

@register("grid_cv", """SELECT params, 1 AS measured, 1 AS near_constant_or_better FROM (VALUES
('{"maxBins": 16, "maxDepth": 3}'), ('{"maxBins": 32, "maxDepth": 3}'), ('{"maxBins": 16, "maxDepth": 5}'),
('{"maxBins": 32, "maxDepth": 5}')) v(params) WHERE (SELECT count(*) FROM lineitem) > 0""")
def q_grid_cv(spark, sf):
    """Tree regression grid (depth x bins) x 3 hash folds, 4 fits at once; prices hardly follow the
    features, so each setting's RMSE on unseen rows stays within 5 % of the spread, or below it."""
    d = SP.kfold(regression_frame(spark, sf), ["l_orderkey", "l_linenumber"], 3, out="fold")
    est = M.decision_tree_regressor()
    _, table = TU.grid_cv(est, {"maxDepth": [3, 5], "maxBins": [16, 32]}, RegressionEvaluator(metricName="rmse"),
                          d, fold_col="fold", parallelism=4)
    spread = d.agg(F.stddev_pop("label")).first()[0]
    return table.select("params", F.col("metric").isNotNull().cast("int").alias("measured"),
                        (F.col("metric") < 1.05 * spread).cast("int").alias("near_constant_or_better"))


@register("random_search", """SELECT i + 1 AS place, 'LogisticRegression' AS family, 'ok' AS status, 1 AS in_space
FROM range(8) r(i) WHERE (SELECT count(*) FROM labels) > 0""")
def q_random_search(spark, sf):
    """Eight drawn settings, all measured and inside their space."""
    d = binary_frame(spark, sf)
    space = {"regParam": TU.Space("loguniform", 1e-4, 1.0), "elasticNetParam": TU.Space("uniform", 0.0, 1.0)}
    _, table = TU.random_search(M.logistic_regression(), space, BinaryClassificationEvaluator(), d, n_trials=8, key=["doc_id"])
    reg, net = (F.get_json_object("params", f"$.{c}").cast("double") for c in ("regParam", "elasticNetParam"))
    place = F.row_number().over(Window.orderBy(F.col("metric").desc_nulls_last(), "params"))  # one row per setting
    return table.select(place.cast("long").alias("place"), "family", "status",
                        (reg.between(1e-4, 1.0) & net.between(0.0, 1.0)).cast("int").alias("in_space"))


@register("guided_search", """SELECT i AS trial, 'ok' AS status, i >= 6 AS guided, 1 AS in_space FROM range(10) r(i)
WHERE (SELECT count(*) FROM labels) > 0""")
def q_guided_search(spark, sf):
    """Ten trials in two sittings over one log: six plain draws, then proposals from what the log holds."""
    from tablesmith.operators import guided as G
    d = quality_frame(spark, sf)
    space = {"regParam": TU.Space("loguniform", 1e-4, 1.0), "elasticNetParam": TU.Space("uniform", 0.0, 1.0)}
    log, ev = TU.RunLog(spark, scratch_path(spark, "guided")), BinaryClassificationEvaluator()
    for n in (6, 10):
        _, table = G.guided_search(M.logistic_regression(), space, ev, d, log, "quality", n, 4, 2, ["doc_id"], startup=6)
    reg, net = (F.get_json_object("setting", f"$.{c}").cast("double") for c in ("regParam", "elasticNetParam"))
    return table.select(F.col("trial").cast("long").alias("trial"), "status", "guided",
                        (reg.between(1e-4, 1.0) & net.between(0.0, 1.0)).cast("int").alias("in_space"))


@register("model_compare", """SELECT family, 2 AS n_settings, 2 AS n_ok FROM (VALUES ('logistic_regression'),
('decision_tree'), ('random_forest')) v(family) WHERE (SELECT count(*) FROM labels) > 0""")
def q_model_compare(spark, sf):
    d = binary_frame(spark, sf)
    fams = {"logistic_regression": (M.logistic_regression(), {"regParam": [0.01, 0.1]}),
            "decision_tree": (M.decision_tree_classifier(), {"maxDepth": [3, 5]}),
            "random_forest": (M.random_forest_classifier(num_trees=10), {"maxDepth": [3, 5]})}
    board, _ = TU.model_compare(fams, BinaryClassificationEvaluator(), d, folds=3, key=["doc_id"])
    return board.select("family", "n_settings", "n_ok")


@register("train_validate", f"""SELECT count(*) AS n_validated, 1 AS better_than_chance
FROM embeddings WHERE NOT {sql_in_share(['vec_id'], 0.8, 'tv')}""")
def q_train_validate(spark, sf):
    """Weighted F1 on the held-out fifth, against one over the number of classes."""
    e = T(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"),
                                         *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    s = SP.split_random(e, ["vec_id"], 0.8, salt="tv")
    feats = [f"e{i}" for i in range(64)]
    test = s.where("split = 'test'")
    _, f1 = TU.train_validate(s.where("split = 'train'"), test, feats, "label", 2, 32, 6)
    classes = e.select(F.count_distinct("label")).first()[0]
    return test.agg(F.count(F.lit(1)).alias("n_validated"), F.lit(int(f1 > 1 / classes)).alias("better_than_chance"))


def _prepared_sql(regs, folds=3):
    """Ridge regression on each fold's training rows, gaps filled by their mean; mean RMSE over the folds per setting."""
    fold = sql_hash_bucket(["l_orderkey", "l_linenumber"], folds, "fold")
    cols = {"f_0": "l_quantity", "f_1": "nullif(l_discount, 0)", "f_2": "l_tax"}
    parts = [f"b AS MATERIALIZED (SELECT {fold} AS fold, l_extendedprice AS label, "
             + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in cols.items()) + " FROM lineitem)"]
    found = []
    for f in range(folds):
        means = ", ".join(f"avg({c}) AS {c}" for c in cols)
        parts.append(f"m{f} AS (SELECT {means} FROM b WHERE fold <> {f})")
        filled = ", ".join(f"coalesce(b.{c}, m{f}.{c}) AS {c}" for c in cols)
        parts.append(f"d{f} AS MATERIALIZED (SELECT fold, label, {filled} FROM b, m{f})")
        parts.append(f"t{f} AS MATERIALIZED (SELECT * FROM d{f} WHERE fold <> {f})")
        for i, reg in enumerate(regs):
            parts.append(Q.ridge_ctes(f"t{f}", list(cols), "label", reg, f"ls{f}_{i}"))
            found.append(f"SELECT {reg!r}::DOUBLE AS reg, sqrt(avg((label - ({Q.linear(list(cols), f'ls{f}_{i}')})) ** 2)) AS rmse "
                         f"FROM d{f}, ls{f}_{i} WHERE fold = {f}")
    return ("WITH " + ",\n".join(parts) + "\nSELECT '{\"regParam\": ' || reg || '}' AS params, round(avg(rmse), 4) AS metric FROM ("
            + " UNION ALL ".join(found) + ") GROUP BY reg")


@register("grid_cv_prepared", _prepared_sql([0.0, 2000.0]))
def q_grid_cv_prepared(spark, sf):
    """Ridge grid x 3 hash folds over raw columns; gaps and scales come from each fold's training rows."""
    li = T(spark, sf, "lineitem").withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    d = SP.kfold(li, ["l_orderkey", "l_linenumber"], 3, out="fold")
    _, _, table = TU.grid_cv_prepared(M.linear_regression(), {"regParam": [0.0, 2000.0]}, RegressionEvaluator(metricName="rmse"), d,
                                      ["l_quantity", "l_discount", "l_tax"], [], "fold", 3, label="l_extendedprice")
    return table.select("params", round_half_away("metric", 4).alias("metric"))


def _families(board, better):
    """Per family: trials, those that were measured, and whether the search's best trial beats a constant."""
    best = board.agg((F.max if better > 0 else F.min)("metric").alias("m")).first()["m"]
    good = best is not None and (best > better if better > 0 else best < -better)
    return board.groupBy("family").agg(F.count(F.lit(1)).alias("n_trials"), F.count("metric").alias("n_ok")).withColumn(
        "best_beats_constant", F.lit(int(good)))


def _families_sql(first, source):
    return f"""SELECT family, 2 AS n_trials, 2 AS n_ok, 1 AS best_beats_constant FROM (VALUES ('{first}'), ('decision_tree'),
('random_forest'), ('gbt')) v(family) WHERE (SELECT count(*) FROM {source}) > 0"""


@register("auto_classify", _families_sql("logistic_regression", "labels"))
def q_auto_classify(spark, sf):
    """Eight trials: two of each family, with three threads (no multiple of the families)."""
    d = T(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source").join(
        T(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    board = TU.auto_classify(d, "quality", ["n_chars"], ["lang", "source"], max_trials=8, timeout_minutes=30,
                             parallelism=3, folds=2, key=["doc_id"])
    return _families(board, 0.5)


@register("auto_regress", _families_sql("linear_regression", "part"))
def q_auto_regress(spark, sf):
    p = T(spark, sf, "part")
    board = TU.auto_regress(p, "p_retailprice", ["p_size", "p_partkey"], ["p_type"], max_trials=8,
                            timeout_minutes=30, parallelism=4, folds=2, key=["p_partkey"])
    return _families(board, -float(p.agg(F.stddev_pop("p_retailprice")).first()[0]))


@register("run_log", """SELECT 'lineitem_price' AS experiment, 'decision_tree' AS family, 2 AS n_runs, 1 AS best_is_least
WHERE (SELECT count(*) FROM lineitem) > 0""")
def q_run_log(spark, sf):
    """Log one run per tree depth (RMSE on a hash split), then look the best run up."""
    split = SP.split_random(regression_frame(spark, sf), ["l_orderkey", "l_linenumber"], 0.8, salt="runs")
    d = cut_lineage(split.select("split", "label", "features"))  # every fit and measurement reads it
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    cells = cells_of(train, M.decision_tree_regressor())
    log = TU.RunLog(spark, scratch_path(spark, "runs"))
    ev = RegressionEvaluator(metricName="rmse")
    for depth in (2, 4):
        m = cells.fit(M.decision_tree_regressor(max_depth=depth))
        log.log("lineitem_price", f"tree_d{depth}", {"maxDepth": depth}, {"rmse": ev.evaluate(m.transform(test))},
                {"family": "decision_tree"})
    best = log.best("lineitem_price", "rmse", larger_is_better=False)
    every = log.runs().agg(F.count(F.lit(1)).cast("int").alias("n_runs"), F.min(F.col("metrics")["rmse"]).alias("least"))
    return best.join(F.broadcast(every)).select(  # one row each
        "experiment", F.col("tags")["family"].alias("family"), "n_runs",
        (F.col("metrics")["rmse"] == F.col("least")).cast("int").alias("best_is_least"))
