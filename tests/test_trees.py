"""Trees as expressions and node tables against Spark's own models and against DuckDB over the exported nodes."""

import random

import duckdb
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from tablesmith.operators import models as M
from tablesmith.plans import trees

FEATURES = ["a", "b c", "kind"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.gauss(0, 1), float(rng.randrange(5)), rng.choice(["u", "v", "w", "x"])) for i in range(600)]
    data = [(*r, r[1] * 2 + (r[2] > 2) + (r[3] in "ux") * 3 + rng.gauss(0, 0.2)) for r in data]
    df = spark.createDataFrame(data, "id int, a double, `b c` double, name string, label double")
    df = df.withColumn("two", (F.col("label") > 2).cast("double")).withColumn("three", F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.floor("label").cast("double"))))
    df = StringIndexer(inputCol="name", outputCol="kind", stringOrderType="alphabetAsc").fit(df).transform(df)
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df).cache()


MODELS = {
    "tree": (lambda: M.decision_tree_regressor(max_depth=5), "label"),
    "forest": (lambda: M.random_forest_regressor(num_trees=7, max_depth=4), "label"),
    "boosted": (lambda: M.gbt_regressor(max_iter=5, max_depth=3), "label"),
    "tree classes": (lambda: M.decision_tree_classifier(max_depth=4, label="three"), "three"),
    "forest classes": (lambda: M.random_forest_classifier(num_trees=6, max_depth=4, label="three"), "three"),
    "boosted classes": (lambda: M.gbt_classifier(max_iter=4, max_depth=3, label="two"), "two"),
}


@pytest.mark.parametrize("name", MODELS)
@pytest.mark.parametrize("form", ["case", "walk"])
def test_expressions_equal_the_model(rows, name, form):
    model = MODELS[name][0]().fit(rows)
    tree = trees.TreeModel(model, FEATURES)
    out = model.transform(rows).withColumn("mine", tree.prediction(form))
    if tree.classes:
        out = out.withColumn("p", F.array(*tree.probability(form)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    got = out.collect()
    assert all(abs(r.mine - r.prediction) < 1e-9 for r in got) and len({r.mine for r in got}) > 1
    if tree.classes:
        assert all(abs(x - y) < 1e-9 for r in got for x, y in zip(r.p, r.probability.toArray()))


def test_categorical_splits_are_listed(rows):
    """A column that the model knows as categorical is split by sets of values."""
    from pyspark.ml.feature import VectorIndexer
    model = Pipeline(stages=[VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=6),
                             M.decision_tree_regressor(max_depth=4, features="indexed")]).fit(rows)
    nodes = trees.node_table(model.stages[-1])
    assert nodes.where("categories is not null").count() > 0
    for form in ("case", "walk"):
        got = trees.tree_score(model.transform(rows).withColumnRenamed("prediction", "theirs"), model.stages[-1], FEATURES, form=form).collect()
        assert all(abs(r.prediction - r.theirs) < 1e-9 for r in got)


@pytest.mark.parametrize("name", ["tree", "forest", "boosted"])
def test_node_table_walks_alike_in_duckdb(rows, name):
    """The exported node table, walked by a recursive query of another engine, gives the model's predictions."""
    model = MODELS[name][0]().fit(rows)
    con = duckdb.connect()
    con.register("nodes", trees.node_table(model).toPandas())
    con.register("data", rows.select("id", "a", F.col("b c").alias("b"), "kind").toPandas())
    found = con.execute("""
        WITH RECURSIVE place AS (
          SELECT id, tree, weight, 0 AS node FROM data, (SELECT DISTINCT tree, weight FROM nodes)
          UNION ALL
          SELECT place.id, place.tree, place.weight, CASE WHEN CASE WHEN len(categories) > 0
            THEN list_contains(categories, [a, b, kind][feature + 1]) ELSE [a, b, kind][feature + 1] <= threshold END THEN "left" ELSE "right" END
          FROM place JOIN nodes USING (tree, node) JOIN data USING (id) WHERE feature >= 0)
        SELECT id, sum(place.weight * prediction) AS p, count(*) AS n FROM place JOIN nodes USING (tree, node) WHERE feature < 0 GROUP BY id""").fetchall()
    mine = {r.id: r.prediction for r in trees.tree_score(rows, model, FEATURES).collect()}
    assert all(abs(mine[i] - p / (n if name == "forest" else 1)) < 1e-9 for i, p, n in found) and len(found) == 600


def test_gaps_go_right_and_names_are_checked(spark, rows):
    model = MODELS["tree"][0]().fit(rows)
    odd = spark.createDataFrame([(None, 1.0, 0.0), (float("nan"), 1.0, 0.0), (float("inf"), 1.0, 0.0)], "a double, `b c` double, kind double")
    for form in ("case", "walk"):
        assert len({r.prediction for r in trees.tree_score(odd, model, FEATURES, form=form).collect()}) == 1
    with pytest.raises(ValueError):
        trees.TreeModel(model, ["a"])


def test_a_single_leaf(spark):
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, label double"))
    model = M.decision_tree_regressor().fit(df)
    for form in ("case", "walk"):
        assert [r.prediction for r in trees.tree_score(df, model, ["x"], form=form).collect()] == [5.0, 5.0]


@pytest.mark.parametrize("name", ["forest", "forest classes", "boosted"])
def test_many_nodes_are_added_up_not_walked(rows, name, monkeypatch):
    """A model of more nodes than one compiled CASE may hold adds its trees' CASE expressions; the values stay."""
    model = MODELS[name][0]().fit(rows)
    tree = trees.TreeModel(model, FEATURES)
    monkeypatch.setattr(trees, "CASE_NODES", tree.size - 1)
    out = model.transform(rows).withColumn("mine", tree.prediction())
    text = out._jdf.queryExecution().analyzed().toString()
    assert "aggregate(array(" in text and "sequence(" not in text
    assert out.where("mine <> prediction").count() == 0
