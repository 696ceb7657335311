"""Trees on cells against Spark's own on rows."""

import re

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablesmith.models import cells
from tablesmith.models import train as T


def rows(spark, n=4000, values=40):
    """A feature of more values than bins, one of few, and a target that both and something else decide."""
    x = F.pmod(F.xxhash64("id"), F.lit(values)).cast("double")
    y = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(6)).cast("double")
    noise = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)) / 25.0
    df = spark.range(n).select("id", x.alias("x"), y.alias("y"), (x * 2 + y * y + noise).alias("z"))
    return df.withColumn("cls", (F.col("z") > 55).cast("int"))


def guesses(model, data):
    return {r["id"]: r["prediction"] for r in model.transform(data).select("id", "prediction").collect()}


@pytest.mark.parametrize(
    "model,problem,params",
    [
        ("gradient_boosting", "classification", {"maxIter": 5}),
        ("xgboost", "regression", {"maxIter": 5}),
        ("decision_tree", "classification", {"maxDepth": 4, "minInstancesPerNode": 60}),
        ("decision_tree", "regression", {"maxDepth": 30, "minInstancesPerNode": 25}),
    ],
)
def test_same_model_as_on_rows(spark, model, problem, params):
    target = "cls" if problem == "classification" else "z"
    data = T.assemble(rows(spark), ["x", "y"], target, "id").persist()
    ours = T.fit_model(model, problem, data, **params)
    assert isinstance(ours, cells.CellModel)
    want = guesses(T.estimator(model, problem, **params).fit(data), data)
    got = guesses(ours, data)
    assert set(got) == set(want) and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-6)


def test_training_rows_are_bounded_by_bins(spark, monkeypatch):
    seen = []

    def build(model, problem, classes=2, **params):
        class Watch:
            def __init__(self):
                self.inner = T.estimator(model, problem, classes, **params)

            def hasParam(self, name):
                return self.inner.hasParam(name)

            def fit(self, data):
                seen.append(data.count())
                return self.inner.fit(data)

        return Watch()

    data = T.assemble(rows(spark, 30_000, 997), ["x", "y"], "z", "id").persist()
    cells.fit(build, "decision_tree", "regression", data, 2, {"maxDepth": 5}, 42)
    cells.fit(build, "random_forest", "regression", data, 2, {"numTrees": 3, "maxDepth": 5}, 42)
    assert len(seen) == 4 and max(seen) <= 32 * 6


@pytest.mark.parametrize("problem,target", [("classification", "cls"), ("regression", "z")])
def test_forest_like_spark(spark, problem, target):
    data = T.assemble(rows(spark), ["x", "y"], target, "id").persist()
    params = {"numTrees": 30, "maxDepth": 6}
    ours, spark_s = T.fit_model("random_forest", problem, data, **params), T.estimator("random_forest", problem, **params).fit(data)
    a, b = guesses(ours, data), guesses(spark_s, data)
    gap = np.array([a[k] - b[k] for k in b])
    assert set(a) == set(b) and (np.mean(gap != 0) < 0.02 if problem == "classification" else np.sqrt(np.mean(gap**2)) < 2.5)
    assert a == guesses(T.fit_model("random_forest", problem, data.repartition(3), **params), data)  # draws hang on the cell alone
    assert np.allclose(ours.featureImportances.toArray(), spark_s.featureImportances.toArray(), atol=0.05)
    if problem == "classification":
        first = ours.transform(data).select("prediction", "probability", "rawPrediction").first()
        assert sum(first["probability"]) == pytest.approx(1) and first["rawPrediction"][int(first["prediction"])] == max(first["rawPrediction"])


def test_draws_are_those_of_the_rows(spark):
    data = T.assemble(rows(spark), ["x", "y"], "z", "id")
    at = cells.cuts(data, 42)
    per_row = cells.binned(data, at).select("_bins", "label").persist()
    sizes = {tuple(r["_bins"]): (r["n"], r["m"]) for r in per_row.groupBy("_bins").agg(F.count("label").alias("n"), F.avg("label").alias("m")).collect()}
    found = cells._drawn(per_row, "regression", 400, 42).collect()
    assert {tuple(r["_bins"]) for r in found} == set(sizes) and len(found) == len(sizes)
    for r in found:
        n, mean = sizes[tuple(r["_bins"])]
        drawn, sums = np.array(r["bags"]), np.array(r["sums"])
        assert abs(drawn.mean() - n) < 6 * (n / 400) ** 0.5 and 0.6 < drawn.var() / n < 1.6  # Poisson of mean n
        assert sums.sum() / drawn.sum() == pytest.approx(mean, rel=0.05)


def test_search_scores_as_on_rows(spark):
    df = rows(spark)
    data = T.with_fold(T.assemble(df, ["x", "y"], "cls", "id"), "id", 3).persist()
    points = [{"maxDepth": d, "minInstancesPerNode": m, "impurity": "gini"} for d in (2, 30) for m in (1, 40)]
    got = T._point_scores(data, "decision_tree", "classification", 3, 2, points)
    for point, scores in zip(points, got):
        want = []
        for f in range(3):
            model = T.estimator("decision_tree", "classification", **point).fit(data.filter(F.col("fold") != f))
            want.append(T._score(model.transform(data.filter(F.col("fold") == f)), "classification"))
        assert scores == pytest.approx(want)
    number = T.with_fold(T.assemble(df, ["x", "y"], "z", "id"), "id", 3).persist()
    got = T._point_scores(number, "gradient_boosting", "regression", 3, 0, [{"maxIter": 3}])[0]
    for f in range(3):
        model = T.estimator("gradient_boosting", "regression", maxIter=3).fit(number.filter(F.col("fold") != f))
        assert got[f] == pytest.approx(T._score(model.transform(number.filter(F.col("fold") == f)), "regression"), rel=1e-6)


def test_bins_are_cut_as_spark_cuts(spark):
    data = T.assemble(rows(spark, 3000, 500), ["x", "y"], "z", "id").persist()
    tree = T.estimator("decision_tree", "regression", maxDepth=8).fit(data)
    used = {float(x) for x in re.findall(r"feature 0 <= ([-\d.eE]+)", tree.toDebugString)}
    assert used and used <= set(cells.cuts(data, 42)[0])
    bins = cells.binned(data, cells.cuts(data, 42)).select("_bins", vector_to_array("features").alias("v")).collect()
    assert all(r["_bins"][0] == sum(c < r["v"][0] for c in cells.cuts(data, 42)[0]) for r in bins[:200])


def test_forest_of_rows_that_share_no_cell(spark):
    df = spark.range(600).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(31))).cast("double").alias(f"x{i}") for i in range(5)])
    data = T.assemble(df.withColumn("z", F.col("x0") * 3 + F.col("x1")), [f"x{i}" for i in range(5)], "z", "id").persist()
    model = T.fit_model("random_forest", "regression", data, numTrees=10, maxDepth=6)
    assert isinstance(model, cells.CellModel) and model.featureImportances.toArray().argmax() == 0
    assert model.transform(data).count() == 600
