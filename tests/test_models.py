import json
import math
import random
import statistics

import pytest

from tablesmith.models import bayes, nearest
from tablesmith.models import metrics as M
from tablesmith.models import train as T
from tablesmith.models.bayes import GaussianBayes
from tablesmith.models.validate import problem_type, validate


@pytest.fixture(scope="module")
def scored(spark):
    # label, prediction, score with ties
    rows = [(1, 1, 0.9), (0, 1, 0.8), (1, 1, 0.8), (0, 0, 0.3), (1, 0, 0.3), (0, 0, 0.1)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key long, label int, prediction int, score double")


def test_auc_counts_ties_half(scored):
    for rows_per_range in (2, None):
        assert M.roc_auc(scored, rows_per_range=rows_per_range).first()[0] == pytest.approx(7 / 9)
        roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in M.roc_curve(scored, rows_per_range=rows_per_range).collect()}
        assert roc[0.8] == (pytest.approx(1 / 3), pytest.approx(2 / 3)) and roc[0.1] == (1.0, 1.0)


def test_metrics_of_an_empty_class(spark):
    pred = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "c")], "label string, prediction string")
    report = {r["cls"]: r for r in M.class_report(pred).collect()}
    assert report["b"]["recall"] == 0 and report["c"]["support"] == 0 and report["c"]["precision"] == 0
    m = {r["metric"]: r["value"] for r in M.metrics_classification(pred).collect()}
    assert m["accuracy"] == pytest.approx(1 / 3) and m["balanced_accuracy"] == pytest.approx(0.25)


def test_constant_target_has_no_r2(spark):
    pred = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    m = {r["metric"]: r["value"] for r in M.metrics_regression(pred).collect()}
    assert m["r2"] is None and m["mae"] == 0.5 and m["median_absolute_error"] == 0.5


def test_normal_ppf(spark):
    df = spark.createDataFrame([(0.5,), (0.975,), (0.001,)], "p double").select(M.normal_ppf(__import__("pyspark").sql.functions.col("p")))
    got = [r[0] for r in df.collect()]
    assert got == [pytest.approx(0.0), pytest.approx(1.959963985, abs=1e-7), pytest.approx(-3.090232306, abs=1e-7)]


def test_best_model_leaves_failed_runs_out(spark):
    rows = [("a", "r2", 0.6, None), ("b", "r2", 0.8, None), ("c", "r2", 0.99, "boom")]
    best = M.best_model(spark.createDataFrame(rows, "model string, metric string, value double, error string"), "regression").first()
    assert (best["model"], best["grade"]) == ("b", "good")


def test_failed_model_is_reported(spark):
    df = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(60)], "id long, x double, y int")
    out = T.train_many(df, df, ["x"], "y", "id", ["decision_tree", "nonsense"]).collect()
    assert {r["model"] for r in out if r["error"]} == {"nonsense"}
    assert all(r["value"] == 0.0 for r in out if r["error"])


def test_splits(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)], "id long, y string")
    for rows_per_range in (40, None):
        out = T.split_stratified(df, "y", "id", 0.25, rows_per_range=rows_per_range)
        assert {(r["y"], r["count"]) for r in out.filter("is_test").groupBy("y").count().collect()} == {("a", 50), ("b", 25)}
    assert 30 < T.split_random(df, "id").filter("is_test").count() < 90


def test_problem_type_and_checks(spark):
    df = spark.createDataFrame([(1.0, None, "t", 5), (2.0, 3.0, "u", 5)], "x double, n double, t string, y int")
    assert problem_type(df, "t") == "classification" and problem_type(df, "y") == "classification"
    found = {(r["check_name"], r["column"]) for r in validate(df, ["x", "n", "t"], "y").collect()}
    assert found == {("feature_nulls", "n"), ("text_feature", "t"), ("few_rows", None), ("small_class", "y"), ("one_class", "y")}
    assert ("constant_target", "y") in {(r["check_name"], r["column"]) for r in validate(df, ["x"], "y", "regression").collect()}
    assert ("no_features", None) in {(r["check_name"], r["column"]) for r in validate(df, [], "y").collect()}


def table_of(spark, n=240, seed=4):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([0.0, 1.0, rnd.gauss(0, 2)]), rnd.gauss(0, 1), rnd.choice("abc")) for i in range(n)]
    rows = [(i, x + (c == "b"), y + 2 * (c == "c"), c, x + y * y) for i, x, y, c in rows]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, cls string, value double").repartition(5)


def folds_of(df, cv):
    return {r["id"]: r["fold"] for r in T.with_fold(df, "id", cv).collect()}


@pytest.mark.parametrize("sizes", [{}, {"donors_per_cell": 20, "donors_per_chunk": 15, "queries_per_chunk": 25}])
def test_lists_leave_the_own_fold_out(spark, sizes):
    rows, df = table_of(spark)
    fold = folds_of(df, 3)
    lists = nearest.neighbour_lists(T.with_fold(df, "id", 3), ["x", "y"], "cls", "id", 7, **sizes).collect()
    assert len(lists) == len(rows)
    for r in lists:
        _, x, y, _, _ = rows[r["id"]]
        want = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b, _, _ in rows if fold[j] != fold[r["id"]])[:7]
        assert [(n["rank"], n["label"]) for n in r["near"]] == [(k, rows[j][3]) for k, (_, j) in enumerate(want, 1)]
        assert [n["distance"] for n in r["near"]] == pytest.approx([d**0.5 for d, _ in want])


def plain_votes(near, k, weights, regression):
    w = [(1.0 if weights == "uniform" else min(1 / d, 1e12) if d else 1e12, v) for d, v in near[:k]]
    if regression:
        return sum(a * v for a, v in w) / sum(a for a, _ in w)
    votes = {}
    for a, v in w:
        votes[v] = votes.get(v, 0.0) + a
    return min(votes, key=lambda v: (-votes[v], v))


@pytest.mark.parametrize("target", ["cls", "value"])
def test_every_point_of_the_neighbour_grid(spark, target):
    rows, df = table_of(spark)
    fold = folds_of(df, 3)
    at = 3 if target == "cls" else 4
    got = T.grid_search(df, ["x", "y"], target, "id", "knn").collect()
    assert len(got) == 10 and [r["rank"] for r in got] == list(range(1, 11))
    for r in got:
        p, scores = json.loads(r["params"]), []
        for f in range(3):
            wrong = []
            for i, x, y, *_ in rows:
                if fold[i] == f:
                    near = [(d**0.5, rows[j][at]) for d, j in sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b, *_ in rows if fold[j] != f)]
                    guess = plain_votes(near, p["n_neighbors"], p["weights"], target == "value")
                    wrong.append(guess == rows[i][at] if target == "cls" else (guess - rows[i][at]) ** 2)
            scores.append(sum(wrong) / len(wrong))
        mean = sum(scores) / 3
        assert r["mean_score"] == pytest.approx(mean if target == "cls" else mean**0.5)
    cv = T.cross_validate(df, ["x", "y"], target, "id", "knn", 4, {"n_neighbors": 3, "weights": "distance"}).collect()
    assert len(cv) == 4 and cv[0]["mean"] == pytest.approx(sum(r["score"] for r in cv) / 4)


def plain_bayes(train, point, smoothing):
    n, best = len(train), None
    more = smoothing * max(statistics.pvariance([t[f] for t in train]) for f in (0, 1))
    for c in sorted({t[2] for t in train}):
        own = [t for t in train if t[2] == c]
        s = math.log(len(own) / n)
        for f in (0, 1):
            m, v = statistics.fmean(t[f] for t in own), statistics.pvariance([t[f] for t in own]) + more
            s -= 0.5 * math.log(2 * math.pi * v) + (point[f] - m) ** 2 / (2 * v)
        if best is None or s > best[0]:
            best = s, c
    return best[1]


def test_bayes_with_smoothing(spark):
    rows, df = table_of(spark)
    index = {"a": 0.0, "b": 1.0, "c": 2.0}
    data = T.assemble(df, ["x", "y"], "cls", "id")
    plain = [(x, y, index[c]) for _, x, y, c, _ in rows]
    for smoothing in (1e-9, 0.5):
        out = {r["id"]: r for r in GaussianBayes(smoothing).fit(data).transform(data).collect()}
        assert [out[i]["prediction"] for i in range(len(rows))] == [plain_bayes(plain, p, smoothing) for p in plain]
        assert all(sum(r["probability"]) == pytest.approx(1) and max(r["probability"]) == r["probability"][int(r["prediction"])] for r in out.values())
    fold = folds_of(df, 3)
    got = T.grid_search(df, ["x", "y"], "cls", "id", "naive_bayes", {"var_smoothing": [1e-9, 0.3, 5.0]}).collect()
    for r in got:
        smoothing, scores = json.loads(r["params"])["var_smoothing"], []
        for f in range(3):
            train = [p for i, p in enumerate(plain) if fold[i] != f]
            scores.append(statistics.fmean(plain_bayes(train, p, smoothing) == p[2] for i, p in enumerate(plain) if fold[i] == f))
        assert r["mean_score"] == pytest.approx(sum(scores) / 3)
    assert len({r["mean_score"] for r in got}) > 1
    with pytest.raises(ValueError):  # a constant within every class has no density without smoothing
        still = spark.createDataFrame([(i, 1.0, "ab"[i % 2]) for i in range(8)], "id long, x double, cls string")
        GaussianBayes(0.0).fit(T.assemble(still, ["x"], "cls", "id")).transform(T.assemble(still, ["x"], "cls", "id"))


def test_moments_of_folds_add_up(spark):
    _, df = table_of(spark)
    data = T.with_fold(T.assemble(df, ["x", "y"], "cls", "id"), "id", 4)
    whole, parts = bayes.moments(data), bayes.moments(data, "fold")
    for (_, c), m in whole.items():
        s = bayes._sum([p for (_, d), p in parts.items() if d == c])
        assert s.n == m.n and s.mean == pytest.approx(m.mean) and s.m2 == pytest.approx(m.m2)


def test_train_many_reports_auc_for_all_models(spark):
    rows, df = table_of(spark, 160)
    train, test = df.filter("id % 4 > 0"), df.filter("id % 4 = 0")
    out = T.train_many(train, test, ["x", "y"], "cls", "id", ["decision_tree", "knn", "naive_bayes"], cv=2).collect()
    assert not [r for r in out if r["error"]]
    auc = {r["model"]: r["value"] for r in out if r["metric"] == "roc_auc"}
    assert set(auc) == {"decision_tree", "knn", "naive_bayes"} and all(0.5 < v <= 1 for v in auc.values())
    assert {r["model"] for r in out if r["metric"] == "cv_mean"} == set(auc)
    tuned = T.train_many(train, test, ["x", "y"], "cls", "id", ["knn", "naive_bayes"], tune=True).collect()
    assert not [r for r in tuned if r["error"]]


def test_compared_models_share_the_assembled_rows(spark, monkeypatch):
    rnd = random.Random(11)
    rows = [(i, rnd.gauss(0, 1), float(i % 4), int(rnd.random() < 0.3 + 0.1 * (i % 4))) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x double, y double, c int")
    train, test = df.filter("k % 5 > 0"), df.filter("k % 5 = 0")
    made, spread = [], T.spread
    monkeypatch.setattr(T, "spread", lambda data: made.append(1) or spread(data))
    models = ["naive_bayes", "knn"]
    found = {(r["model"], r["metric"]): r["value"] for r in T.train_many(train, test, ["x", "y"], "c", "k", models, cv=2).collect()}
    assert len(made) == 1
    for m in models:
        one = T.cross_validate(train, ["x", "y"], "c", "k", m, 2).first()
        assert found[m, "cv_mean"] == pytest.approx(one["mean"], abs=1e-9) and found[m, "cv_std"] == pytest.approx(one["std"], abs=1e-9)
