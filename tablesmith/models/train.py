"""Splits, model fits on Spark ML, cross-validation, grid search and model comparison."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from typing import Any

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.knn import knn_join
from ..functions.numbers import hash_key
from ..functions.order import rank_by_hash
from ..functions.schema import col, is_numeric
from ..session import small_or_cut
from . import bayes, cells, nearest
from .bayes import GaussianBayes
from .metrics import metrics_classification, metrics_regression, roc_auc_of_chances
from .validate import problem_type

SEED = 42

# ---- splits


def _threshold(share: float) -> str:
    return format(min(int(share * (1 << 32)), (1 << 32) - 1), "08x")


def split_random(df: DataFrame, key: str, test: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``; the hash of the key decides, so no sort and the same split on every run."""
    return df.withColumn("is_test", F.substring(hash_key(col(key), seed), 1, 8) < F.lit(_threshold(test)))


def split_stratified(
    df: DataFrame, target: str, key: str, test: float = 0.2, seed: int = SEED, rows_per_range: int | None = None
) -> DataFrame:
    """Adds ``is_test`` with the share met in every class: the first ceil(share * rows) by hash."""
    counts = small_or_cut(df.groupBy(col(target).alias("_cls")).agg(F.count(F.lit(1)).alias("_n")))
    rows = df.count()
    ranked = rank_by_hash(df, key, seed, [target], rows, rows_per_range)
    joined = ranked.join(counts, col(target).eqNullSafe(F.col("_cls")))
    return joined.withColumn("is_test", F.col("_rank") <= F.ceil(F.lit(test) * F.col("_n"))).drop("_rank", "_cls", "_n")


def assemble(df: DataFrame, features: list[str], target: str | None = None, key: str | None = None) -> DataFrame:
    """``([key,] [label,] features)``; rows with a NULL feature are an error, as a matrix has no gaps."""
    keep = [c for c in (key, target) if c]
    data = df.select(*dict.fromkeys([*keep, *features]))
    data = data.withColumns({f: col(f).cast("double") for f in features if f not in keep})
    out = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(data)
    if target:
        if is_numeric(df, target):
            out = out.withColumn("label", col(target).cast("double"))
        else:
            out = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(out).transform(out)
    return out.select(*([key] if key else []), *(["label"] if target else []), "features")


def spread(data: DataFrame) -> DataFrame:
    """Persisted training data on all cores; the caller unpersists.

    An input of few splits is redistributed once, as fits read it many times.
    """
    kept = data.persist()
    kept.count()
    cores = data.sparkSession.sparkContext.defaultParallelism
    if kept.rdd.getNumPartitions() >= cores:
        return kept
    wide = kept.repartition(cores).persist()
    wide.count()
    kept.unpersist()
    return wide


# ---- models

CLASSIFIERS = ("logistic_regression", "decision_tree", "random_forest", "svm", "knn", "naive_bayes", "gradient_boosting", "xgboost")
REGRESSORS = ("linear_regression", "ridge", "lasso", "decision_tree", "random_forest", "svr", "knn", "gradient_boosting", "xgboost")


# What the models start from where nothing is said, in Spark's names. Depth 30 is Spark's deepest tree and stands for no limit;
# the memory lets a pass over the table split many nodes of a deep tree.
DEFAULTS: dict[tuple[str, str], dict[str, Any]] = {
    ("classification", "logistic_regression"): {"maxIter": 100, "standardization": False},
    ("classification", "svm"): {"maxIter": 100, "standardization": False},
    **{(p, "decision_tree"): {"maxDepth": 30, "maxMemoryInMB": 1024} for p in ("classification", "regression")},
    **{(p, "random_forest"): {"numTrees": 100, "maxDepth": 30, "maxMemoryInMB": 1024} for p in ("classification", "regression")},
    **{(p, "gradient_boosting"): {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3} for p in ("classification", "regression")},
    **{(p, "xgboost"): {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6} for p in ("classification", "regression")},
}
#: models whose penalty is an inverse strength C shared by all rows; Spark's is a strength per row
PENALISED = ("logistic_regression", "svm")


def estimator(model: str, problem: str, classes: int = 2, **params):
    """Spark ML estimator for a model name. "xgboost" is gradient boosting with deeper trees and larger steps.

    Penalised models take ``regParam``; ``fit_model`` derives it from C = 1 and the number of rows where neither is given.
    """
    own = {**DEFAULTS.get((problem, model), {}), **params}
    if problem == "classification":
        if model == "logistic_regression":
            return LogisticRegression(**own)
        if model == "decision_tree":
            return DecisionTreeClassifier(**{"seed": SEED, **own})
        if model == "random_forest":
            return RandomForestClassifier(**{"seed": SEED, **own})
        if model == "naive_bayes":
            return GaussianBayes(**own)
        inner = None
        if model == "svm":
            inner = LinearSVC(**own)
        elif model in ("gradient_boosting", "xgboost"):
            inner = GBTClassifier(**{"seed": SEED, **own})
        if inner is not None:
            return OneVsRest(classifier=inner, parallelism=min(4, classes)) if classes > 2 else inner
    else:
        if model == "linear_regression":
            return LinearRegression(**own)
        if model in ("ridge", "lasso"):
            return LinearRegression(**{"regParam": 0.1, "elasticNetParam": 0.0 if model == "ridge" else 1.0, **own})
        if model == "decision_tree":
            return DecisionTreeRegressor(**{"seed": SEED, **own})
        if model == "random_forest":
            return RandomForestRegressor(**{"seed": SEED, **own})
        if model == "svr":
            return LinearSVR(**own)
        if model in ("gradient_boosting", "xgboost"):
            return GBTRegressor(**{"seed": SEED, **own})
    raise ValueError(f"unknown {problem} model '{model}'")


def fit_model(model: str, problem: str, train: DataFrame, classes: int = 2, **params):
    """The fitted model; a penalty that is not given is C = 1, in Spark's terms one over the number of rows. Trees are trained on cells."""
    if model in PENALISED and "regParam" not in params:
        params = {**params, "regParam": 1.0 / max(train.count(), 1)}
    if cells.fits(model, params):
        return cells.fit(estimator, model, problem, train, classes, {**DEFAULTS.get((problem, model), {}), **params}, SEED)
    return estimator(model, problem, classes, **params).fit(train)


class LinearSVR:
    """Linear regression with epsilon-insensitive loss, by full-batch subgradient steps.

    Features and label are standardised; every step is one aggregate over the table. The
    coefficients are the mean over the second half of the steps.
    """

    def __init__(self, C: float = 1.0, epsilon: float = 0.1, iterations: int = 60, rate: float = 0.5):
        self.C, self.epsilon, self.iterations, self.rate = C, epsilon, iterations, rate
        self.w: list[float] = []
        self.b = 0.0

    def fit(self, data: DataFrame) -> "LinearSVR":
        x = data.select(vector_to_array("features").alias("x"), F.col("label").alias("y"))
        p = len(x.first()["x"])
        cols = [F.col("x")[i] for i in range(p)]
        row = x.agg(F.count(F.lit(1)), F.avg("y"), F.stddev_pop("y"), *[fn(c) for c in cols for fn in (F.avg, F.stddev_pop)]).first()
        n, ym, ys = row[0], row[1], row[2] or 1.0
        stats = [(row[3 + 2 * i], row[4 + 2 * i] or 1.0) for i in range(p)]
        z = x.select(
            *[((c - F.lit(m)) / F.lit(s)).alias(f"z{i}") for i, (c, (m, s)) in enumerate(zip(cols, stats))],
            ((F.col("y") - F.lit(ym)) / F.lit(ys)).alias("t"),
        ).persist()
        try:
            w, b = [0.0] * p, 0.0
            mean_w, mean_b, used = [0.0] * p, 0.0, 0
            for step in range(1, self.iterations + 1):
                fit = F.lit(b)
                for i in range(p):
                    fit = fit + F.lit(w[i]) * F.col(f"z{i}")
                gap = F.col("t") - fit
                side = F.when(gap > self.epsilon, 1.0).when(gap < -self.epsilon, -1.0).otherwise(0.0)
                g = z.withColumn("g", side).agg(F.avg("g"), *[F.avg(F.col("g") * F.col(f"z{i}")) for i in range(p)]).first()
                rate = self.rate / step**0.5
                w = [wi - rate * (wi / (self.C * n) - g[1 + i]) for i, wi in enumerate(w)]
                b += rate * g[0]
                if step > self.iterations // 2:
                    mean_w = [a + c for a, c in zip(mean_w, w)]
                    mean_b, used = mean_b + b, used + 1
        finally:
            z.unpersist()
        w, b = [a / used for a in mean_w], mean_b / used
        self.w = [ys * wi / s for wi, (_, s) in zip(w, stats)]
        self.b = ym + ys * b - sum(wi * m for wi, (m, _) in zip(self.w, stats))
        return self

    def transform(self, data: DataFrame) -> DataFrame:
        total = F.lit(self.b)
        for i, wi in enumerate(self.w):
            total = total + F.lit(wi) * vector_to_array("features")[i]
        return data.withColumn("prediction", total)


def knn_predict(
    train: DataFrame, test: DataFrame, features: list[str], target: str, key: str, problem: str, n_neighbors: int = 5, weights: str = "uniform", classes: list | None = None
) -> DataFrame:
    """``(key, label, prediction)``: vote (smallest label on ties) or mean of the nearest training rows.

    With ``classes`` also ``chances``, each one's part of the votes.
    """
    near = knn_join(test, train, features, n_neighbors, key, key, payload=[target])
    near = near.withColumn("_w", nearest.weight(F.col("_distance"), weights))
    if problem == "classification":
        votes = near.groupBy(key, target).agg(F.sum("_w").alias("_v"))
        shares = [F.try_divide(F.sum(F.when(col(target) == F.lit(c), F.col("_v")).otherwise(0.0)), F.sum("_v")) for c in classes or []]
        best = votes.groupBy(col(key).alias("_k")).agg(
            F.min_by(target, F.struct(-F.col("_v"), col(target))).alias("prediction"), *([F.array(*shares).alias("chances")] if shares else [])
        )
    else:
        best = near.groupBy(col(key).alias("_k")).agg((F.sum(col(target) * F.col("_w")) / F.sum("_w")).alias("prediction"))
    # rows without neighbours (a missing feature) stay, without a prediction
    out = test.join(best, col(key) == F.col("_k"), "left")
    return out.select(key, col(target).alias("label"), "prediction", *(["chances"] if "chances" in best.columns else []))


def fit_predict(model: str, problem: str, train: DataFrame, test: DataFrame, classes: int = 2, **params) -> DataFrame:
    """Predictions on the test part from ``(key, label, features)`` frames."""
    return predictions(fit_model(model, problem, train, classes, **params), test, problem)


def predictions(fitted, test: DataFrame, problem: str) -> DataFrame:
    """``(.., prediction)``; for classifiers ``score``, the second class's, and ``chances``, all classes', where the model has them.

    Several boosted models against the rest have margins instead of chances, which rank rows as well; a linear SVM has a margin alone.
    """
    out = fitted.transform(test)
    keep = [c for c in test.columns if c != "features"]
    if problem != "classification":
        return out.select(*keep, "prediction")

    def array(name: str):
        return F.col(name) if out.schema[name].dataType.typeName() == "array" else vector_to_array(name)

    margins_only = isinstance(fitted, LinearSVCModel) or any(isinstance(m, LinearSVCModel) for m in getattr(fitted, "models", []))
    if "probability" in out.columns:
        out = out.withColumn("chances", array("probability"))
    elif "rawPrediction" in out.columns and not margins_only:
        out = out.withColumn("chances", array("rawPrediction"))
    elif "rawPrediction" in out.columns:
        return out.select(*keep, "prediction", array("rawPrediction")[1].alias("score"))
    else:
        return out.select(*keep, "prediction")
    return out.select(*keep, "prediction", F.get("chances", F.lit(1)).alias("score"), "chances")


def metric_table(pred: DataFrame, problem: str, classes: list | None = None) -> DataFrame:
    """``(metric, value)`` of predictions; classifiers with chances also get ``roc_auc``, of several classes each against the rest, by class size."""
    if problem != "classification":
        return metrics_regression(pred)
    out = metrics_classification(pred)
    if classes and len(classes) > 1 and "chances" in pred.columns:
        auc = roc_auc_of_chances(pred, classes)
        out = out.unionByName(auc.select(F.lit("roc_auc").alias("metric"), F.col("auc").alias("value")))
    return out


def feature_importance(fitted, features: list[str]) -> list[tuple[str, float]]:
    """Tree importances or mean absolute coefficients, highest first."""
    if hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    elif hasattr(fitted, "coefficientMatrix"):
        values = abs(fitted.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(fitted, "coefficients"):
        values = abs(fitted.coefficients.toArray())
    elif hasattr(fitted, "models"):
        parts = [dict(feature_importance(m, features)) for m in fitted.models]
        values = [sum(p[f] for p in parts) / len(parts) for f in features]
    elif getattr(fitted, "w", None):
        values = [abs(x) for x in fitted.w]
    else:
        raise ValueError(f"{type(fitted).__name__} has no importances")
    return sorted(((f, float(v)) for f, v in zip(features, values)), key=lambda x: (-x[1], x[0]))


# ---- validation and search


def with_fold(df: DataFrame, key: str, folds: int, seed: int = SEED) -> DataFrame:
    bucket = F.conv(F.substring(hash_key(col(key), seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", F.pmod(bucket, F.lit(folds)).cast("int"))


def _score(pred: DataFrame, problem: str) -> float:
    if problem == "classification":
        value = pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    else:
        value = pred.agg(F.avg((F.col("label") - F.col("prediction")) * (F.col("label") - F.col("prediction")))).first()[0] ** 0.5
    return float(value)


def _fold_scores(data: DataFrame, model: str, problem: str, folds: int, classes: int, params: dict) -> list[float]:
    out = []
    for i in range(folds):
        train, test = data.filter(F.col("fold") != i).drop("fold"), data.filter(F.col("fold") == i).drop("fold")
        out.append(_score(fit_predict(model, problem, train, test, classes, **params), problem))
    return out


def _point_scores(data: DataFrame, model: str, problem: str, folds: int, classes: int, points: list[dict]) -> list[list[float]]:
    """Scores of each point by fold; trees share the cells of a fold, other points are trained side by side."""
    if all(cells.fits(model, p) and "maxBins" not in p for p in points):
        own = DEFAULTS.get((problem, model), {})
        return cells.fold_scores(estimator, model, problem, data, folds, classes, [{**own, **p} for p in points], SEED, SEARCH_THREADS)
    with ThreadPoolExecutor(SEARCH_THREADS) as pool:  # points have nothing to do with one another
        return list(pool.map(lambda p: _fold_scores(data, model, problem, folds, classes, p), points))


def cross_validate(df: DataFrame, features: list[str], target: str, key: str, model: str, cv: int = 5, params: dict | None = None) -> DataFrame:
    """``(fold, score, mean, std)``: accuracy or RMSE per fold, population deviation."""
    if not 2 <= cv <= 10:
        raise ValueError("cv is 2 to 10 folds")
    problem = problem_type(df, target)
    if model in ALL_POINTS:
        scores = ALL_POINTS[model](df, features, target, key, problem, cv, [params or {}])[0]
    else:
        data = spread(with_fold(assemble(df, features, target, key), key, cv))
        try:
            scores = _point_scores(data, model, problem, cv, _classes(data, problem), [params or {}])[0]
        finally:
            data.unpersist()
    mean, std = _mean_std(scores)
    return df.sparkSession.createDataFrame([(i, s, mean, std) for i, s in enumerate(scores)], "fold int, score double, mean double, std double")


def _mean_std(scores: list[float]) -> tuple[float, float]:
    mean = sum(scores) / len(scores)
    return mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5


def _knn_scores(df, features, target, key, problem, cv, points) -> list[list[float]]:
    points = [(int(p.get("n_neighbors", 5)), p.get("weights", "uniform")) for p in points]
    # read as queries, as donors and for the labels
    data = with_fold(df.select(*dict.fromkeys([key, target, *features])), key, cv).persist()
    try:
        lists = nearest.neighbour_lists(data, features, target, key, max(k for k, _ in points))
        return nearest.fold_scores(lists, points, problem, cv)
    finally:
        data.unpersist()


def _bayes_scores(df, features, target, key, problem, cv, points) -> list[list[float]]:
    if problem != "classification":
        raise ValueError("naive Bayes is a classifier")
    data = spread(with_fold(assemble(df, features, target, key), key, cv))
    try:
        return _bayes_fold_scores(data, cv, points)
    finally:
        data.unpersist()


def _bayes_fold_scores(data, cv, points) -> list[list[float]]:
    return bayes.fold_scores(data, cv, [float(p.get("var_smoothing", bayes.SMOOTHING)) for p in points])


#: models that score all points of a grid, in all folds, together
ALL_POINTS = {"knn": _knn_scores, "naive_bayes": _bayes_scores}


def _classes(data: DataFrame, problem: str) -> int:
    return int(data.agg(F.max("label")).first()[0]) + 1 if problem == "classification" else 0


# Search grids per model, in Spark's names. Spark has no parameter for solver, minimum rows to split, kernel and
# gamma, and the neighbour algorithm cannot change a result; depth 30 is its deepest tree.
GRIDS: dict[str, dict[str, list[Any]]] = {
    "logistic_regression": {"C": [0.01, 0.1, 1, 10, 100], "penalty": ["l1", "l2", "elasticnet", "none"]},
    "decision_tree": {"maxDepth": [30, 5, 10, 15, 20], "minInstancesPerNode": [1, 2, 4], "impurity": ["gini", "entropy"]},
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 2, 4]},
    "svm": {"C": [0.1, 1, 10, 100]},
    "svr": {"C": [0.1, 1, 10, 100], "epsilon": [0.1, 0.2, 0.5]},
    "knn": {"n_neighbors": [3, 5, 7, 9, 11], "weights": ["uniform", "distance"]},
    "naive_bayes": {"var_smoothing": [1e-9, 1e-8, 1e-7, 1e-6]},
    "gradient_boosting": {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7], "subsamplingRate": [0.7, 0.8, 0.9, 1.0]},
    "xgboost": {
        "maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7], "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
        "featureSubsetStrategy": ["0.7", "0.8", "0.9", "1.0"],
    },
    "linear_regression": {"fitIntercept": [True, False], "standardization": [True, False]},
}

#: grid points that are trained side by side
SEARCH_THREADS = 4

PENALTIES = {"l1": 1.0, "l2": 0.0, "elasticnet": 0.5}


def spark_params(model: str, point: dict[str, Any], rows: int) -> dict[str, Any]:
    """A grid point in Spark's terms: the inverse penalty C is a strength per row."""
    out = dict(point)
    if "C" in out and model != "svr":
        out["regParam"] = 1.0 / (out.pop("C") * max(rows, 1))
    penalty = out.pop("penalty", None)
    if penalty == "none":
        out["regParam"] = 0.0
    elif penalty:
        out["elasticNetParam"] = PENALTIES[penalty]
    return out


def grid_search(
    df: DataFrame, features: list[str], target: str, key: str, model: str, grid: dict[str, list[Any]] | None = None, cv: int = 3, top: int = 10
) -> DataFrame:
    """``(rank, params, mean_score, std_score)`` best first; the full grid unless one is given."""
    problem = problem_type(df, target)
    if grid is None:  # regression trees have one impurity only
        grid = {k: v for k, v in GRIDS[model].items() if problem == "classification" or k != "impurity"}
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    if model in ALL_POINTS:
        found = ALL_POINTS[model](df, features, target, key, problem, cv, points)
    else:
        data = spread(with_fold(assemble(df, features, target, key), key, cv))
        try:
            rows, classes = data.count(), _classes(data, problem)
            found = _point_scores(data, model, problem, cv, classes, [spark_params(model, p, rows) for p in points])
        finally:
            data.unpersist()
    results = []
    for point, scores in zip(points, found):
        plain = sum(scores) / cv
        # root of the mean squared error over folds
        mean = (sum(s * s for s in scores) / cv) ** 0.5 if problem == "regression" else plain
        std = (sum((s - plain) ** 2 for s in scores) / cv) ** 0.5
        results.append((json.dumps(point, sort_keys=True), mean, std))
    results.sort(key=lambda r: (r[1] if problem == "regression" else -r[1], r[0]))
    return df.sparkSession.createDataFrame(
        [(i, *r) for i, r in enumerate(results[:top], start=1)], "rank int, params string, mean_score double, std_score double"
    )


def train_many(
    train: DataFrame, test: DataFrame, features: list[str], target: str, key: str, models: list[str], cv: int = 0, tune: bool = False
) -> DataFrame:
    """``(model, metric, value, error)`` for every model; a failed run has the worst values and its error."""
    problem = problem_type(train, target)
    both = assemble(train.withColumn("_t", F.lit(0)).unionByName(test.withColumn("_t", F.lit(1))), [*features, "_t"], target, key)
    # one indexing of the target for both parts; the flag is the last feature and is cut off again
    parts = both.withColumn("_a", vector_to_array("features"))
    from pyspark.ml.functions import array_to_vector

    n = len(features)
    parts = parts.select(key, "label", array_to_vector(F.slice("_a", 1, n)).alias("features"), F.col("_a")[n].alias("_t"))
    if cv and not 2 <= cv <= 10:
        raise ValueError("cv is 2 to 10 folds")
    # every fit and validation reads the assembled rows, with their fold
    a = parts.filter("_t = 0").drop("_t")
    a = spread(with_fold(a, key, cv) if cv else a)
    b = parts.filter("_t = 1").drop("_t").persist()

    def scores_of(m: str, params: dict) -> list[float]:
        if m == "naive_bayes" and problem == "classification":
            return _bayes_fold_scores(a, cv, [params])[0]
        if m in ALL_POINTS:
            return ALL_POINTS[m](train, features, target, key, problem, cv, [params])[0]
        return _point_scores(a, m, problem, cv, classes, [params])[0]

    rows: list[tuple[str, str, float | None, str | None]] = []
    try:
        classes, total = _classes(a.select("label").union(b.select("label")), problem), a.count()
        numbers = [float(i) for i in range(classes)]
        values = [r[0] for r in train.select(target).union(test.select(target)).distinct().dropna().orderBy(target).collect()] if problem == "classification" and "knn" in models else []
        for m in models:
            try:
                params: dict[str, Any] = {}
                if tune and m in GRIDS:
                    best = grid_search(train, features, target, key, m, top=1).first()
                    params = json.loads(best["params"]) if m in ALL_POINTS else spark_params(m, json.loads(best["params"]), total)
                if m == "knn":
                    pred = knn_predict(train, test, features, target, key, problem, classes=values, **params)
                else:
                    pred = fit_predict(m, problem, a, b, classes, **params)
                pred = pred.persist()  # metrics read it several times
                try:
                    rows += [(m, r["metric"], r["value"], None) for r in metric_table(pred, problem, values if m == "knn" else numbers).collect()]
                finally:
                    pred.unpersist()
                if cv:
                    mean, std = _mean_std(scores_of(m, params))
                    rows += [(m, "cv_mean", mean, None), (m, "cv_std", std, None)]
            except Exception as e:  # one failed model must not end the comparison
                text = f"{type(e).__name__}: {e}".splitlines()[0]
                worst = [("accuracy", 0.0), ("balanced_accuracy", 0.0), ("f1", 0.0)] if problem == "classification" else [
                    ("r2", 0.0), ("rmse", float("inf")), ("mse", float("inf"))
                ]
                rows += [(m, name, value, text) for name, value in worst]
    finally:
        a.unpersist()
        b.unpersist()
    return train.sparkSession.createDataFrame(rows, "model string, metric string, value double, error string")
