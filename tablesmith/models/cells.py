"""Tree models trained on cells instead of rows.

Spark's trees cut every feature into at most ``maxBins`` bins, found on a bounded sample, and see nothing of a row but its bins. Rows of the same
bins (and class) are therefore one row with their number as weight, and for a number as target with their mean: sums of weights and of weighted
targets, and with them all splits and leaves, stay the same. One aggregate makes these cells; every later pass of a fit reads at most
bins ** features (times classes) rows, however long the table is, and never more than the table has.

A forest draws every row for every tree as Spark does, Poisson of mean one: a class's cell of n rows gets a draw of mean n, which is the sum of
theirs, and rows with a number are drawn one by one in the pass that adds them up. The draws depend on the cell alone, so runs repeat exactly.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: what Spark's trees take, unless told otherwise: bins of a feature, rows of the sample in which they are found
MAX_BINS, SAMPLE_ROWS = 32, 10_000
#: rows of cells in a partition of training data, trees that are trained side by side
CELLS_PER_PART, TREE_THREADS = 20_000, 8
#: rows of a cell, on average, from which a forest is trained on cells
LEAST_SHARED = 4
FOREST, BOOSTED = "random_forest", ("gradient_boosting", "xgboost")
MODELS = ("decision_tree", FOREST, *BOOSTED)


def fits(model: str, params: dict[str, Any]) -> bool:
    """Whether a model can be trained on cells: all but those that draw rows in another way than a forest's."""
    return model in MODELS and params.get("subsamplingRate", 1.0) == 1.0 and params.get("bootstrap", True)


# ---- bins


def _cuts_of(values: np.ndarray, max_bins: int) -> list[float]:
    """Thresholds as Spark chooses them: between all values, or beyond ``max_bins`` values at about equal numbers of rows."""
    at, counts = np.unique(values + 0.0, return_counts=True)
    middle = ((at[:-1] + at[1:]) / 2.0).tolist()
    if len(middle) < max_bins:
        return middle
    out, target, stride = [], len(values) / max_bins, len(values) / max_bins
    seen = np.cumsum(counts)
    for i in range(1, len(at)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            out.append(middle[i - 1])
            target += stride
    return out


def cuts(data: DataFrame, seed: int, max_bins: int = MAX_BINS) -> list[list[float]]:
    """Thresholds of every feature, from a sample of the size that Spark takes."""
    rows = data.count()
    if not rows:
        raise ValueError("a tree needs at least one row")
    wanted = max(max_bins * max_bins, SAMPLE_ROWS)
    sample = data.select(vector_to_array("features").alias("x"))
    if rows > wanted:
        sample = sample.sample(False, wanted / rows, seed)
    points = np.array([r["x"] for r in sample.collect()])
    return [_cuts_of(points[:, i], min(max_bins, rows)) for i in range(points.shape[1])]


def _bin(x: Column, at: list[float], low: int, high: int) -> Column:
    """Number of thresholds below a value, by halving."""
    if low == high:
        return F.lit(float(low))
    mid = (low + high) // 2
    return F.when(x <= F.lit(at[mid]), _bin(x, at, low, mid)).otherwise(_bin(x, at, mid + 1, high))


def binned(data: DataFrame, at: list[list[float]], name: str = "_bins") -> DataFrame:
    """Adds the bins of a row as an array of doubles."""
    x = data.withColumn("_x", vector_to_array("features"))
    return x.withColumn(name, F.array(*[_bin(F.col("_x")[i], a, 0, len(a)) for i, a in enumerate(at)])).drop("_x")


# ---- training


def _few_parts(cells: DataFrame) -> tuple[DataFrame, int]:
    """Cells persisted in as many partitions as they need, and their number."""
    made = cells.persist()
    n = made.count()
    parts = min(cells.sparkSession.sparkContext.defaultParallelism, n // CELLS_PER_PART + 1)
    if made.rdd.getNumPartitions() <= parts:
        return made, n
    few = made.repartition(parts).persist()
    few.count()
    made.unpersist()
    return few, n


def _by_bins(rows: DataFrame, width: int, by: list[str], *aggs: Column) -> DataFrame:
    """Groups of equal ``_bins`` (and ``by``), bin by bin: numbers are hashed much faster than arrays."""
    bins = [f"_b{i}" for i in range(width)]
    found = rows.groupBy(*[F.get("_bins", F.lit(i)).alias(b) for i, b in enumerate(bins)], *by).agg(*aggs)
    return found.select(F.array(*bins).alias("_bins"), *[c for c in found.columns if c not in bins])


def _sums(rows: DataFrame, problem: str, width: int) -> DataFrame:
    """``(_bins, label, weight)``."""
    weight = F.count(F.lit(1)).cast("double").alias("weight")
    if problem == "classification":
        return _by_bins(rows, width, ["label"], weight)
    return _by_bins(rows, width, [], F.avg("label").alias("label"), weight)


def _drawn(rows: DataFrame, problem: str, trees: int, seed: int) -> DataFrame:
    """``(_bins, bags, sums)``: how often the rows of a cell are drawn for each tree, and the sum of their labels then.

    Rows arrive ordered by cell, and rows of equal label as one; a cell is streamed, so memory does not grow with it.
    """
    place = ["_bins", "label"] if problem == "classification" else ["_bins"]
    counted = rows.groupBy("_bins", "label").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("_seed", F.xxhash64(F.lit(seed), *place))
    ordered = counted.repartition("_seed").sortWithinPartitions("_seed", *place, "label")

    def run(batches):
        cell, rng, bins, bags, sums = None, None, None, None, None
        for pdf in batches:
            done: list[tuple] = []
            keys, labels, n = pdf["_seed"].to_numpy(), pdf["label"].to_numpy(), pdf["n"].to_numpy()
            # two cells of one hash differ in their bins
            rows_of = [tuple(b) for b in pdf["_bins"]]
            start = 0
            for end in range(1, len(pdf) + 1):
                if end < len(pdf) and keys[end] == keys[start] and rows_of[end] == rows_of[start]:
                    continue
                here = (keys[start], rows_of[start])
                if here != cell:
                    if cell is not None:
                        done.append((bins, bags, sums))
                    cell, bins = here, rows_of[start]
                    rng = np.random.default_rng(abs(int(keys[start])))
                    bags, sums = np.zeros(trees), np.zeros(trees)
                w = rng.poisson(n[start:end, None], (end - start, trees)).astype(float)
                bags, sums = bags + w.sum(axis=0), sums + labels[start:end] @ w
                start = end
            yield pd.DataFrame(done, columns=["_bins", "bags", "sums"])
        if cell is not None:
            yield pd.DataFrame([(bins, bags, sums)], columns=["_bins", "bags", "sums"])

    return ordered.mapInPandas(run, "_bins array<double>, bags array<double>, sums array<double>")


def _settings(own: dict[str, Any], cells: int, weight: float) -> dict[str, Any]:
    """Spark's parameters for a table of cells: a bin a value, and the fewest rows of a node as a share of all weight."""
    out = {k: v for k, v in own.items() if k not in ("maxBins", "minInstancesPerNode")}
    # a sample as large as the table, so that no bin is missed
    out.update(maxBins=max(own.get("maxBins", MAX_BINS), int(cells**0.5) + 1), featuresCol="_cells", weightCol="weight")
    least = own.get("minInstancesPerNode", 1)
    if least > 1:
        if weight < 2 * least:
            return {**out, "maxDepth": 0}
        share = min((least - 0.5) / weight, 0.499999)
        out["minWeightFractionPerNode"] = max(own.get("minWeightFractionPerNode", 0.0), share)
    return out


def fit_cells(build, model: str, problem: str, cells: DataFrame, n: int, classes: int, at, params: dict[str, Any]) -> "CellModel":
    """A tree or boosted trees on ``(_bins, label, weight)``; ``build`` makes the estimator, ``n`` is the number of cells."""
    weight = cells.agg(F.sum("weight")).first()[0]
    est = build(model, problem, classes, **_settings(params, n, weight))
    if est.hasParam("classifier"):
        est = est.setFeaturesCol("_cells").setWeightCol("weight")
    return CellModel(est.fit(cells.withColumn("_cells", array_to_vector("_bins"))), at)


def fit_forest(build, problem: str, rows: DataFrame, classes: int, at, params: dict[str, Any], seed: int) -> "CellForest":
    """A forest on rows with ``_bins``: its trees are trained one by one on their draws."""
    own = dict(params)
    trees, seed = own.pop("numTrees", 20), own.pop("seed", seed)
    if own.get("featureSubsetStrategy", "auto") == "auto" and trees > 1:  # alone, a tree would take all
        own["featureSubsetStrategy"] = "sqrt" if problem == "classification" else "onethird"
    if trees > 1:
        total, kinds = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("_bins"))).first()
        if kinds * LEAST_SHARED > total:  # many features: hardly a cell has two rows, and Spark draws rows for all trees at once
            est = build(FOREST, problem, classes, **{**own, "numTrees": trees, "seed": seed, "featuresCol": "_cells"})
            return CellModel(est.fit(rows.withColumn("_cells", array_to_vector("_bins"))), at)
    drawn, n = _few_parts(_drawn(rows, problem, trees, seed) if trees > 1 else _sums(rows, problem, len(at)))
    vectors = drawn.withColumn("_cells", array_to_vector("_bins")).persist()
    try:
        if trees > 1:
            totals = np.array(vectors.select(*[F.sum(F.col("bags")[t]) for t in range(trees)]).first(), dtype=float)
        else:
            totals = np.array([vectors.agg(F.sum("weight")).first()[0]])

        def one(t: int):
            bag = vectors
            if trees > 1:
                w = F.col("bags")[t]
                bag = vectors.where(w > 0).select("_cells", (F.col("sums")[t] / w).alias("label"), w.alias("weight"))
            est = build(FOREST, problem, classes, **_settings({**own, "numTrees": 1, "bootstrap": False, "seed": seed + t}, n, totals[t]))
            return est.fit(bag)

        with ThreadPoolExecutor(TREE_THREADS) as pool:
            return CellForest(list(pool.map(one, range(trees))), at, problem, classes)
    finally:
        vectors.unpersist()
        drawn.unpersist()


def fit(build, model: str, problem: str, train: DataFrame, classes: int, params: dict[str, Any], seed: int):
    """The model of ``(label, features)`` rows. The caller persists the rows, as they are read two times and more."""
    at = cuts(train, seed, params.get("maxBins", MAX_BINS))
    rows = binned(train, at).select("_bins", "label")
    if model == FOREST:
        return fit_forest(build, problem, rows, classes, at, params, seed)
    cells, n = _few_parts(_sums(rows, problem, len(at)))
    try:
        return fit_cells(build, model, problem, cells, n, classes, at, params)
    finally:
        cells.unpersist()


def fold_scores(
    build, model: str, problem: str, data: DataFrame, folds: int, classes: int, points: list[dict[str, Any]], seed: int, threads: int
) -> list[list[float]]:
    """Score of each point in each fold, accuracy or root mean squared error, of persisted ``(fold, label, features)``.

    A fold's two parts become cells once, by thresholds of its training part; every point is trained and judged on these.
    """
    out: list[list[float]] = [[] for _ in points]
    for fold in range(folds):
        train, held = data.filter(F.col("fold") != fold), data.filter(F.col("fold") == fold)
        at = cuts(train, seed)
        rows = binned(train, at).select("_bins", "label")
        counted = [F.count(F.lit(1)).alias("n"), *([] if problem == "classification" else [F.avg("label").alias("label"), F.var_pop("label").alias("rest")])]
        tested = _by_bins(binned(held, at), len(at), ["label"] if problem == "classification" else [], *counted)
        cells, n = _few_parts(_sums(rows, problem, len(at)))
        tested, _ = _few_parts(tested)

        def score(params: dict[str, Any]) -> float:
            if model == FOREST:
                fitted = fit_forest(build, problem, rows, classes, at, params, seed)
            else:
                fitted = fit_cells(build, model, problem, cells, n, classes, at, params)
            pred = fitted.of_cells(tested)
            if problem == "classification":
                right, total = pred.agg(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)), F.sum("n")).first()
                return float(right / total)
            gap = F.col("label") - F.col("prediction")
            return float(pred.agg(F.sum(F.col("n") * (gap * gap + F.col("rest"))) / F.sum("n")).first()[0] ** 0.5)

        try:
            with ThreadPoolExecutor(threads) as pool:  # points have nothing to do with one another
                for scores, found in zip(out, pool.map(score, points)):
                    scores.append(found)
        finally:
            cells.unpersist()
            tested.unpersist()
    return out


class CellModel:
    """A model over bins that takes ``features`` as they are; everything else is asked of Spark's model."""

    def __init__(self, model, at):
        self.model, self.at = model, at

    def __getattr__(self, name: str):
        if name in ("model", "at"):
            raise AttributeError(name)
        return getattr(self.model, name)

    def transform(self, data: DataFrame) -> DataFrame:
        return self.of_cells(binned(data, self.at)).drop("_bins")

    def of_cells(self, cells: DataFrame) -> DataFrame:
        return self.model.transform(cells.withColumn("_cells", array_to_vector("_bins"))).drop("_cells")


class CellForest:
    """Trees of a forest, whose chances or values are averaged; asked once per cell."""

    def __init__(self, trees: list, at, problem: str, classes: int):
        self.trees, self.at, self.problem, self.classes = trees, at, problem, classes

    @property
    def featureImportances(self):
        total = sum(t.featureImportances.toArray() for t in self.trees)
        whole = total.sum()
        return Vectors.dense(total / whole if whole else total)

    def transform(self, data: DataFrame) -> DataFrame:
        rows = binned(data, self.at)
        asked = self.of_cells(rows.select("_bins").distinct())
        return rows.join(asked, "_bins").drop("_bins")

    def of_cells(self, cells: DataFrame) -> DataFrame:
        out, names = cells.withColumn("_cells", array_to_vector("_bins")), []
        for i, t in enumerate(self.trees):
            names.append(f"_t{i}")
            if self.problem == "classification":
                out = t.copy().setRawPredictionCol("").setPredictionCol("").setProbabilityCol(names[-1]).transform(out)
            else:
                out = t.copy().setPredictionCol(names[-1]).transform(out)
        if self.problem != "classification":
            return out.withColumn("prediction", F.aggregate(F.array(*names), F.lit(0.0), lambda a, x: a + x) / len(names)).drop("_cells", *names)
        votes = F.array(*[vector_to_array(c) for c in names])
        out = out.withColumn("_votes", votes).drop("_cells", *names)
        parts = [self._total(c) for c in range(self.classes)]
        out = out.withColumn("rawPrediction", F.array(*parts)).drop("_votes")
        out = out.withColumn("prediction", (F.array_position("rawPrediction", F.array_max("rawPrediction")) - 1).cast("double"))
        return out.withColumn("probability", F.transform("rawPrediction", lambda v: v / len(self.trees)))

    @staticmethod
    def _total(c: int) -> Column:
        return F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x[c])
