"""Gaussian naive Bayes with variance smoothing from counts, means and variances per class.

All it keeps is one row of moments per class, from one aggregate; log densities are column expressions. Moments of folds add up, so
every training part of a cross-validation and every smoothing value comes from one aggregate over the table, and one more scores them all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTHING = 1e-9


@dataclass
class Moments:
    """Rows, means and sums of squared deviations."""

    n: int
    mean: list[float]
    m2: list[float]

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        gaps = [b - a for a, b in zip(self.mean, other.mean)]
        mean = [a + g * other.n / n for a, g in zip(self.mean, gaps)]
        m2 = [a + b + g * g * self.n * other.n / n for a, b, g in zip(self.m2, other.m2, gaps)]
        return Moments(n, mean, m2)


def moments(data: DataFrame, fold: str | None = None) -> dict[tuple[int, float], Moments]:
    """By (fold, class), from ``(label, features)``; fold 0 if there is none."""
    first = data.select("features").first()
    width = len(first["features"]) if first else 0
    x = vector_to_array("features")
    by = [F.col(fold) if fold else F.lit(0).alias("fold"), F.col("label")]
    sums = [f(x[i]).alias(f"{name}{i}") for i in range(width) for name, f in (("m", F.avg), ("v", F.var_pop))]
    out = {}
    for r in data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[int(r[0]), r["label"]] = Moments(r["n"], [r[f"m{i}"] for i in range(width)], [r[f"v{i}"] * r["n"] for i in range(width)])
    return out


def _sum(parts) -> Moments:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


class GaussianBayes:
    """``fit`` and ``transform`` as Spark's estimators have them; ``probability`` is an array by class number."""

    def __init__(self, var_smoothing: float = SMOOTHING):
        self.var_smoothing = var_smoothing
        self.classes: list[tuple[float, float, list[float], list[float]]] = []  # label, log prior, means, variances

    def fit(self, data: DataFrame) -> "GaussianBayes":
        return self.of({c: m for (_, c), m in moments(data).items()})

    def of(self, by_class: dict[float, Moments]) -> "GaussianBayes":
        if not by_class:
            raise ValueError("no rows to fit")
        whole = _sum(by_class.values())
        # a share of the largest variance of any feature, so that no variance is zero
        more = self.var_smoothing * max((v / whole.n for v in whole.m2), default=0.0)
        self.classes = [(c, math.log(m.n / whole.n), m.mean, [v / m.n + more for v in m.m2]) for c, m in sorted(by_class.items())]
        return self

    def _scores(self, features: Column) -> list[Column]:
        out = []
        for _, prior, means, variances in self.classes:
            if any(v <= 0 for v in variances):
                raise ValueError("a feature is constant within every class; raise var_smoothing")
            fixed = prior - 0.5 * sum(math.log(2 * math.pi * v) for v in variances)
            gaps = F.zip_with(features, F.lit(means), lambda x, m: (x - m) * (x - m))
            terms = F.zip_with(gaps, F.lit(variances), lambda g, v: g / v)
            out.append(F.lit(fixed) - F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / F.lit(2.0))
        return out

    def prediction(self, scores: list[Column]) -> Column:
        """The label of the largest score, the smallest of equal ones."""
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        out = F.lit(float(self.classes[-1][0]))
        for (label, *_), s in reversed(list(zip(self.classes, scores))):
            out = F.when(s == best, F.lit(float(label))).otherwise(out)
        return out

    def transform(self, data: DataFrame) -> DataFrame:
        names = [f"_s{i}" for i in range(len(self.classes))]
        scored = data.withColumns(dict(zip(names, self._scores(vector_to_array("features")))))
        scores = [F.col(n) for n in names]
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        weights = {label: F.exp(s - best) for (label, *_), s in zip(self.classes, scores)}
        whole = sum(list(weights.values())[1:], list(weights.values())[0])
        # classes are numbered from 0; a number without rows in training has no chance
        last = int(max(weights))
        chances = [weights[float(i)] / whole if float(i) in weights else F.lit(0.0) for i in range(last + 1)]
        return scored.withColumn("prediction", self.prediction(scores)).withColumn("probability", F.array(*chances)).drop(*names)


def fold_scores(data: DataFrame, folds: int, smoothings: list[float], fold: str = "fold") -> list[list[float]]:
    """Accuracy of each smoothing value in each fold, trained on the other folds: one aggregate to fit, one to score."""
    found = moments(data, fold)
    classes = sorted({c for _, c in found})
    hits = []
    x = F.col("_x")
    for i, smoothing in enumerate(smoothings):
        guess = F.lit(None).cast("double")
        for f in range(folds):
            rest = {c: _sum(p) for c in classes if (p := [found[g, c] for g in range(folds) if g != f and (g, c) in found])}
            model = GaussianBayes(smoothing).of(rest)
            guess = F.when(F.col(fold) == f, model.prediction(model._scores(x))).otherwise(guess)
        hits.append(F.avg((guess == F.col("label")).cast("double")).alias(f"s{i}"))
    rows = {r[fold]: r for r in data.withColumn("_x", vector_to_array("features")).groupBy(fold).agg(*hits).collect()}
    return [[float(rows[f][f"s{i}"]) for f in range(folds)] for i in range(len(smoothings))]
