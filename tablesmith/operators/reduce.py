"""Dimensionality reduction: projections fitted from moment aggregates."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.moments import basic_stats, sums_in_parts
from ..functions.schema import col, require_numeric
from ..plans.step import Fitted, register


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and covariance (n - 1) over complete rows, from two aggregates."""
    require_numeric(df, *columns)
    data = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    names = data.columns
    stats = basic_stats(data, names)
    n, mean = int(stats[names[0]]["n"]), np.array([stats[x]["mean"] for x in names], dtype=float)
    centred = data.select(*[(F.col(x) - F.lit(stats[x]["mean"])).alias(x) for x in names])
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    sums = sums_in_parts(centred, {(i, j): F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs})
    cov = np.zeros((len(names), len(names)))
    for (i, j), v in sums.items():
        cov[i, j] = cov[j, i] = v / max(n - 1, 1)
    return n, mean, cov


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest loading made positive: one fixed sign per component."""
    at = np.argmax(np.abs(vectors), axis=0)
    sign = np.sign(vectors[at, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


def _pca_fit(df, s, found):
    n = int(s.params.get("n_components", min(5, len(s.columns))))
    _, mean, cov = moments(df, list(s.columns))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:n]
    return Fitted(
        {
            "mean": mean.tolist(),
            "weights": _signed(vectors[:, order]).T.tolist(),
            "explained": (values[order] / values.sum()).tolist(),
        }
    )


def _project(prefix):
    def apply(df, s, f):
        out = {}
        for j, w in enumerate(f.params["weights"], start=1):
            total = F.lit(0.0)
            for c, m, x in zip(s.columns, f.params["mean"], w):
                total = total + (col(c).cast("double") - F.lit(m)) * F.lit(x)
            out[f"{prefix}_{j}"] = total
        df = df.withColumns(out)
        return df.drop(*s.columns) if s.params.get("drop_original", True) else df

    return apply


register("dimensionality_reduction", "pca", fit=_pca_fit, apply=_project("pca"))


def _lda_fit(df, s, found):
    """Directions that best separate the classes: within and between scatter from per-class moments."""
    y = s.params["target_column"]
    require_numeric(df, *s.columns)
    data = df.select(col(y).alias("y"), *[col(c).cast("double") for c in s.columns]).dropna()
    vec = VectorAssembler(inputCols=list(s.columns), outputCol="x").transform(data)
    per_class = vec.groupBy("y").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("x")).alias("m")).collect()
    counts = np.array([r["n"] for r in per_class], dtype=float)
    means = np.array([r["m"].toArray() for r in per_class])
    rows, mean, cov = moments(data, list(s.columns))
    between = (means - mean).T @ ((means - mean) * counts[:, None])
    within = cov * (rows - 1) - between
    values, vectors = np.linalg.eig(np.linalg.pinv(within) @ between)
    n = min(int(s.params.get("n_components", len(counts) - 1)), len(counts) - 1, len(s.columns))
    order = np.argsort(values.real)[::-1][:n]
    return Fitted({"mean": mean.tolist(), "weights": _signed(vectors.real[:, order]).T.tolist()})


register("dimensionality_reduction", "lda", fit=_lda_fit, apply=_project("lda"))
