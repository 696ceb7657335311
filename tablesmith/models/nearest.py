"""Validation of nearest-neighbour models from one table of neighbour lists.

A row's list holds its nearest rows of *other* folds, so it serves as test row of its fold against the training part of that fold. One neighbour
join finds the lists; every number of neighbours and every weighting is then a vote over a prefix of the list, and all of
them are scored by one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.knn import knn_join
from ..functions.schema import col

#: weight of a neighbour at distance zero
AT_ONCE = 1e12


def neighbour_lists(data: DataFrame, features: list[str], target: str, key: str, k: int, fold: str = "fold", **sizes: int) -> DataFrame:
    """``(key, fold, label, near)``: the k nearest rows of other folds as an array of (rank, distance, label), nearest first, ties by key.

    Rows with a missing feature have no list and are in none.
    """
    rows = data.select(key, fold, col(target).alias("label"), *features)
    near = knn_join(rows, rows, features, k, key, key, payload=["label"], apart=fold, **sizes)
    lists = near.groupBy(F.col(key).alias("_k")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rank").alias("rank"), F.col("_distance").alias("distance"), "label"))).alias("near")
    )
    return rows.join(lists, col(key) == F.col("_k"), "left").select(key, fold, "label", "near")


def weight(distance: Column, weights: str) -> Column:
    if weights == "uniform":
        return F.lit(1.0)
    if weights != "distance":
        raise ValueError("weights are 'uniform' or 'distance'")
    return F.coalesce(F.least(F.try_divide(F.lit(1.0), distance), F.lit(AT_ONCE)), F.lit(AT_ONCE))


def vote(near: Column, k: int, weights: str, problem: str) -> Column:
    """Prediction of the first k of a list: the label with the largest weight (the smallest of equal ones), or the weighted mean."""
    first = F.slice(near, 1, k)

    def total(value) -> Column:
        return F.aggregate(first, F.lit(0.0), lambda s, x: s + value(x))

    if problem == "regression":
        return F.try_divide(total(lambda x: weight(x["distance"], weights) * x["label"]), total(lambda x: weight(x["distance"], weights)))
    labels = F.array_distinct(F.transform(first, lambda x: x["label"]))
    ranked = F.transform(
        labels,
        lambda c: F.struct((-total(lambda x: F.when(x["label"] == c, weight(x["distance"], weights)).otherwise(0.0))).alias("votes"), c.alias("label")),
    )
    return F.array_min(ranked)["label"]


def fold_scores(lists: DataFrame, points: Sequence[tuple[int, str]], problem: str, folds: int, fold: str = "fold") -> list[list[float]]:
    """Score of each (number of neighbours, weights) in each fold, accuracy or root mean squared error, by one aggregate."""
    parts = []
    for i, (k, weights) in enumerate(points):
        guess = vote(F.col("near"), k, weights, problem)
        if problem == "classification":
            parts.append(F.avg((guess == F.col("label")).cast("double")).alias(f"s{i}"))
        else:
            parts.append(F.sqrt(F.avg((guess - F.col("label")) * (guess - F.col("label")))).alias(f"s{i}"))
    found = {r[fold]: r for r in lists.groupBy(fold).agg(*parts).collect()}
    return [[float(found[f][f"s{i}"]) for f in range(folds)] for i in range(len(points))]
