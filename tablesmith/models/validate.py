"""Checks of a table before training, and the candidate models for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import col, column_class, is_numeric, type_of

# Limits of the rules.
REGRESSION_FROM_VALUES = 10
SMALL_CLASS_ROWS = 5
MIN_ROWS = 10
KERNEL_ROWS = 10_000
BOOSTING_ROWS = 50_000
FOREST_ROWS = 100_000
TREE_ROWS = 100
MANY_FEATURES = 10
LINEAR_FEATURES = 20
IMBALANCED_SHARE = 0.7


def problem_type(df: DataFrame, target: str) -> str:
    """Classification for text targets or fewer than ten distinct values."""
    if column_class(type_of(df, target)) == "categorical":
        return "classification"
    known = df.select(target).filter(col(target).isNotNull())
    # a sketch far above the limit decides; only few values are then counted exactly, so no continuous target is shuffled
    if known.agg(F.approx_count_distinct(target)).first()[0] >= 4 * REGRESSION_FROM_VALUES:
        return "regression"
    return "classification" if known.distinct().count() < REGRESSION_FROM_VALUES else "regression"


def validate(df: DataFrame, features: list[str], target: str, problem: str | None = None) -> DataFrame:
    """``(check_name, column, detail)`` per failed check."""
    problem = problem or problem_type(df, target)
    target_std = F.stddev_samp(col(target).cast("double")) if is_numeric(df, target) else F.lit(None).cast("double")
    profile = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(col(target).isNull()).alias("target_nulls"),
        target_std.alias("target_std"),
        *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(features)],
    )

    def item(cond, check, column, detail):
        return F.when(cond, F.struct(F.lit(check).alias("check_name"), column.alias("column"), detail.cast("string").alias("detail")))

    items = [item(F.col(f"n{i}") > 0, "feature_nulls", F.lit(c), F.col(f"n{i}")) for i, c in enumerate(features)]
    items.append(item(F.col("target_nulls") > 0, "target_nulls", F.lit(target), F.col("target_nulls")))
    items += [
        item(F.lit(True), "text_feature", F.lit(c), F.lit(type_of(df, c).simpleString()))
        for c in features
        if column_class(type_of(df, c)) == "categorical"
    ]
    if problem == "regression":
        items.append(item(F.col("target_std") == 0, "constant_target", F.lit(target), F.lit("0")))
    if not features:
        items.append(item(F.lit(True), "no_features", F.lit(None).cast("string"), F.lit("0")))
    items.append(item(F.col("rows") < MIN_ROWS, "few_rows", F.lit(None).cast("string"), F.col("rows")))
    out = profile.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))
    if problem == "classification":
        counts = (
            df.filter(col(target).isNotNull()).groupBy(col(target).cast("string").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
        )
        small = counts.filter(F.col("n") < SMALL_CLASS_ROWS).select(
            F.lit("small_class").alias("check_name"), F.lit(target).alias("column"), F.concat_ws("=", "cls", F.col("n").cast("string")).alias("detail")
        )
        single = counts.agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") < 2).select(
            F.lit("one_class").alias("check_name"), F.lit(target).alias("column"), F.col("k").cast("string").alias("detail")
        )
        out = out.unionByName(small).unionByName(single)
    return out


def model_candidates(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """``(model, recommended, suitable, warning, resample)`` from one profile of the table."""
    spark = df.sparkSession
    problem = problem_type(df, target)
    rows = df.count()
    n = len(features)
    text = any(column_class(type_of(df, c)) == "categorical" for c in df.columns)
    others = len(df.columns) - 1
    resample, k = False, None
    if problem == "classification":
        counts = df.filter(col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
        top, total, k = counts.agg(F.max("n"), F.sum("n"), F.count(F.lit(1))).first()
        resample = bool(total and top / total > IMBALANCED_SHARE)
    # model: (recommended, suitable, code, whether the code holds)
    over = {limit: rows > limit for limit in (KERNEL_ROWS, BOOSTING_ROWS, FOREST_ROWS)}
    small, wide = rows < TREE_ROWS, n > MANY_FEATURES
    rules = {
        "logistic_regression": (k == 2, True, None, False),
        "linear_regression": (others < LINEAR_FEATURES and not text, True, "many_features", wide),
        "naive_bayes": (False, True, "many_features", wide),
        "svm": (rows < KERNEL_ROWS, not over[KERNEL_ROWS], "many_rows", over[KERNEL_ROWS]),
        "svr": (rows < KERNEL_ROWS, not over[KERNEL_ROWS], "many_rows", over[KERNEL_ROWS]),
        "decision_tree": (False, True, "few_rows", small),
        "knn": (False, not over[KERNEL_ROWS], "many_rows", over[KERNEL_ROWS]),
        "gradient_boosting": (True, True, "many_rows", over[BOOSTING_ROWS]),
        "random_forest": (True, True, "many_rows", over[FOREST_ROWS]),
        "xgboost": (False, True, "many_rows", over[FOREST_ROWS]),
    }
    left_out = {"linear_regression", "svr"} if problem == "classification" else {"logistic_regression", "naive_bayes", "svm"}
    table = [(m, rec, ok, code if holds else None) for m, (rec, ok, code, holds) in rules.items() if m not in left_out]
    return spark.createDataFrame(
        [(problem, *row, resample) for row in table],
        "problem string, model string, recommended boolean, suitable boolean, warning string, resample boolean",
    )
