"""Data issues, one small table per kind. The thresholds are parameters with the usual defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_double
from ..functions.quantiles import exact_quantiles
from ..functions.schema import categorical_columns, col, column_class, distinct_key, numeric_columns, type_of
from .clean import fences
from .correlate import pairs_over
from .profile import distinct_counts, long_form, missing_profile, value_table


def missing(df: DataFrame) -> DataFrame:
    """``(column, count, percent)``."""
    return missing_profile(df).filter("null_count > 0").select(
        "column", F.col("null_count").alias("count"), F.col("missing_pct").alias("percent")
    )


def outliers(df: DataFrame, columns: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """``(column, count, percent, lower, upper)`` outside Tukey's fences; percent of all rows."""
    columns = columns or numeric_columns(df)
    q = exact_quantiles(df, {c: [0.25, 0.75] for c in columns})
    bounds = {c: fences(q[c][0.25], q[c][0.75], k) for c in columns if q[c][0.25] is not None}
    names = list(bounds)
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if((col(c) < F.lit(bounds[c][0])) | (col(c) > F.lit(bounds[c][1]))).alias(f"o{i}")
            for i, c in enumerate(names)
        ],
    )
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"o{i}").alias("count"),
            F.try_divide(F.col(f"o{i}") * 100.0, F.col("n").cast("double")).alias("percent"),
            F.lit(bounds[c][0]).alias("lower"),
            F.lit(bounds[c][1]).alias("upper"),
        )
        for i, c in enumerate(names)
    ]
    schema = "column string, count bigint, percent double, lower double, upper double"
    return long_form(one, items, schema).filter("count > 0")


def mixed_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, numeric_count, text_count, percent_numeric)`` for texts that are numbers only in part."""
    columns = columns or categorical_columns(df)
    one = df.agg(
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count(parse_double(col(c))).alias(f"k{i}") for i, c in enumerate(columns)],
    )
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"k{i}").alias("numeric_count"),
            (F.col(f"n{i}") - F.col(f"k{i}")).alias("text_count"),
            F.try_divide(F.col(f"k{i}") * 100.0, F.col(f"n{i}").cast("double")).alias("percent_numeric"),
        )
        for i, c in enumerate(columns)
    ]
    schema = "column string, numeric_count bigint, text_count bigint, percent_numeric double"
    return long_form(one, items, schema).filter("numeric_count > 0 and text_count > 0")


def high_cardinality(
    df: DataFrame, columns: list[str] | None = None, ratio: float = 0.5, min_unique: int = 10, approximate: bool = False
) -> DataFrame:
    """``(column, unique_count, unique_ratio)`` above the share of rows and the least number of values."""
    columns = columns or categorical_columns(df)
    n = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    counts = distinct_counts(df, columns, approximate).withColumn("unique_ratio", F.try_divide(F.col("unique_count").cast("double"), n))
    return counts.filter((F.col("unique_ratio") > ratio) & (F.col("unique_count") > min_unique))


def id_columns(df: DataFrame, columns: list[str] | None = None, ratio: float = 0.9) -> DataFrame:
    return high_cardinality(df, columns, ratio)


def imbalanced(df: DataFrame, columns: list[str] | None = None, share: float = 0.8, max_unique: int = 10) -> DataFrame:
    """``(column, category, percent)`` where one of few categories prevails."""
    counts = value_table(df, columns or categorical_columns(df))
    per = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("count").alias("n"),
        F.min(F.struct((-F.col("count")).alias("m"), F.col("value").alias("v"))).alias("top"),
    )
    percent = -F.col("top.m") * 100.0 / F.col("n")
    return per.filter((F.col("k") < max_unique) & (percent > share * 100)).select(
        "column", F.col("top.v").alias("category"), percent.alias("percent")
    )


def zero_variance(df: DataFrame) -> DataFrame:
    """``(column, unique_count)`` with at most one value; min = max decides without counting values."""
    one = df.agg(
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
        *[F.min(col(c)).eqNullSafe(F.max(col(c))).alias(f"s{i}") for i, c in enumerate(df.columns)],
    )
    items = [
        F.when(F.col(f"s{i}"), F.struct(F.lit(c).alias("column"), F.least(F.col(f"n{i}"), F.lit(1)).cast("bigint").alias("unique_count")))
        for i, c in enumerate(df.columns)
    ]
    return one.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


def high_correlation(df: DataFrame, columns: list[str] | None = None, r: float = 0.9) -> DataFrame:
    return pairs_over(df, columns or numeric_columns(df), r)


def duplicates(df: DataFrame) -> DataFrame:
    """``(count, percent)`` of rows equal to another, kept one; one row of result."""
    keys = [distinct_key(col(c), column_class(type_of(df, c)) == "categorical").alias(f"k{i}") for i, c in enumerate(df.columns)]
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("count"),
        F.coalesce(F.try_divide(F.sum(F.col("n") - 1) * 100.0, F.sum("n").cast("double")), F.lit(0.0)).alias("percent"),
    )


# ---- report and fixes


def _fix(kind: str, cls=None, percent=None):
    percent = F.col("metric") if percent is None else percent
    if kind == "missing":
        return F.when(percent < 5, "impute_basic").when(percent < 30, "impute_model").otherwise("drop_or_category")
    if kind == "outliers":
        return F.when(percent < 1, "remove").when(percent < 5, "winsorize").otherwise("transform")
    return F.when(percent > 80, "to_numeric").otherwise("to_categorical")


def issue_report(df: DataFrame) -> DataFrame:
    """``(issue, column, other_column, metric, fix)`` over all kinds of issue.

    metric: percent for missing, outliers and mixed types; unique ratio; correlation.
    """
    none, real = F.lit(None).cast("string"), lambda c: F.col(c).cast("double").alias("metric")

    def part(issue, frame, column="column", other=none, metric="percent", fix=None):
        out = frame.select(F.lit(issue).alias("issue"), F.col(column).alias("column"), other.alias("other_column"), real(metric))
        return out.withColumn("fix", fix if fix is not None else F.lit("none"))

    parts = [
        part("missing_values", missing(df), fix=_fix("missing")),
        part("inconsistent_types", mixed_types(df), metric="percent_numeric", fix=_fix("types")),
        part("high_cardinality", high_cardinality(df), metric="unique_ratio", fix=F.lit("group_or_encode")),
        part("zero_variance", zero_variance(df), metric="unique_count", fix=F.lit("drop")),
    ]
    if numeric_columns(df):
        parts.append(part("outliers", outliers(df), fix=_fix("outliers")))
        pairs = high_correlation(df)
        parts.append(part("high_correlation", pairs, "col1", F.col("col2"), "correlation", F.lit("drop_or_combine")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fix_steps(df: DataFrame) -> DataFrame:
    """``(issue, column, other_column, step, method)``: the step that fixes each reported issue."""
    report = issue_report(df)
    numeric = F.col("column").isin(numeric_columns(df)) if numeric_columns(df) else F.lit(False)
    m = F.col("metric")
    step = (
        F.when(F.col("issue") == "missing_values", "impute_missing")
        .when(F.col("issue") == "outliers", "handle_outliers")
        .when(F.col("issue") == "inconsistent_types", "convert_type")
        .when(F.col("issue") == "high_cardinality", "reduce_cardinality")
        .when(F.col("issue") == "zero_variance", "drop_column")
        .otherwise("handle_correlation")
    )
    method = (
        F.when((F.col("issue") == "missing_values") & numeric, F.when(m < 5, "median").otherwise("knn"))
        .when(F.col("issue") == "missing_values", F.when(m < 5, "mode").otherwise("new_category"))
        .when(F.col("issue") == "outliers", _fix("outliers"))
        .when(F.col("issue") == "inconsistent_types", _fix("types"))
        .when(F.col("issue") == "high_cardinality", "group_rare")
        .when(F.col("issue") == "zero_variance", "drop")
        .otherwise("drop_one")
    )
    return report.select("issue", "column", "other_column", step.alias("step"), method.alias("method"))


def auto_fix(df: DataFrame, issues: list[str], key: str | None = None, knn_features: list[str] | None = None) -> DataFrame:
    """Runs the fixing steps of the given issue kinds, one after another, and returns the fixed table.

    The list of steps has one row per issue (bounded by columns and column pairs).
    """
    from ..plans.step import Step, apply_step

    rows = fix_steps(df).filter(F.col("issue").isin(issues)).orderBy("issue", "column", "other_column").collect()
    for r in rows:
        if r["column"] not in df.columns or (r["other_column"] and r["other_column"] not in df.columns):
            continue
        params: dict = {}
        if r["step"] == "reduce_cardinality":
            params["threshold"] = 0.01
        if r["method"] == "knn":
            feats = knn_features or [c for c in numeric_columns(df) if c not in (r["column"], key)]
            params["features"] = feats
        columns = [r["column"], *([r["other_column"]] if r["other_column"] else [])]
        df = apply_step(df, Step(r["step"], columns, r["method"], params, key=key))
    return df
