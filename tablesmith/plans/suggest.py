"""Suggested steps: explicit threshold rules over a small profile table.

Each rule returns ``(rule, step, columns, method, reason, metric)``. The heavy part is the
profile, which ``TableProfile`` computes once; the rules are expressions over its few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import issues
from ..operators.profile import TableProfile, datetime_candidates, target_candidates

SCHEMA = "rule string, step string, columns string, method string, reason string, metric double"


def _out(df: DataFrame, rule: str, step, columns, method, reason, metric) -> DataFrame:
    def c(x) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    return df.select(
        F.lit(rule).alias("rule"),
        c(step).alias("step"),
        c(columns).alias("columns"),
        c(method).alias("method"),
        c(reason).alias("reason"),
        metric.cast("double").alias("metric"),
    )


def _empty(p: TableProfile) -> DataFrame:
    return p.spark.createDataFrame([], SCHEMA)


def impute(p: TableProfile) -> DataFrame:
    m, numeric = F.col("missing_pct"), F.col("class") == "numeric"
    step = F.when(m < 30, "impute_missing").otherwise("drop_column")
    method = (
        F.when(m < 5, F.when(numeric, "median").otherwise("mode"))
        .when(m < 30, F.when(numeric, F.when(F.col("time_hint"), "interpolate").otherwise("knn")).otherwise("new_category"))
        .otherwise("drop")
    )
    reason = F.when(m < 5, "few_missing").when(m < 30, "some_missing").otherwise("mostly_missing")
    return _out(p.columns.filter("nulls > 0"), "impute", step, F.col("column"), method, reason, m)


def dedup(p: TableProfile) -> DataFrame:
    found = issues.duplicates(p.df).filter("count > 0")
    return _out(found, "dedup", "remove_duplicates", F.lit(None).cast("string"), "all_columns", "duplicate_rows", F.col("count"))


def outliers(p: TableProfile) -> DataFrame:
    if not p.numeric:
        return _empty(p)
    m = F.col("percent")
    method = F.when(m < 1, "remove").when(m < 5, "winsorize").otherwise("log")
    step = F.when(m < 5, "handle_outliers").otherwise("transform")
    return _out(issues.outliers(p.df, p.numeric), "outliers", step, F.col("column"), method, "outside_fences", m)


def types(p: TableProfile) -> DataFrame:
    known = F.col("rows") - F.col("nulls")
    share = F.try_divide(F.col("numeric_texts") * 100.0, known.cast("double"))
    found = p.columns.filter((F.col("numeric_texts") > 0) & (F.col("numeric_texts") < known)).withColumn("share", share)
    method = F.when(F.col("share") > 80, "to_numeric").otherwise("to_categorical")
    return _out(found, "type", "convert_type", F.col("column"), method, "mixed_types", F.col("share"))


def _cardinality(p: TableProfile) -> DataFrame:
    ratio = F.try_divide(F.col("unique_count").cast("double"), F.col("rows").cast("double"))
    return p.with_unique.filter("class = 'categorical'").withColumn("ratio", ratio).filter("ratio > 0.5 and unique_count > 10")


def cardinality(p: TableProfile) -> DataFrame:
    found = _cardinality(p).filter("ratio <= 0.9")
    return _out(found, "cardinality", "reduce_cardinality", F.col("column"), "group_rare", "high_cardinality", F.col("ratio"))


def drop(p: TableProfile) -> DataFrame:
    ids = _out(_cardinality(p).filter("ratio > 0.9"), "drop", "drop_column", F.col("column"), "drop", "identifier", F.col("ratio"))
    constant = p.with_unique.filter("unique_count <= 1")
    return ids.unionByName(
        _out(constant, "drop", "drop_column", F.col("column"), "drop", "zero_variance", F.col("unique_count"))
    )


def decorrelate(p: TableProfile) -> DataFrame:
    if len(p.numeric) < 2:
        return _empty(p)
    found = issues.high_correlation(p.df, p.numeric)
    return _out(found, "decorrelate", "handle_correlation", F.concat_ws(",", "col1", "col2"), "drop_one", "high_correlation", F.col("correlation"))


def encode(p: TableProfile) -> DataFrame:
    """Text columns that are not to be dropped (identifiers, constants, mostly missing)."""
    dropped = drop(p).select("columns").unionByName(impute(p).filter("step = 'drop_column'").select("columns"))
    left = p.with_unique.filter("class = 'categorical'").join(dropped, F.col("column") == F.col("columns"), "left_anti")
    k, long = F.col("unique_count"), F.col("mean_length") > 20
    step = F.when(long, "text_processing").otherwise("encode")
    method = (
        F.when(long, "tfidf").when(k == 2, "label").when(k <= 10, "onehot").when(k <= 30, "frequency").otherwise("target")
    )
    return _out(left, "encode", step, F.col("column"), method, F.when(long, "long_text").otherwise("category"), k)


def scale(p: TableProfile) -> DataFrame:
    ranges = p.columns.filter("class = 'numeric'").agg(
        F.max("range").alias("hi"), F.min(F.when(F.col("range") > 0, F.col("range"))).alias("lo")
    )
    found = ranges.withColumn("ratio", F.try_divide("hi", "lo")).filter("ratio > 10")
    return _out(found, "scale", "scale", F.lit(",".join(p.numeric)), "standard", "different_ranges", F.col("ratio"))


def time(p: TableProfile) -> DataFrame:
    found = datetime_candidates(p.df).withColumn("method", F.explode(F.array(F.lit("date_parts"), F.lit("cyclical"))))
    return _out(found, "time", "time_features", F.col("column"), F.col("method"), "datetime_column", F.lit(None))


def imbalance(p: TableProfile) -> DataFrame:
    best = target_candidates(p.df).filter("rank = 1").first()
    if best is None:
        return _empty(p)
    share = issues.imbalanced(p.df, [best["column"]], share=0.7, max_unique=11)
    return _out(share, "imbalance", "handle_imbalance", F.col("column"), "smote", "dominant_class", F.col("percent"))


def selection(p: TableProfile) -> DataFrame:
    if len(p.numeric) < 5:
        return _empty(p)
    best = target_candidates(p.df).filter("rank = 1")
    return _out(
        best, "selection", "feature_selection", F.lit(",".join(p.numeric)), "random_forest", F.concat(F.lit("target="), F.col("column")), F.col("class_count")
    )


def _by_numeric_count(p: TableProfile) -> DataFrame:
    return p.columns.filter("class = 'numeric'").agg(
        F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(F.struct("pos", "column"))).alias("cs")
    )


def reduction(p: TableProfile) -> DataFrame:
    found = _by_numeric_count(p).filter("k >= 10")
    names = F.array_join(F.transform("cs", lambda x: x["column"]), ",")
    return _out(found, "reduction", "dimensionality_reduction", names, "pca", "many_numeric", F.least(F.lit(5), F.col("k")))


def interaction(p: TableProfile) -> DataFrame:
    found = _by_numeric_count(p).filter("k >= 2")
    names = F.array_join(F.transform(F.slice("cs", 1, 2), lambda x: x["column"]), ",")
    return _out(found, "interaction", "feature_interaction", names, "multiplication", "numeric_pair", F.col("k"))


def binning(p: TableProfile) -> DataFrame:
    found = p.with_unique.filter("class = 'numeric' and unique_count > 20")
    return _out(found, "binning", "binning", F.col("column"), "equal_width", "many_values", F.col("unique_count"))


RULES = {
    "impute": impute,
    "dedup": dedup,
    "outliers": outliers,
    "type": types,
    "cardinality": cardinality,
    "drop": drop,
    "decorrelate": decorrelate,
    "encode": encode,
    "scale": scale,
    "time": time,
    "imbalance": imbalance,
    "selection": selection,
    "reduction": reduction,
    "interaction": interaction,
    "binning": binning,
}


def suggest(df: DataFrame) -> DataFrame:
    """All suggestions, with the number of the rule that made them."""
    p = TableProfile(df)
    out = None
    for i, rule in enumerate(RULES.values(), start=1):
        part = rule(p).select(F.lit(i).alias("rule_order"), "*")
        out = part if out is None else out.unionByName(part)
    return out
