"""Column transforms, type conversion, cardinality."""

from __future__ import annotations

import math

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_double
from ..functions.schema import col, require_numeric
from ..plans.step import Fitted, look_up, mapping_tables, register


def _min_agg(df, s):
    require_numeric(df, s.column)
    return {"min": F.min(col(s.column)).cast("double")}


def _log_shift(low: float | None) -> float:
    """Shift that makes every value at least 1 when any is not positive."""
    return abs(low) + 1 if low is not None and low <= 0 else 0.0


def _log_fit(df, s, found):
    return Fitted({"shift": _log_shift(found.values["min"])})


def _log(df, s, f):
    return df.withColumn(s.column, F.ln(col(s.column).cast("double") + F.lit(f.params["shift"])))


def _present(df, s, f):
    return F.count(col(s.column))


register("transform", "log", aggs=_min_agg, fit=_log_fit, apply=_log, affected=_present)
register("handle_outliers", "transform", aggs=_min_agg, fit=_log_fit, apply=_log, affected=_present)
register(
    "transform",
    "sqrt",
    aggs=_min_agg,
    fit=lambda df, s, found: Fitted({"shift": abs(found.values["min"]) if (found.values["min"] or 0) < 0 else 0.0}),
    apply=lambda df, s, f: df.withColumn(s.column, F.sqrt(col(s.column).cast("double") + F.lit(f.params["shift"]))),
    affected=_present,
)


def _simple(fn):
    def apply(df, s, f):
        require_numeric(df, s.column)
        return df.withColumn(s.column, fn(col(s.column).cast("double")))

    return apply


register("transform", "reciprocal", apply=_simple(lambda c: F.try_divide(F.lit(1.0), c)), affected=_present)
register("transform", "square", apply=_simple(lambda c: c * c), affected=_present)
register("transform", "cube", apply=_simple(lambda c: c * c * c), affected=_present)


# ---- power transforms: the exponent maximises the normal log-likelihood


def boxcox(c: Column, lam: float) -> Column:
    return F.ln(c) if abs(lam) < 1e-9 else (F.pow(c, F.lit(float(lam))) - 1) / F.lit(float(lam))


def yeojohnson(c: Column, lam: float) -> Column:
    lam = float(lam)
    up = F.log1p(c) if abs(lam) < 1e-9 else (F.pow(c + 1, F.lit(lam)) - 1) / F.lit(lam)
    down = -F.log1p(-c) if abs(lam - 2) < 1e-9 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(c >= 0, up).otherwise(down)


# Search from -4 to 4 in steps of 0.4, then three rounds ten times finer around the best.
LAMBDA_START, LAMBDA_STEP, LAMBDA_ROUNDS = 4.0, 0.4, 4


def best_lambda(df: DataFrame, c: Column, form, log_jacobian: Column) -> float:
    """Grid search over the exponent; every round is one aggregate over all grid points."""
    centre, step, half = 0.0, LAMBDA_STEP, round(LAMBDA_START / LAMBDA_STEP)
    for _ in range(LAMBDA_ROUNDS):
        grid = [round(centre + i * step, 6) for i in range(-half, half + 1)]
        row = df.agg(
            F.count(c).alias("n"),
            F.sum(log_jacobian).alias("j"),
            *[F.var_pop(form(c, g)).alias(f"v{i}") for i, g in enumerate(grid)],
        ).first()
        best = None
        for i, g in enumerate(grid):
            v = row[f"v{i}"]
            if v is None or not v > 0 or math.isinf(v):
                continue
            score = (g - 1) * row["j"] - row["n"] / 2 * math.log(v)
            if best is None or score > best[0]:
                best = (score, g)
        if best is None:
            return 1.0
        centre, step, half = best[1], step / 10, 10
    return centre


def _boxcox_fit(df, s, found):
    shift = _log_shift(found.values["min"])
    c = col(s.column).cast("double") + F.lit(shift)
    return Fitted({"shift": shift, "lambda": best_lambda(df, c, boxcox, F.ln(c))})


def _boxcox_apply(df, s, f):
    return df.withColumn(s.column, boxcox(col(s.column).cast("double") + F.lit(f.params["shift"]), f.params["lambda"]))


def yeojohnson_lambda(df: DataFrame, column: str) -> float:
    c = col(column).cast("double")
    return best_lambda(df, c, yeojohnson, F.signum(c) * F.log1p(F.abs(c)))


def _yj_fit(df, s, found):
    require_numeric(df, s.column)
    return Fitted({"lambda": yeojohnson_lambda(df, s.column)})


register("transform", "box-cox", aggs=_min_agg, fit=_boxcox_fit, apply=_boxcox_apply, affected=_present)
register(
    "transform",
    "yeo-johnson",
    fit=_yj_fit,
    apply=lambda df, s, f: df.withColumn(s.column, yeojohnson(col(s.column).cast("double"), f.params["lambda"])),
    affected=_present,
)


# ---- types


def _typed(fn):
    def apply(df, s, f):
        return df.withColumns({c: fn(col(c).cast("string")) for c in s.columns})

    return apply


# The texts read as true and as false.
TRUE_TEXTS = ["true", "t", "yes", "y", "1", "1.0"]
FALSE_TEXTS = ["false", "f", "no", "n", "0", "0.0"]


def to_boolean(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isin(TRUE_TEXTS), True).when(text.isin(FALSE_TEXTS), False)


def _lost(fn):
    def affected(df, s, f):
        total = F.lit(0).cast("long")
        for c in s.columns:
            total = total + F.count_if(col(c).isNotNull() & fn(col(c).cast("string")).isNull())
        return total

    return affected


def _to_datetime(c: Column) -> Column:
    return F.try_to_timestamp(c)


for _name, _fn in (("to_numeric", parse_double), ("to_datetime", _to_datetime), ("to_boolean", to_boolean)):
    register("convert_type", _name, apply=_typed(_fn), affected=_lost(_fn))


def _to_categorical(df, s, f):
    for c in s.columns:
        df = df.withColumn(c, col(c).cast("string")).withMetadata(c, {"class": "categorical"})
    return df


register("convert_type", "to_categorical", apply=_to_categorical, affected=lambda df, s, f: F.count(col(s.column)))


# ---- cardinality


def _rare_fit(df, s, found):
    """Keeps the categories at or above the share; there are at most 1/threshold of them."""
    threshold = float(s.params.get("threshold", 0.01))
    counts = df.filter(col(s.column).isNotNull()).groupBy(col(s.column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(col(s.column))).first()[0]
    # share < threshold, in the form n / total < threshold
    frequent = counts.filter(F.col("n") / F.lit(float(total or 1)) >= F.lit(threshold)).select("v", F.lit(True).alias("_keep"))
    return Fitted({"threshold": threshold}, mapping_tables("frequent", frequent, df, col(s.column)))


def _rare_apply(df, s, f):
    out = look_up(df, f.tables, "frequent", s.column)
    c = col(s.column)
    return out.withColumn(s.column, F.when(c.isNull() | F.col("_keep"), c).otherwise(F.lit("Other"))).drop("_keep")


register("reduce_cardinality", "group_rare", fit=_rare_fit, apply=_rare_apply)


def _cluster_fit(hierarchical: bool):
    def fit(df, s, found):
        y = s.params["target_column"]
        cats = (
            df.filter(col(s.column).isNotNull())
            .groupBy(col(s.column).alias("v"))
            .agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(col(y).cast("double")).alias("m"))
            .na.fill(0.0)
        )
        stats = cats.agg(F.avg("n"), F.stddev_pop("n"), F.avg("m"), F.stddev_pop("m")).first()
        # standardised, then moved off the origin: bisecting starts from centres scaled by their length
        z = cats.select(
            "v",
            *[
                ((F.col(c) - F.lit(stats[2 * i])) / F.lit(stats[2 * i + 1] or 1.0) + F.lit(10.0)).alias(f"z{i}")
                for i, c in enumerate(("n", "m"))
            ],
        )
        vec = VectorAssembler(inputCols=["z0", "z1"], outputCol="x").transform(z)
        k = int(s.params.get("n_clusters", 5))
        algo = BisectingKMeans if hierarchical else KMeans
        model = algo(k=k, seed=42, featuresCol="x", predictionCol="g").fit(vec)
        groups = model.transform(vec).select("v", F.concat(F.lit("group_"), F.col("g").cast("string")).alias("_g"))
        return Fitted({"n_clusters": k}, mapping_tables("groups", groups, df, col(s.column)))

    return fit


def _cluster_apply(df, s, f):
    out = look_up(df, f.tables, "groups", s.column)
    c = col(s.column)
    return out.withColumn(s.column, F.when(c.isNotNull(), F.coalesce(F.col("_g"), F.lit("Other")))).drop("_g")


register("reduce_cardinality", "kmeans_clustering", fit=_cluster_fit(False), apply=_cluster_apply)
register("reduce_cardinality", "hierarchical_clustering", fit=_cluster_fit(True), apply=_cluster_apply)
