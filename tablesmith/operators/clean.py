"""De-duplication, dropping columns, outliers."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.schema import col, column_class, distinct_key, require_numeric, type_of
from ..plans.step import Fitted, register


def _keep(last: bool):
    def apply(df, s, f):
        subset = list(s.columns) or df.columns
        missing = [c for c in subset if c not in df.columns]
        if missing:
            raise ValueError(f"columns not found: {missing}")
        if not s.order_by:
            if set(subset) == set(df.columns):
                return df.dropDuplicates()
            raise ValueError("keeping the first or last row of a subset needs order_by")
        order = [col(c).desc() if last else col(c).asc() for c in s.order_by]
        # A row_number bound to 1 is pruned in every task before the shuffle: a hot group sends one row per task.
        keys = [distinct_key(col(c), column_class(type_of(df, c)) == "categorical") for c in subset]
        spec = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_rn", F.row_number().over(spec)).filter(F.col("_rn") == 1).drop("_rn")

    return apply


register("remove_duplicates", "all_columns", apply=lambda df, s, f: df.dropDuplicates(), changes_rows=True)
register("remove_duplicates", "subset", "keep_first", apply=_keep(False), changes_rows=True)
register("remove_duplicates", "keep_last", apply=_keep(True), changes_rows=True)


def _drop(df, s, f):
    if len(s.columns) == 1 and s.column not in df.columns:
        raise ValueError(f"column '{s.column}' not found")
    return df.drop(*s.columns)


register("drop_column", "", "drop", apply=_drop, affected=lambda df, s, f: F.lit(sum(c in df.columns for c in s.columns)))


# ---- outliers


def _iqr_needs(df, s):
    require_numeric(df, s.column)
    return {s.column: [0.25, 0.75]}


def fences(q1: float, q3: float, k: float = 1.5) -> tuple[float, float]:
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def _iqr_fit(df, s, found):
    q = found.quantiles[s.column]
    if q[0.25] is None:
        return Fitted({"lower": None, "upper": None})
    lo, hi = fences(q[0.25], q[0.75])
    return Fitted({"lower": lo, "upper": hi})


def _bounds(f: Fitted) -> tuple[Column, Column]:
    return F.lit(f.params["lower"]).cast("double"), F.lit(f.params["upper"]).cast("double")


def _inside(df, s, f):
    lo, hi = _bounds(f)
    return df.filter(col(s.column).between(lo, hi))


def _clip(df, s, f):
    lo, hi = _bounds(f)
    c = col(s.column)
    # least/greatest would skip NULLs and turn them into the fence
    return df.withColumn(s.column, F.when(c < lo, lo).when(c > hi, hi).otherwise(c.cast("double")))


def _outside(df, s, f):
    lo, hi = _bounds(f)
    return F.count_if((col(s.column) < lo) | (col(s.column) > hi))


def _by_action(df, s, f):
    return _inside(df, s, f) if s.params.get("action", "remove") == "remove" else _clip(df, s, f)


register("handle_outliers", "remove", quantiles=_iqr_needs, fit=_iqr_fit, apply=_inside, changes_rows=True, affected=_outside)
register("handle_outliers", "winsorize", "cap", quantiles=_iqr_needs, fit=_iqr_fit, apply=_clip, affected=_outside)
register("handle_outliers", "iqr", quantiles=_iqr_needs, fit=_iqr_fit, apply=_by_action, changes_rows=True, affected=_outside)


def _z_aggs(df, s):
    require_numeric(df, s.column)
    c = col(s.column)
    return {"mean": F.avg(c).cast("double"), "std_pop": F.stddev_pop(c), "std": F.stddev_samp(c)}


def _z_fit(df, s, found):
    v, t = found.values, float(s.params.get("threshold", 3))
    # removal uses the population deviation, capping the sample deviation
    std = v["std_pop"] if s.params.get("action", "remove") == "remove" else v["std"]
    if v["mean"] is None or std is None:
        return Fitted({"lower": None, "upper": None, "threshold": t})
    return Fitted({"lower": v["mean"] - t * std, "upper": v["mean"] + t * std, "threshold": t})


register("handle_outliers", "zscore", aggs=_z_aggs, fit=_z_fit, apply=_by_action, changes_rows=True, affected=_outside)
