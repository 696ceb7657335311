"""Missing-value steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.knn import knn_join
from ..functions.order import with_neighbours
from ..functions.schema import col, is_numeric, require_numeric, type_of
from ..plans.step import Fitted, register


def _nulls(df, s, f):
    total = F.lit(0).cast("long")
    for c in s.columns:
        total = total + F.count_if(col(c).isNull())
    return total


def _fill_literals(df, s, f):
    out = {}
    for c in s.columns:
        value = f.params.get(c)
        if value is None:
            continue
        dtype = type_of(df, c)
        whole = isinstance(value, int) or (isinstance(value, float) and value.is_integer())
        if isinstance(value, (int, float)) and is_numeric(df, c) and not whole:
            # a fractional fill turns an integer column into a double one
            target = T.DoubleType() if not isinstance(dtype, T.DecimalType) else dtype
            out[c] = F.coalesce(col(c).cast(target), F.lit(value).cast(target))
        else:
            out[c] = F.coalesce(col(c), F.lit(value).cast(dtype))
    return df.withColumns(out) if out else df


def _mean_aggs(df, s):
    require_numeric(df, *s.columns)
    return {c: F.avg(F.when(~F.isnan(col(c).cast("double")), col(c))).cast("double") for c in s.columns}


def _median_needs(df, s):
    require_numeric(df, *s.columns)
    return {c: [0.5] for c in s.columns}


register("impute_missing", "mean", aggs=_mean_aggs, apply=_fill_literals, affected=_nulls)
register(
    "impute_missing",
    "median",
    quantiles=_median_needs,
    fit=lambda df, s, found: Fitted({c: found.quantiles[c][0.5] for c in s.columns}),
    apply=_fill_literals,
    affected=_nulls,
)


def most_frequent(df: DataFrame, column: str):
    """Most frequent value, the smallest on ties. Counts are spread over tasks by value."""
    counts = df.filter(col(column).isNotNull()).groupBy(col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v")))).first()[0]


register(
    "impute_missing",
    "mode",
    fit=lambda df, s, found: Fitted({c: most_frequent(df, c) for c in s.columns}),
    apply=_fill_literals,
    affected=_nulls,
)
register(
    "impute_missing",
    "constant",
    fit=lambda df, s, found: Fitted({c: s.params.get("value", 0) for c in s.columns}),
    apply=_fill_literals,
    affected=_nulls,
)
register(
    "impute_missing",
    "new_category",
    fit=lambda df, s, found: Fitted({}),
    apply=lambda df, s, f: df.withColumns({c: F.coalesce(col(c).cast("string"), F.lit("Missing")) for c in s.columns}),
    affected=_nulls,
)


def _ordered(kind: str):
    def apply(df, s, f):
        if not s.order_by:
            raise ValueError(f"{kind} needs order_by: a Spark table has no row order of its own")
        for c in s.columns:
            out = with_neighbours(df, c, list(s.order_by), list(s.partition_by), s.params.get("rows_per_range"))
            if kind == "forward_fill":
                value = F.col("_prev.v")
            elif kind == "backward_fill":
                value = F.col("_next.v")
            else:
                require_numeric(df, c)
                v0, v1 = F.col("_prev.v").cast("double"), F.col("_next.v").cast("double")
                gap = (F.col("_next.p") - F.col("_prev.p")).cast("double")
                share = (F.col("_pos") - F.col("_prev.p")).cast("double")
                between = v0 + F.try_divide((v1 - v0) * share, gap)
                value = F.when(col(c).isNotNull(), col(c).cast("double")).otherwise(F.coalesce(between, v0, v1))
            df = out.withColumn(c, value).drop("_pos", "_prev", "_next")
        return df

    return apply


for _kind in ("forward_fill", "backward_fill", "interpolate"):
    register("impute_missing", _kind, apply=_ordered(_kind), affected=_nulls)


def _knn_aggs(df, s):
    require_numeric(df, s.column, *s.params["features"])
    out = {"mean": F.avg(col(s.column))}
    for x in s.params["features"]:
        out[f"avg:{x}"] = F.avg(col(x))
        out[f"std:{x}"] = F.stddev_pop(col(x))
    return out


def _knn_fit(df, s, found):
    if not s.key:
        raise ValueError("knn needs a unique numeric key")
    donors = df.filter(col(s.column).isNotNull()).select(s.key, s.column, *s.params["features"])
    return Fitted({k: float(v) if v is not None else None for k, v in found.values.items()}, {"donors": donors})


def _knn_apply(df, s, f):
    """Mean of the nearest complete rows on standardised features.

    Where a feature is missing too, or no donor exists, the column mean is used.
    """
    feats = s.params["features"]

    def scaled(d):
        z = {
            f"_z{i}": F.coalesce(F.try_divide(col(x) - F.lit(f.params[f"avg:{x}"]), F.lit(f.params[f"std:{x}"])), col(x) * 0.0)
            for i, x in enumerate(feats)
        }
        return d.withColumns(z)

    zs = [f"_z{i}" for i in range(len(feats))]
    gaps = scaled(df.filter(col(s.column).isNull()).select(s.key, *feats))
    near = knn_join(gaps, scaled(f.tables["donors"]), zs, s.params.get("n_neighbors", 5), s.key, s.key, payload=[s.column])
    fills = near.groupBy(F.col(s.key).alias("_fk")).agg(F.avg(col(s.column)).alias("_fill"))
    # Only the rows with a gap are joined; all others pass by without a shuffle.
    open_rows = df.filter(col(s.column).isNull()).join(fills, col(s.key) == F.col("_fk"), "left")
    filled = open_rows.withColumn(s.column, F.coalesce(F.col("_fill"), F.lit(f.params["mean"]))).drop("_fk", "_fill")
    kept = df.filter(col(s.column).isNotNull()).withColumn(s.column, col(s.column).cast("double"))
    return kept.unionByName(filled)


register("impute_missing", "knn", aggs=_knn_aggs, fit=_knn_fit, apply=_knn_apply, affected=_nulls)
