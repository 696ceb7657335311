"""Scaling and feature interactions."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from ..functions.quantiles import value_cells
from ..functions.schema import col, require_numeric
from ..plans.step import Fitted, register, small_or_cut
from .transform import yeojohnson, yeojohnson_lambda


def _aggs(**parts):
    def aggs(df, s):
        require_numeric(df, *s.columns)
        return {f"{name}:{c}": fn(col(c).cast("double")) for c in s.columns for name, fn in parts.items()}

    return aggs


def _linear(centre, spread):
    """(x - centre) / spread; a spread of zero counts as one, as constant columns then become zero."""

    def apply(df, s, f):
        out = {}
        for c in s.columns:
            a, b = centre(f.params, c), spread(f.params, c)
            out[c] = (col(c).cast("double") - F.lit(a)) / F.lit(b if b else 1.0)
        return df.withColumns(out)

    return apply


register(
    "scale",
    "standard",
    aggs=_aggs(avg=F.avg, std=F.stddev_pop),
    apply=_linear(lambda p, c: p[f"avg:{c}"], lambda p, c: p[f"std:{c}"]),
)
register(
    "scale",
    "minmax",
    aggs=_aggs(min=F.min, max=F.max),
    apply=_linear(lambda p, c: p[f"min:{c}"], lambda p, c: (p[f"max:{c}"] or 0.0) - (p[f"min:{c}"] or 0.0)),
)
register(
    "scale",
    "maxabs",
    aggs=_aggs(maxabs=lambda c: F.max(F.abs(c))),
    apply=_linear(lambda p, c: 0.0, lambda p, c: p[f"maxabs:{c}"]),
)


def _robust_fit(df, s, found):
    out = {}
    for c in s.columns:
        q = found.quantiles[c]
        out[f"median:{c}"] = q[0.5]
        out[f"iqr:{c}"] = None if q[0.25] is None else q[0.75] - q[0.25]
    return Fitted(out)


register(
    "scale",
    "robust",
    quantiles=lambda df, s: {c: [0.25, 0.5, 0.75] for c in s.columns},
    fit=_robust_fit,
    apply=_linear(lambda p, c: p[f"median:{c}"], lambda p, c: p[f"iqr:{c}"]),
)


def _quantile_fit(df, s, found):
    require_numeric(df, *s.columns)
    tables, params = {}, {}
    for c in s.columns:
        n = found.values[c]
        cells = value_cells(df, c, rows_per_range=s.params.get("rows_per_range"))
        # average 0-based rank of the value's copies, over n - 1
        place = F.col("before") + (F.col("n") - 1) / F.lit(2.0)
        tables[c] = small_or_cut(cells.select("v", (place / F.lit(float(max(n - 1, 1)))).alias("_u")))
        params[f"rows:{c}"] = n
    return Fitted(params, tables)


def _quantile_apply(df, s, f):
    for c in s.columns:
        table = f.tables[c].withColumnRenamed("v", "_lk")
        df = df.join(table, col(c) == F.col("_lk"), "left").withColumn(c, F.col("_u")).drop("_lk", "_u")
    return df


register(
    "scale",
    "quantile",
    aggs=lambda df, s: {c: F.count(col(c)) for c in s.columns},
    fit=_quantile_fit,
    apply=_quantile_apply,
)


def _power_fit(df, s, found):
    require_numeric(df, *s.columns)
    params = {}
    for c in s.columns:
        params[f"lambda:{c}"] = yeojohnson_lambda(df, c)
    z = {c: yeojohnson(col(c).cast("double"), params[f"lambda:{c}"]) for c in s.columns}
    row = df.agg(*[fn(z[c]) for c in s.columns for fn in (F.avg, F.stddev_pop)]).first()
    for i, c in enumerate(s.columns):
        params[f"avg:{c}"], params[f"std:{c}"] = row[2 * i], row[2 * i + 1]
    return Fitted(params)


def _power_apply(df, s, f):
    p = f.params
    return df.withColumns(
        {
            c: (yeojohnson(col(c).cast("double"), p[f"lambda:{c}"]) - F.lit(p[f"avg:{c}"])) / F.lit(p[f"std:{c}"] or 1.0)
            for c in s.columns
        }
    )


register("scale", "power", fit=_power_fit, apply=_power_apply)


# ---- interactions

_PAIR = {
    "multiplication": ("mul", lambda a, b: a * b),
    "addition": ("add", lambda a, b: a + b),
    "subtraction": ("sub", lambda a, b: a - b),
    "division": ("div", F.try_divide),
}


def _pair(name):
    short, fn = _PAIR[name]

    def apply(df, s, f):
        a, b = s.columns[:2]
        require_numeric(df, a, b)
        return df.withColumn(f"{a}_{short}_{b}", fn(col(a).cast("double"), col(b).cast("double")))

    return apply


for _name in _PAIR:
    register("feature_interaction", _name, apply=_pair(_name))


def _polynomial(df, s, f):
    """All products of 2..degree of the columns, squares included."""
    require_numeric(df, *s.columns)
    out = {}
    for d in range(2, int(s.params.get("degree", 2)) + 1):
        for combo in combinations_with_replacement(s.columns, d):
            term = col(combo[0]).cast("double")
            for c in combo[1:]:
                term = term * col(c).cast("double")
            out["_x_".join(combo)] = term
    return df.withColumns(out)


register("feature_interaction", "polynomial", apply=_polynomial)
