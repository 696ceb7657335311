"""Features from date-time columns, and lags."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.order import with_lags
from ..functions.schema import col
from ..plans.step import register, small_or_cut

_DATE = {"year": F.year, "month": F.month, "day": F.dayofmonth, "weekday": F.weekday, "quarter": F.quarter}
_TIME = {"hour": F.hour, "minute": F.minute, "second": F.second}


def _parts(parts):
    def apply(df, s, f):
        return df.withColumns({f"{c}_{name}": fn(col(c)).cast("int") for c in s.columns for name, fn in parts.items()})

    return apply


register("time_features", "date_parts", apply=_parts(_DATE))
register("time_features", "time_parts", apply=_parts(_TIME))


def _cyclical(df, s, f):
    out = {}
    for c in s.columns:
        for name, fn, period in (("month", F.month, 12), ("weekday", F.weekday, 7), ("hour", F.hour, 24)):
            angle = fn(col(c)) * F.lit(2 * math.pi / period)
            out[f"{c}_{name}_sin"] = F.sin(angle)
            out[f"{c}_{name}_cos"] = F.cos(angle)
    return df.withColumns(out)


register("time_features", "cyclical", apply=_cyclical)


def _holidays(df, s, f):
    """Flag from a list of dates (ISO texts), which becomes a small table joined by date."""
    table = df.sparkSession.createDataFrame([(d,) for d in sorted(set(s.params["holidays"]))], "d string")
    table = small_or_cut(table.select(F.to_date("d").alias("_hd"), F.lit(True).alias("_hit")))
    out = df.join(table, F.to_date(col(s.column)) == F.col("_hd"), "left")
    return out.withColumn(f"{s.column}_is_holiday", F.coalesce("_hit", F.lit(False))).drop("_hd", "_hit")


register("time_features", "holidays", apply=_holidays)


def _lag(df, s, f):
    if not s.order_by:
        raise ValueError("lag needs order_by")
    lags = [int(k) for k in s.params.get("lags", [1])]
    return with_lags(df, s.column, list(s.order_by), list(s.partition_by), lags, s.params.get("rows_per_range"))


register("time_features", "lag_features", apply=_lag)
