"""Sinks: tables and metrics as files written by the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A folder of CSV parts with headers; nested columns become JSON text first."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    flat = df.withColumns({c: F.to_json(F.col(c)) for c in nested}) if nested else df
    flat.write.mode(mode).option("header", True).csv(path)
    return path


def write_metrics(metrics: DataFrame, path: str) -> str:
    """``(model, metric, value)`` as CSV; the metric names are a column of their own."""
    return write_csv(metrics.select("model", "metric", "value"), path)
