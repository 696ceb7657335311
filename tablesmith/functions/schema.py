"""Column classes of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)


def type_of(df: DataFrame, column: str) -> T.DataType:
    if column not in df.columns:
        raise ValueError(f"column '{column}' not found")
    return df.schema[column].dataType


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(type_of(df, column), NUMERIC)


def column_class(dtype: T.DataType) -> str:
    if isinstance(dtype, NUMERIC):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "categorical"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def columns_of(df: DataFrame, cls: str) -> list[str]:
    return [f.name for f in df.schema.fields if column_class(f.dataType) == cls]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "numeric")


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "categorical")


def require_numeric(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if not is_numeric(df, c):
            raise ValueError(f"column '{c}' is {type_of(df, c).simpleString()}; the step needs numeric data")


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere in this package; make it NULL once, at scan."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


LONG_TEXT = 64


def distinct_key(c: Column, is_text: bool) -> Column:
    """What to count distinct: long texts shuffle as their SHA-256 digest."""
    return F.when(F.length(c) > LONG_TEXT, F.sha2(c, 256)).otherwise(c) if is_text else c
