"""Registry of queries and small helpers shared by them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import scan_named

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under the key, with its oracle if there is one."""

    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"query '{key}' is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return wrap


@dataclass(frozen=True)
class Input:
    """A derived input written once: the same expressions in Spark and in the oracle."""

    table: str
    exprs: tuple[str, ...]

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan_named(spark, self.table, sf_dir).selectExpr(*self.exprs)

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(self.exprs)} FROM {self.table})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_named(spark, name, sf_dir)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded; the oracle rounds the same way."""
    out = {f.name: F.round(F.col(f"`{f.name}`"), digits) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(out) if out else df


def r(expr: str, digits: int = 6) -> str:
    """Rounded double in the oracle (adding 0.0 turns a negative zero positive)."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def cast_int(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(f"`{n}`").cast("int") for n in names})


def cast_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(f"`{n}`").cast("bigint") for n in names})


# ---- derived inputs

EVENTS_N = Input(
    "events",
    (
        "event_id", "ts", "user_id", "event_type", "value",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value_n",
    ),
)
EVENTS_GAPS = Input(
    "events",
    (
        "event_id", "user_id",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value_n",
        "CASE WHEN event_id % 33 = 0 THEN NULL ELSE value END AS value_low",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value_high",
        "CASE WHEN event_id % 8 = 0 THEN NULL ELSE value END AS value_daytime",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS type_n",
        "CASE WHEN event_id % 40 = 0 THEN NULL ELSE event_type END AS type_low",
    ),
)
ORDERS_N = Input(
    "orders",
    (
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority_n",
    ),
)
PART_MIXED = Input(
    "part",
    (
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
        "CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE CAST(p_size AS STRING) END AS mixed",
        "CASE WHEN p_partkey % 50 = 0 THEN p_brand ELSE CAST(p_size AS STRING) END AS mostly_number",
        "'x' AS one_value",
    ),
)
LINE_PAIR = Input(
    "lineitem",
    (
        "l_quantity", "l_extendedprice", "l_extendedprice * 2 + 1 AS price_line", "l_discount", "l_tax",
        "CAST(1.0 AS DOUBLE) AS one",
    ),
)
LINE_SHORT = Input("lineitem", ("l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"))
LABELS_TEXT = Input("labels", ("doc_id", "CAST(toxic AS STRING) AS toxic", "CAST(quality AS STRING) AS quality"))
LINE_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
PREDICTIONS = Input(
    "orders",
    (
        "o_orderkey",
        "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label",
        "CASE WHEN (o_orderkey * 37) % 101 > 50 THEN 1 ELSE 0 END AS prediction",
        "CAST((o_orderkey * 37) % 101 AS DOUBLE) / 101 AS score",
    ),
)
PREDICTIONS_3 = Input(
    "orders",
    (
        "o_orderkey",
        "o_orderstatus AS label",
        "CASE WHEN (o_orderkey * 37) % 101 > 60 THEN 'F' WHEN (o_orderkey * 37) % 101 > 30 THEN 'O' ELSE 'P' END AS prediction",
        "CAST((o_orderkey * 37) % 101 AS DOUBLE) / 101 AS score_f",
        "CAST((o_orderkey * 53) % 97 AS DOUBLE) / 97 AS score_o",
        "CAST((o_orderkey * 71) % 89 AS DOUBLE) / 89 AS score_p",
    ),
)
REGRESSION = Input(
    "orders", ("o_orderkey", "o_totalprice AS label", "CAST(o_custkey % 1000 AS DOUBLE) * 300 + 20000 AS prediction")
)
