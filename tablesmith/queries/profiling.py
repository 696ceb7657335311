"""Profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..plans.step import Step, apply_step
from .common import (
    EVENTS_GAPS,
    EVENTS_N,
    LINE_NUMERIC,
    ORDERS_N,
    PART_MIXED,
    query,
    r,
    rounded,
    table,
    union,
)

GAP_COLUMNS = {
    "event_id": ("bigint", "numeric"),
    "user_id": ("bigint", "numeric"),
    "value_n": ("double", "numeric"),
    "value_low": ("double", "numeric"),
    "value_high": ("double", "numeric"),
    "value_daytime": ("double", "numeric"),
    "type_n": ("string", "categorical"),
    "type_low": ("string", "categorical"),
}


@query("shape", "SELECT count(*) AS row_count, 11 AS column_count FROM lineitem")
def _shape(spark, sf):
    return P.shape(table(spark, sf, "lineitem"))


@query(
    "missing_profile",
    union(
        [
            f"""SELECT '{c}' AS "column", '{t}' AS dtype, '{k}' AS class, count(*) FILTER ({c} IS NULL) AS null_count,
            {r(f'100.0 * count(*) FILTER ({c} IS NULL) / count(*)')} AS missing_pct FROM {EVENTS_GAPS.sql}"""
            for c, (t, k) in GAP_COLUMNS.items()
        ]
    ),
)
def _missing(spark, sf):
    return rounded(P.missing_profile(EVENTS_GAPS.df(spark, sf)))


def _q(c, p):
    return r(f"quantile_cont(CAST({c} AS DOUBLE), {p})")


@query(
    "describe",
    union(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS "count", {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
            {r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {_q(c, 0.25)} AS q25, {_q(c, 0.5)} AS q50, {_q(c, 0.75)} AS q75
            FROM lineitem"""
            for c in LINE_NUMERIC
        ]
    ),
)
def _describe(spark, sf):
    return rounded(P.describe(table(spark, sf, "lineitem")))


@query(
    "numeric_profile",
    union(
        [
            f"""SELECT '{c}' AS "column", {_q(c, 0.5)} AS median, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max,
            {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'skewness({c})')} AS skew,
            {r(f'kurtosis({c})')} AS kurtosis, bool_and({c} = floor({c})) AS is_integer,
            count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives FROM lineitem"""
            for c in LINE_NUMERIC
        ]
    ),
)
def _numeric(spark, sf):
    return rounded(P.numeric_profile(table(spark, sf, "lineitem")))


def _top_sql(t, c):
    return f"""SELECT '{c}' AS "column", u AS unique_count, u = 2 AS is_binary, CAST(rk AS INTEGER) AS rank, v AS value, n AS "count"
    FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, count(*) OVER () AS u,
      row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rk
      FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rk <= 5"""


@query("categorical_profile", union([_top_sql("lineitem", c) for c in ("l_returnflag", "l_linestatus")]))
def _categorical(spark, sf):
    return P.categorical_profile(table(spark, sf, "lineitem"))


@query(
    "value_counts",
    f"""SELECT priority_n AS value, count(*) AS "count", {r('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS share
    FROM {ORDERS_N.sql} WHERE priority_n IS NOT NULL GROUP BY priority_n""",
)
def _value_counts(spark, sf):
    return rounded(P.value_counts(ORDERS_N.df(spark, sf), "priority_n"))


@query(
    "dataset_summary",
    f"""
    WITH e AS {EVENTS_N.sql}
    SELECT 'rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM e
    UNION ALL SELECT 'columns', 6.0 UNION ALL SELECT 'numeric_columns', 4.0
    UNION ALL SELECT 'categorical_columns', 1.0 UNION ALL SELECT 'datetime_columns', 1.0
    UNION ALL SELECT 'missing_pct:value_n', {r('100.0 * count(*) FILTER (value_n IS NULL) / count(*)')} FROM e
    """,
)
def _summary(spark, sf):
    return rounded(P.dataset_summary(EVENTS_N.df(spark, sf)))


@query(
    "text_length_profile",
    union(
        [
            f"""SELECT '{c}' AS "column", {r(f"avg(length(coalesce({c}, 'nan')))")} AS mean_length,
            avg(length(coalesce({c}, 'nan'))) > 20 AS is_text FROM documents"""
            for c in ("text", "lang", "source")
        ]
    ),
)
def _lengths(spark, sf):
    return rounded(P.text_length_profile(table(spark, sf, "documents")))


@query(
    "range_ratio",
    f"""
    WITH s AS ({union([f"SELECT CAST(max({c}) - min({c}) AS DOUBLE) AS s FROM lineitem" for c in LINE_NUMERIC])})
    SELECT {r('max(s)')} AS max_range, {r('min(s) FILTER (s > 0)')} AS min_range,
      {r('max(s) / min(s) FILTER (s > 0)', 4)} AS ratio, max(s) / min(s) FILTER (s > 0) > 10 AS needs_scaling FROM s
    """,
)
def _ratio(spark, sf):
    out = P.range_ratio(table(spark, sf, "lineitem"))
    return rounded(out.withColumn("ratio", F.round("ratio", 4)))


DATED = ("CAST(o_orderdate AS STRING) AS date_text", "o_orderpriority AS day_name", "o_orderdate", "o_totalprice")


@query(
    "datetime_candidates",
    """
    SELECT 'o_orderdate' AS "column", 'type' AS "by"
    UNION ALL SELECT 'date_text', 'name' FROM orders HAVING bool_and(try_cast(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) IS NOT NULL)
    UNION ALL SELECT 'day_name', 'name' FROM orders HAVING bool_and(try_cast(o_orderpriority AS TIMESTAMP) IS NOT NULL)
    """,
)
def _datetimes(spark, sf):
    return P.datetime_candidates(table(spark, sf, "orders").selectExpr(*DATED))


@query(
    "target_candidates",
    f"""
    WITH u AS ({union([f"SELECT '{c}' AS c, {i} AS pos, count(DISTINCT {c}) AS k FROM lineitem" for i, c in enumerate(("l_returnflag", "l_linestatus"))])})
    SELECT c AS "column", k AS class_count, CAST(row_number() OVER (ORDER BY k, pos) AS INTEGER) AS rank FROM u WHERE k BETWEEN 2 AND 10
    """,
)
def _targets(spark, sf):
    return P.target_candidates(table(spark, sf, "lineitem"))


@query(
    "profile_compare",
    f"""
    WITH p AS {PART_MIXED.sql}, q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM p),
    n AS (SELECT (SELECT count(*) FROM p) AS rb, (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type, p_size FROM p)) AS ra)
    SELECT rb AS rows_before, ra AS rows_after, ra - rb AS row_delta, 9 AS columns_before, 4 AS columns_after,
      'size_squared' AS added, 'mixed,mostly_number,one_value,p_name,p_partkey,p_retailprice' AS removed FROM n
    """,
)
def _compare(spark, sf):
    before = PART_MIXED.df(spark, sf)
    after = apply_step(before.select("p_brand", "p_type", "p_size"), Step("remove_duplicates", method="all_columns"))
    return P.profile_compare(before, after.withColumn("size_squared", F.col("p_size") * F.col("p_size")))
