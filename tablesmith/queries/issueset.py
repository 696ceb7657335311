"""Issue tables, the report, fixes, and the suggestion rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import issues as Q
from ..operators.profile import TableProfile
from ..plans.suggest import RULES
from .common import (
    EVENTS_GAPS,
    LABELS_TEXT,
    LINE_NUMERIC,
    LINE_PAIR,
    LINE_SHORT,
    PART_MIXED,
    Input,
    query,
    r,
    rounded,
    table,
    union,
)

NUMBER_SQL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def pct(n: str, total: str = "count(*)") -> str:
    return f"100.0 * ({n}) / ({total})"


def missing_sql(src: str, columns) -> str:
    return union(
        [
            f"""SELECT * FROM (SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS "count",
            {r(pct(f"count(*) FILTER ({c} IS NULL)"))} AS percent FROM {src}) WHERE "count" > 0"""
            for c in columns
        ]
    )


GAPS = ("event_id", "user_id", "value_n", "value_low", "value_high", "value_daytime", "type_n", "type_low")


@query("issue_missing", missing_sql(EVENTS_GAPS.sql, GAPS))
def _missing(spark, sf):
    return rounded(Q.missing(EVENTS_GAPS.df(spark, sf)))


def outlier_sql(src: str, columns, digits: int = 6) -> str:
    return union(
        [
            f"""SELECT '{c}' AS "column", n AS "count", {r('100.0 * n / total', digits)} AS percent,
            {r('lo', digits)} AS lower, {r('hi', digits)} AS upper FROM (
            SELECT count(*) FILTER ({c} < lo OR {c} > hi) AS n, count(*) AS total, any_value(lo) AS lo, any_value(hi) AS hi
            FROM {src}, (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM (
              SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {src}))) WHERE n > 0"""
            for c in columns
        ]
    )


EVENT_NUM = Input("events", ("event_id", "user_id", "value", "event_type"))


@query("issue_outliers", outlier_sql("events", ("event_id", "user_id", "value")))
def _outliers(spark, sf):
    return rounded(Q.outliers(EVENT_NUM.df(spark, sf)))


def mixed_sql(src: str, columns) -> str:
    return union(
        [
            f"""SELECT '{c}' AS "column", k AS numeric_count, n - k AS text_count, {r('100.0 * k / n')} AS percent_numeric FROM (
            SELECT count({c}) AS n, count(*) FILTER (regexp_matches({c}, '{NUMBER_SQL}')) AS k FROM {src}) WHERE k > 0 AND k < n"""
            for c in columns
        ]
    )


PART_TEXT = ("p_name", "p_brand", "p_type", "mixed", "mostly_number", "one_value")


@query("issue_mixed_types", mixed_sql(PART_MIXED.sql, PART_TEXT))
def _mixed(spark, sf):
    return rounded(Q.mixed_types(PART_MIXED.df(spark, sf)))


def cardinality_sql(src: str, columns, ratio: float) -> str:
    return union(
        [
            f"""SELECT '{c}' AS "column", u AS unique_count, {r('u / CAST(n AS DOUBLE)')} AS unique_ratio
            FROM (SELECT count(DISTINCT {c}) AS u, count(*) AS n FROM {src}) WHERE u / CAST(n AS DOUBLE) > {ratio} AND u > 10"""
            for c in columns
        ]
    )


@query("issue_high_cardinality", cardinality_sql("documents", ("text", "lang", "source"), 0.5))
def _cardinality(spark, sf):
    return rounded(Q.high_cardinality(table(spark, sf, "documents")))


@query("issue_id_columns", cardinality_sql("customer", ("c_name", "c_mktsegment"), 0.9))
def _ids(spark, sf):
    return rounded(Q.id_columns(table(spark, sf, "customer")))


def imbalance_sql(src: str, columns, share: float, most: int) -> str:
    return union(
        [
            f"""SELECT '{c}' AS "column", v AS category, {r('100.0 * n / total')} AS percent FROM (
            SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS k,
            row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rk FROM {src} WHERE {c} IS NOT NULL GROUP BY {c})
            WHERE rk = 1 AND k < {most} AND 100.0 * n / total > {share * 100}"""
            for c in columns
        ]
    )


@query("issue_imbalanced", imbalance_sql(LABELS_TEXT.sql, ("toxic", "quality"), 0.8, 10))
def _imbalanced(spark, sf):
    return rounded(Q.imbalanced(LABELS_TEXT.df(spark, sf)))


def constant_sql(src: str, columns) -> str:
    return union(
        [
            f"""SELECT * FROM (SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count FROM {src}) WHERE unique_count <= 1"""
            for c in columns
        ]
    )


PART_ALL = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "mixed", "mostly_number", "one_value")


@query("issue_zero_variance", constant_sql(PART_MIXED.sql, PART_ALL))
def _constant(spark, sf):
    return Q.zero_variance(PART_MIXED.df(spark, sf))


PAIR_COLUMNS = ("l_quantity", "l_extendedprice", "price_line", "l_discount", "l_tax", "one")


def pair_sql(src: str, columns, select, where: str) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = union([f"SELECT '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS r FROM {src}" for a, b in pairs])
    return f"SELECT col1, col2, {select} FROM ({rows}) WHERE NOT isnan(r) AND {where}"


@query("issue_high_correlation", pair_sql(LINE_PAIR.sql, PAIR_COLUMNS, f"{r('abs(r)')} AS correlation", "abs(r) > 0.9"))
def _correlated(spark, sf):
    return rounded(Q.high_correlation(LINE_PAIR.df(spark, sf)))


DUPLICATE_SQL = f"""
    SELECT n - k AS "count", {r('100.0 * (n - k) / n')} AS percent FROM (
      SELECT (SELECT count(*) FROM {LINE_SHORT.sql}) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {LINE_SHORT.sql})) AS k)
"""


@query("issue_duplicates", DUPLICATE_SQL)
def _duplicates(spark, sf):
    return rounded(Q.duplicates(LINE_SHORT.df(spark, sf)))


# ---- report and fixes, on a table with every kind of issue

ISSUES = Input(
    "events",
    (
        "event_id",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value_n",
        "CASE WHEN event_id % 33 = 0 THEN NULL ELSE event_type END AS type_low",
        "value",
        "value * 3 + 1 AS value_line",
        "CASE WHEN event_id % 4 = 0 THEN event_type ELSE CAST(user_id AS STRING) END AS mixed",
        "concat('id-', CAST(event_id AS STRING)) AS ident",
        "'x' AS one_value",
    ),
)
I_NUM = ("event_id", "value_n", "value", "value_line")
I_TEXT = ("type_low", "mixed", "ident", "one_value")
I_ALL = ("event_id", "value_n", "type_low", "value", "value_line", "mixed", "ident", "one_value")


def fix_sql(kind: str) -> str:
    if kind == "missing":
        return "CASE WHEN m < 5 THEN 'impute_basic' WHEN m < 30 THEN 'impute_model' ELSE 'drop_or_category' END"
    if kind == "outliers":
        return "CASE WHEN m < 1 THEN 'remove' WHEN m < 5 THEN 'winsorize' ELSE 'transform' END"
    return "CASE WHEN m > 80 THEN 'to_numeric' ELSE 'to_categorical' END"


def report_sql(src: str, columns, numeric, texts) -> str:
    def part(issue, inner, metric, fix, one='"column"', other="NULL"):
        return f"""SELECT '{issue}' AS issue, c AS "column", o AS other_column, {r('m')} AS metric, {fix} AS fix
        FROM (SELECT {one} AS c, CAST({other} AS VARCHAR) AS o, CAST({metric} AS DOUBLE) AS m FROM ({inner}))"""

    return union(
        [
            part("missing_values", missing_sql(src, columns), "percent", fix_sql("missing")),
            part("inconsistent_types", mixed_sql(src, texts), "percent_numeric", fix_sql("types")),
            part("high_cardinality", cardinality_sql(src, texts, 0.5), "unique_ratio", "'group_or_encode'"),
            part("zero_variance", constant_sql(src, columns), "unique_count", "'drop'"),
            part("outliers", outlier_sql(src, numeric), "percent", fix_sql("outliers")),
            part(
                "high_correlation", pair_sql(src, numeric, "abs(r) AS correlation", "abs(r) > 0.9"), "correlation", "'drop_or_combine'", "col1", "col2"
            ),
        ]
    )


REPORT_SQL = report_sql(ISSUES.sql, I_ALL, I_NUM, I_TEXT)


@query("issue_report", REPORT_SQL)
def _report(spark, sf):
    return rounded(Q.issue_report(ISSUES.df(spark, sf)))


@query(
    "auto_fix",
    f"""
    SELECT issue, "column", other_column,
      CASE issue WHEN 'missing_values' THEN 'impute_missing' WHEN 'outliers' THEN 'handle_outliers'
        WHEN 'inconsistent_types' THEN 'convert_type' WHEN 'high_cardinality' THEN 'reduce_cardinality'
        WHEN 'zero_variance' THEN 'drop_column' ELSE 'handle_correlation' END AS step,
      CASE WHEN issue = 'missing_values' AND "column" IN {I_NUM} THEN CASE WHEN metric < 5 THEN 'median' ELSE 'knn' END
        WHEN issue = 'missing_values' THEN CASE WHEN metric < 5 THEN 'mode' ELSE 'new_category' END
        WHEN issue IN ('outliers', 'inconsistent_types') THEN fix
        WHEN issue = 'high_cardinality' THEN 'group_rare' WHEN issue = 'zero_variance' THEN 'drop' ELSE 'drop_one' END AS method
    FROM ({REPORT_SQL})
    """,
)
def _auto_fix(spark, sf):
    return Q.fix_steps(ISSUES.df(spark, sf))


_MODE = "(SELECT type_low FROM e WHERE type_low IS NOT NULL GROUP BY type_low ORDER BY count(*) DESC, type_low LIMIT 1)"


@query(
    "auto_fix_apply",
    f"""
    WITH e AS {ISSUES.sql}
    SELECT event_id, coalesce(type_low, {_MODE}) AS type_low, mixed FROM e
    """,
)
def _auto_fix_apply(spark, sf):
    """The fixed table itself, for the issue kinds whose fix needs no neighbour search."""
    df = ISSUES.df(spark, sf).select("event_id", "type_low", "mixed", "one_value")
    return Q.auto_fix(df, ["missing_values", "inconsistent_types", "zero_variance"])


# ---- suggestion rules



def rule(key: str, name: str, source, sql: str):
    @query(key, sql)
    def run(spark, sf):
        return rounded(RULES[name](TableProfile(source(spark, sf))))

    return run


def rows(rule_name, inner, step, columns, method, reason, metric):
    return f"""SELECT '{rule_name}' AS rule, {step} AS step, {columns} AS columns, {method} AS method, {reason} AS reason,
    {r(metric)} AS metric FROM ({inner})"""


_gap_numeric = "\"column\" IN ('value_n', 'value_low', 'value_high', 'value_daytime')"
rule(
    "suggest_impute",
    "impute",
    EVENTS_GAPS.df,
    rows(
        "impute",
        missing_sql(EVENTS_GAPS.sql, GAPS),
        "CASE WHEN percent < 30 THEN 'impute_missing' ELSE 'drop_column' END",
        '"column"',
        f"""CASE WHEN percent < 5 THEN CASE WHEN {_gap_numeric} THEN 'median' ELSE 'mode' END
        WHEN percent < 30 THEN CASE WHEN "column" = 'value_daytime' THEN 'interpolate' WHEN {_gap_numeric} THEN 'knn' ELSE 'new_category' END
        ELSE 'drop' END""",
        "CASE WHEN percent < 5 THEN 'few_missing' WHEN percent < 30 THEN 'some_missing' ELSE 'mostly_missing' END",
        "percent",
    ),
)
rule(
    "suggest_dedup",
    "dedup",
    LINE_SHORT.df,
    rows("dedup", DUPLICATE_SQL, "'remove_duplicates'", "CAST(NULL AS VARCHAR)", "'all_columns'", "'duplicate_rows'", '"count"') + ' WHERE "count" > 0',
)
rule(
    "suggest_outliers",
    "outliers",
    EVENT_NUM.df,
    rows(
        "outliers",
        outlier_sql("events", ("event_id", "user_id", "value")),
        "CASE WHEN percent < 5 THEN 'handle_outliers' ELSE 'transform' END",
        '"column"',
        "CASE WHEN percent < 1 THEN 'remove' WHEN percent < 5 THEN 'winsorize' ELSE 'log' END",
        "'outside_fences'",
        "percent",
    ),
)
rule(
    "suggest_type",
    "type",
    PART_MIXED.df,
    rows(
        "type",
        mixed_sql(PART_MIXED.sql, PART_TEXT),
        "'convert_type'",
        '"column"',
        "CASE WHEN percent_numeric > 80 THEN 'to_numeric' ELSE 'to_categorical' END",
        "'mixed_types'",
        "percent_numeric",
    ),
)
DOC_CARD = ("text", "lang", "source")
rule(
    "suggest_cardinality",
    "cardinality",
    lambda spark, sf: table(spark, sf, "documents").withColumn("head", F.substring("text", 1, 12)),
    rows(
        "cardinality",
        cardinality_sql("(SELECT *, substr(text, 1, 12) AS head FROM documents)", (*DOC_CARD, "head"), 0.5),
        "'reduce_cardinality'",
        '"column"',
        "'group_rare'",
        "'high_cardinality'",
        "unique_ratio",
    )
    + " WHERE unique_ratio <= 0.9",
)
CUSTOMER_X = Input("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "'x' AS one_value"))
CUSTOMER_TEXT, CUSTOMER_ALL = ("c_name", "c_mktsegment", "one_value"), ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "one_value")
_DROP_SQL = union(
    [
        rows("drop", cardinality_sql(CUSTOMER_X.sql, CUSTOMER_TEXT, 0.9), "'drop_column'", '"column"', "'drop'", "'identifier'", "unique_ratio"),
        rows("drop", constant_sql(CUSTOMER_X.sql, CUSTOMER_ALL), "'drop_column'", '"column"', "'drop'", "'zero_variance'", "unique_count"),
    ]
)
rule("suggest_drop", "drop", CUSTOMER_X.df, _DROP_SQL)
rule(
    "suggest_decorrelate",
    "decorrelate",
    LINE_PAIR.df,
    rows(
        "decorrelate",
        pair_sql(LINE_PAIR.sql, PAIR_COLUMNS, "abs(r) AS correlation", "abs(r) > 0.9"),
        "'handle_correlation'",
        "col1 || ',' || col2",
        "'drop_one'",
        "'high_correlation'",
        "correlation",
    ),
)
PART_ENC = Input("part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind", "concat(p_name, ' ', p_brand, ' ', p_type) AS long_text"))
ENC_TEXT = ("p_name", "p_brand", "p_type", "kind", "long_text")
rule(
    "suggest_encode",
    "encode",
    PART_ENC.df,
    rows(
        "encode",
        union(
            [
                f"""SELECT * FROM (SELECT '{c}' AS c, count(DISTINCT {c}) AS k, count(*) AS n,
                avg(length(coalesce({c}, 'nan'))) > 20 AS long FROM {PART_ENC.sql})
                WHERE NOT (k > 10 AND k / CAST(n AS DOUBLE) > 0.9) AND k > 1"""
                for c in ENC_TEXT
            ]
        ),
        "CASE WHEN long THEN 'text_processing' ELSE 'encode' END",
        "c",
        "CASE WHEN long THEN 'tfidf' WHEN k = 2 THEN 'label' WHEN k <= 10 THEN 'onehot' WHEN k <= 30 THEN 'frequency' ELSE 'target' END",
        "CASE WHEN long THEN 'long_text' ELSE 'category' END",
        "k",
    ),
)
_SPANS = union([f"SELECT CAST(max({c}) - min({c}) AS DOUBLE) AS s FROM lineitem" for c in LINE_NUMERIC])


@query(
    "suggest_scale",
    f"""SELECT 'scale' AS rule, 'scale' AS step, '{",".join(LINE_NUMERIC)}' AS columns, 'standard' AS method, 'different_ranges' AS reason,
    {r('ratio', 4)} AS metric FROM (SELECT max(s) / min(s) FILTER (s > 0) AS ratio FROM ({_SPANS})) WHERE ratio > 10""",
)
def _suggest_scale(spark, sf):
    return rounded(RULES["scale"](TableProfile(table(spark, sf, "lineitem"))), 4)


rule(
    "suggest_time",
    "time",
    lambda spark, sf: table(spark, sf, "orders"),
    """SELECT 'time' AS rule, 'time_features' AS step, column_name AS columns, m AS method, 'datetime_column' AS reason, CAST(NULL AS DOUBLE) AS metric
    FROM (DESCRIBE orders), (SELECT unnest(['date_parts', 'cyclical']) AS m) WHERE column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE'""",
)
rule(
    "suggest_imbalance",
    "imbalance",
    LABELS_TEXT.df,
    rows(
        "imbalance",
        f"""SELECT * FROM ({imbalance_sql(LABELS_TEXT.sql, ("toxic", "quality"), 0.7, 11)}) WHERE "column" = (
        SELECT c FROM ({union([f"SELECT '{c}' AS c, {i} AS p, count(DISTINCT {c}) AS k FROM {LABELS_TEXT.sql}" for i, c in enumerate(("toxic", "quality"))])})
        WHERE k BETWEEN 2 AND 10 ORDER BY k, p LIMIT 1)""",
        "'handle_imbalance'",
        '"column"',
        "'smote'",
        "'dominant_class'",
        "percent",
    ),
)
_LINE_TARGET = union([f"SELECT '{c}' AS c, {i} AS p, count(DISTINCT {c}) AS k FROM lineitem" for i, c in enumerate(("l_returnflag", "l_linestatus"))])
rule(
    "suggest_selection",
    "selection",
    lambda spark, sf: table(spark, sf, "lineitem"),
    rows(
        "selection",
        f"SELECT c, k FROM ({_LINE_TARGET}) WHERE k BETWEEN 2 AND 10 ORDER BY k, p LIMIT 1",
        "'feature_selection'",
        f"'{','.join(LINE_NUMERIC)}'",
        "'random_forest'",
        "'target=' || c",
        "k",
    ),
)


def _numbers_of(src: str) -> str:
    """The table's own list of numeric columns, in order."""
    return f"""(SELECT count(*) AS k, string_agg(column_name, ',') AS names, string_agg(column_name, ',') FILTER (i <= 2) AS two FROM (
      SELECT column_name, row_number() OVER () AS i FROM (DESCRIBE SELECT * FROM {src}) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT')))"""


WIDE = Input("lineitem", (*LINE_NUMERIC, "l_quantity * l_discount AS saved", "l_extendedprice * l_tax AS taxed"))
rule(
    "suggest_reduction",
    "reduction",
    WIDE.df,
    f"""SELECT 'reduction' AS rule, 'dimensionality_reduction' AS step, names AS columns, 'pca' AS method,
    'many_numeric' AS reason, CAST(least(5, k) AS DOUBLE) AS metric FROM {_numbers_of(WIDE.sql)} WHERE k >= 10""",
)
rule(
    "suggest_interaction",
    "interaction",
    lambda spark, sf: table(spark, sf, "lineitem"),
    f"""SELECT 'interaction' AS rule, 'feature_interaction' AS step, two AS columns, 'multiplication' AS method,
    'numeric_pair' AS reason, CAST(k AS DOUBLE) AS metric FROM {_numbers_of('lineitem')} WHERE k >= 2""",
)
rule(
    "suggest_binning",
    "binning",
    lambda spark, sf: table(spark, sf, "lineitem"),
    rows(
        "binning",
        union([f"SELECT * FROM (SELECT '{c}' AS c, count(DISTINCT {c}) AS k FROM lineitem) WHERE k > 20" for c in LINE_NUMERIC]),
        "'binning'",
        "c",
        "'equal_width'",
        "'many_values'",
        "k",
    ),
)
