"""Imputation, de-duplication, dropping, outliers."""

from __future__ import annotations

from ..plans.step import Step, apply_step
from .common import EVENTS_N, LINE_SHORT, ORDERS_N, Input, query, r, rounded, table

E_KEEP = "event_id, user_id"


def _events_step(step: Step, *more: str):
    def run(spark, sf):
        out = apply_step(EVENTS_N.df(spark, sf), step)
        return rounded(out.select("event_id", "user_id", "value_n", *more))

    return run


query("impute_mean", f"SELECT {E_KEEP}, {r(f'coalesce(value_n, (SELECT avg(value_n) FROM {EVENTS_N.sql}))')} AS value_n FROM {EVENTS_N.sql}")(
    _events_step(Step("impute_missing", ["value_n"], "mean"))
)
query(
    "impute_median",
    f"SELECT {E_KEEP}, {r(f'coalesce(value_n, (SELECT quantile_cont(value_n, 0.5) FROM {EVENTS_N.sql}))')} AS value_n FROM {EVENTS_N.sql}",
)(_events_step(Step("impute_missing", ["value_n"], "median")))


@query(
    "impute_mode",
    f"""SELECT o_orderkey, coalesce(priority_n, (SELECT priority_n FROM {ORDERS_N.sql} WHERE priority_n IS NOT NULL
    GROUP BY priority_n ORDER BY count(*) DESC, priority_n LIMIT 1)) AS priority_n FROM {ORDERS_N.sql}""",
)
def _mode(spark, sf):
    return apply_step(ORDERS_N.df(spark, sf), Step("impute_missing", ["priority_n"], "mode")).select("o_orderkey", "priority_n")


query("impute_constant", f"SELECT {E_KEEP}, {r('coalesce(value_n, -1)')} AS value_n FROM {EVENTS_N.sql}")(
    _events_step(Step("impute_missing", ["value_n"], "constant", {"value": -1}))
)

EVENTS_K = Input(
    "events",
    (
        "event_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value_n",
        "CAST(user_id AS DOUBLE) AS f1", "event_id + CAST((event_id * event_id) % 997 AS DOUBLE) / 997 AS f2",
    ),
)


@query(
    "impute_knn",
    f"""
    WITH e AS {EVENTS_K.sql}, s AS (SELECT avg(f1) AS m1, stddev_pop(f1) AS s1, avg(f2) AS m2, stddev_pop(f2) AS s2 FROM e),
    z AS (SELECT event_id, value_n, (f1 - m1) / s1 AS z1, (f2 - m2) / s2 AS z2 FROM e, s),
    d AS (SELECT g.event_id AS k, d.event_id AS dk, d.value_n AS v, (g.z1 - d.z1) * (g.z1 - d.z1) + (g.z2 - d.z2) * (g.z2 - d.z2) AS dist
      FROM z g, z d WHERE g.value_n IS NULL AND d.value_n IS NOT NULL),
    t AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY dist, dk) AS rk FROM d),
    f AS (SELECT k, avg(v) AS v FROM t WHERE rk <= 5 GROUP BY k)
    SELECT event_id, {r('coalesce(value_n, f.v)')} AS value_n FROM e LEFT JOIN f ON event_id = k
    """,
)
def _knn(spark, sf):
    step = Step("impute_missing", ["value_n"], "knn", {"features": ["f1", "f2"], "n_neighbors": 5}, key="event_id")
    return rounded(apply_step(EVENTS_K.df(spark, sf), step).select("event_id", "value_n"))


@query("impute_new_category", f"SELECT o_orderkey, coalesce(priority_n, 'Missing') AS priority_n FROM {ORDERS_N.sql}")
def _new_category(spark, sf):
    return apply_step(ORDERS_N.df(spark, sf), Step("impute_missing", ["priority_n"], "new_category")).select("o_orderkey", "priority_n")


_ORDER = {"order_by": ["ts", "event_id"], "partition_by": ["user_id"]}
_WIN = "PARTITION BY user_id ORDER BY ts, event_id"
query(
    "impute_ffill",
    f"""SELECT {E_KEEP}, {r(f'last_value(value_n IGNORE NULLS) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS value_n
    FROM {EVENTS_N.sql}""",
)(_events_step(Step("impute_missing", ["value_n"], "forward_fill", **_ORDER)))
query(
    "impute_bfill",
    f"""SELECT {E_KEEP}, {r(f'first_value(value_n IGNORE NULLS) OVER ({_WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS value_n
    FROM {EVENTS_N.sql}""",
)(_events_step(Step("impute_missing", ["value_n"], "backward_fill", **_ORDER)))


def interpolate_sql(part: str) -> str:
    w = f"{part} ORDER BY ts, event_id"
    back, ahead = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"""
    WITH p AS (SELECT *, row_number() OVER ({w}) AS pos FROM {EVENTS_N.sql}),
    q AS (SELECT *, CASE WHEN value_n IS NOT NULL THEN pos END AS vp FROM p),
    n AS (SELECT *, last_value(value_n IGNORE NULLS) OVER ({w} {back}) AS v0, last_value(vp IGNORE NULLS) OVER ({w} {back}) AS p0,
      first_value(value_n IGNORE NULLS) OVER ({w} {ahead}) AS v1, first_value(vp IGNORE NULLS) OVER ({w} {ahead}) AS p1 FROM q)
    SELECT {E_KEEP}, {r('coalesce(value_n, v0 + (v1 - v0) * (pos - p0) / nullif(p1 - p0, 0), v0, v1)')} AS value_n FROM n
    """


query("impute_interpolate", interpolate_sql("PARTITION BY user_id"))(_events_step(Step("impute_missing", ["value_n"], "interpolate", **_ORDER)))
query("impute_interpolate_global", interpolate_sql(""))(
    _events_step(Step("impute_missing", ["value_n"], "interpolate", order_by=["ts", "event_id"]))
)

# ---- duplicates

SHORT = "l_suppkey, l_linenumber, l_quantity, l_returnflag, l_linestatus"


@query("dedup_all", f"SELECT DISTINCT {SHORT} FROM lineitem")
def _dedup_all(spark, sf):
    return apply_step(LINE_SHORT.df(spark, sf), Step("remove_duplicates", method="all_columns"))


DOCS = "doc_id, lang, source, n_chars"


def _dedup(key: str, method: str, columns, direction: str):
    sql = f"""SELECT {DOCS} FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(columns)} ORDER BY doc_id {direction}) AS rn FROM documents)
    WHERE rn = 1"""

    @query(key, sql)
    def run(spark, sf):
        out = apply_step(table(spark, sf, "documents"), Step("remove_duplicates", columns, method, order_by=["doc_id"]))
        return out.select("doc_id", "lang", "source", "n_chars")

    return run


_dedup("dedup_subset", "subset", ["text"], "")
_dedup("dedup_keep_first", "keep_first", ["lang", "source"], "")
_dedup("dedup_keep_last", "keep_last", ["lang", "source"], "DESC")


@query("drop_column", "SELECT p_partkey, p_type, p_size, p_retailprice FROM part")
def _drop(spark, sf):
    return apply_step(table(spark, sf, "part"), Step("drop_column", ["p_name", "p_brand"], "drop"))


# ---- outliers

_FENCE = f"""
    WITH e AS {EVENTS_N.sql}, q AS (SELECT quantile_cont(value_n, 0.25) AS a, quantile_cont(value_n, 0.75) AS b FROM e),
    f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)
"""
_REMOVE = f"{_FENCE} SELECT {E_KEEP}, {r('value_n')} AS value_n FROM e, f WHERE value_n BETWEEN lo AND hi"
_CAP = f"{_FENCE} SELECT {E_KEEP}, {r('CASE WHEN value_n < lo THEN lo WHEN value_n > hi THEN hi ELSE value_n END')} AS value_n FROM e, f"
query("outlier_remove", _REMOVE)(_events_step(Step("handle_outliers", ["value_n"], "remove")))
query("outlier_winsorize", _CAP)(_events_step(Step("handle_outliers", ["value_n"], "winsorize")))
query("outlier_iqr_remove", _REMOVE)(_events_step(Step("handle_outliers", ["value_n"], "iqr", {"action": "remove"})))
query("outlier_iqr_cap", _CAP)(_events_step(Step("handle_outliers", ["value_n"], "iqr", {"action": "cap"})))


def log_sql(src: str, key: str, c: str) -> str:
    return f"""
    WITH e AS {src}, m AS (SELECT CASE WHEN min({c}) <= 0 THEN abs(min({c})) + 1 ELSE 0 END AS s FROM e)
    SELECT {key}, {r(f'ln({c} + s)')} AS {c} FROM e, m
    """


@query("outlier_log", log_sql("(SELECT * FROM customer)", "c_custkey", "c_acctbal"))
def _outlier_log(spark, sf):
    out = apply_step(table(spark, sf, "customer"), Step("handle_outliers", ["c_acctbal"], "transform"))
    return rounded(out.select("c_custkey", "c_acctbal"))


_Z = f"WITH e AS {EVENTS_N.sql}, s AS (SELECT avg(value_n) AS m, stddev_pop(value_n) AS sp, stddev_samp(value_n) AS ss FROM e)"
query("outlier_z_remove", f"{_Z} SELECT {E_KEEP}, {r('value_n')} AS value_n FROM e, s WHERE abs(value_n - m) / sp <= 3")(
    _events_step(Step("handle_outliers", ["value_n"], "zscore", {"threshold": 3}))
)
query(
    "outlier_z_cap",
    f"{_Z} SELECT {E_KEEP}, {r('CASE WHEN value_n < m - 3 * ss THEN m - 3 * ss WHEN value_n > m + 3 * ss THEN m + 3 * ss ELSE value_n END')} AS value_n FROM e, s",
)(_events_step(Step("handle_outliers", ["value_n"], "zscore", {"threshold": 3, "action": "cap"})))
