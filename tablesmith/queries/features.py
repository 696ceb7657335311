"""Reduction, selection, class balance, time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select as S
from ..operators.balance import adasyn, imbalance_ratio, smote
from ..plans.step import Step, apply_step, fit_step, small_or_cut
from .common import LABELS_TEXT, query, r, rounded, table

NUM4 = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("reduce_pca")
def _pca(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *NUM4)
    return rounded(apply_step(df, Step("dimensionality_reduction", NUM4, "pca", {"n_components": 2})), 4)


@query("reduce_lda")
def _lda(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *NUM4)
    step = Step("dimensionality_reduction", NUM4, "lda", {"target_column": "l_returnflag", "n_components": 2})
    return rounded(apply_step(df, step), 4)


@query(
    "select_correlation",
    "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, {r(f'abs(corr({c}, l_extendedprice))')} AS score FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")),
)
def _select_corr(spark, sf):
    return rounded(S.correlation_scores(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice"))


def _chi2_sql(c: str, y: str) -> str:
    """Even degrees of freedom: the p-value is a finite sum."""
    return f"""
    SELECT feature, {r('chi2', 4)} AS chi2, dof, {r('list_sum(list_transform(range(0, dof // 2), lambda i: exp(i * ln(chi2 / 2) - lgamma(i + 1) - chi2 / 2)))', 9)} AS p_value FROM (
      SELECT '{c}' AS feature, sum((coalesce(n, 0) - e) * (coalesce(n, 0) - e) / e) AS chi2, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS dof
      FROM (SELECT x, y, nx * ny / CAST((SELECT count(*) FROM lineitem) AS DOUBLE) AS e FROM
        (SELECT {c} AS x, count(*) AS nx FROM lineitem GROUP BY 1) CROSS JOIN (SELECT {y} AS y, count(*) AS ny FROM lineitem GROUP BY 1))
      LEFT JOIN (SELECT {c} AS x, {y} AS y, count(*) AS n FROM lineitem GROUP BY 1, 2) USING (x, y))"""


@query("select_chi2", _chi2_sql("l_linestatus", "l_returnflag") + "\nUNION ALL\n" + _chi2_sql("l_linenumber", "l_returnflag"))
def _chi2(spark, sf):
    out = S.chi2_scores(table(spark, sf, "lineitem"), ["l_linestatus", "l_linenumber"], "l_returnflag")
    return out.select("feature", F.round("chi2", 4).alias("chi2"), "dof", F.round("p_value", 9).alias("p_value"))



def _frame(spark, scores: dict, kind: str):
    return spark.createDataFrame([(k, v) for k, v in scores.items()], f"feature string, score {kind}")


@query("select_rfe")
def _rfe(spark, sf):
    return _frame(spark, S.rfe_ranking(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice", 2), "int")


@query("select_lasso")
def _lasso(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(_frame(spark, S.lasso_scores(df, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice", 100.0), "double"), 4)


@query("select_forest")
def _forest(spark, sf):
    step = Step("feature_selection", NUM4, "random_forest", {"target_column": "l_returnflag", "top": 2})
    kept = fit_step(table(spark, sf, "lineitem"), step).params["kept"]
    return spark.createDataFrame([(i, c) for i, c in enumerate(kept, start=1)], "rank int, feature string")


# ---- balance


def _labelled_docs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("words"))
    return table(spark, sf, "labels").select("doc_id", "toxic").join(docs, "doc_id")


def _balance_check(out):
    """Rows per class, those of them synthetic, and whether all lie inside the class's bounding box."""
    real = out.filter(~F.col("synthetic")).groupBy(F.col("toxic").alias("_t")).agg(
        *[fn(c).alias(f"{n}_{c}") for c in ("n_chars", "words") for n, fn in (("lo", F.min), ("hi", F.max))]
    )
    real = small_or_cut(real)
    inside = F.col("n_chars").between(F.col("lo_n_chars") - 1e-6, F.col("hi_n_chars") + 1e-6) & F.col("words").between(
        F.col("lo_words") - 1e-6, F.col("hi_words") + 1e-6
    )
    return out.join(real, F.col("toxic") == F.col("_t")).groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("n_synthetic"), F.bool_and(inside).alias("inside")
    )


@query(
    "smote",
    """WITH c AS (SELECT toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY toxic)
    SELECT toxic, (SELECT max(n) FROM c) AS n, (SELECT max(n) FROM c) - n AS n_synthetic, true AS inside FROM c""",
)
def _smote(spark, sf):
    return _balance_check(smote(_labelled_docs(spark, sf), "toxic", "doc_id", ["n_chars", "words"]))


@query(
    "adasyn",
    """
    WITH d AS (SELECT doc_id, toxic, CAST(n_chars AS DOUBLE) AS a, CAST(len(string_split(text, ' ')) AS DOUBLE) AS b FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT toxic, count(*) AS n, max(count(*)) OVER () - count(*) AS short FROM d GROUP BY toxic),
    k AS (SELECT q.doc_id, q.toxic, CASE WHEN t.toxic <> q.toxic THEN 1.0 ELSE 0.0 END AS other,
        row_number() OVER (PARTITION BY q.doc_id ORDER BY (q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b), t.doc_id) AS rk
      FROM d q JOIN c ON c.toxic = q.toxic AND short > 0 JOIN d t ON t.doc_id <> q.doc_id),
    s AS (SELECT doc_id, toxic, avg(other) AS share FROM k WHERE rk <= 5 GROUP BY doc_id, toxic),
    p AS (SELECT toxic, CAST(sum(round(share * (short / whole))) AS BIGINT) AS made FROM (SELECT *, sum(share) OVER (PARTITION BY toxic) AS whole FROM s) JOIN c USING (toxic) WHERE whole > 0 GROUP BY toxic)
    SELECT toxic, n + coalesce(made, 0) AS n, coalesce(made, 0) AS n_synthetic, true AS inside FROM c LEFT JOIN p USING (toxic)
    """,
)
def _adasyn(spark, sf):
    return _balance_check(adasyn(_labelled_docs(spark, sf), "toxic", "doc_id", ["n_chars", "words"]))


@query(
    "undersample",
    """SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat('42|', CAST(doc_id AS VARCHAR))), doc_id) AS rk
    FROM labels) WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))""",
)
def _undersample(spark, sf):
    return apply_step(table(spark, sf, "labels"), Step("handle_imbalance", ["toxic"], "random_undersampling", key="doc_id"))


@query(
    "class_weights",
    f"""WITH l AS {LABELS_TEXT.sql}, c AS (SELECT toxic AS v, count(*) AS n FROM l GROUP BY 1)
    SELECT doc_id, toxic, {r('(SELECT max(n) FROM c) / CAST(n AS DOUBLE)')} AS toxic_weight FROM l JOIN c ON toxic = v""",
)
def _weights(spark, sf):
    out = apply_step(LABELS_TEXT.df(spark, sf), Step("handle_imbalance", ["toxic"], "class_weights"))
    return rounded(out.select("doc_id", "toxic", "toxic_weight"))


@query(
    "imbalance_ratio",
    f"""SELECT max(n) AS max_count, min(n) AS min_count, {r('max(n) / CAST(min(n) AS DOUBLE)')} AS ratio
    FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)""",
)
def _ratio(spark, sf):
    return rounded(imbalance_ratio(table(spark, sf, "labels"), "toxic"))


# ---- time


@query(
    "time_date_parts",
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year, month(o_orderdate)::INTEGER AS o_orderdate_month, day(o_orderdate)::INTEGER AS o_orderdate_day,
    (isodow(o_orderdate) - 1)::INTEGER AS o_orderdate_weekday, quarter(o_orderdate)::INTEGER AS o_orderdate_quarter FROM orders""",
)
def _date_parts(spark, sf):
    out = apply_step(table(spark, sf, "orders"), Step("time_features", ["o_orderdate"], "date_parts"))
    return out.select("o_orderkey", *[c for c in out.columns if c.startswith("o_orderdate_")])


@query(
    "time_time_parts",
    "SELECT event_id, hour(ts)::INTEGER AS ts_hour, minute(ts)::INTEGER AS ts_minute, second(ts)::INTEGER AS ts_second FROM events",
)
def _time_parts(spark, sf):
    out = apply_step(table(spark, sf, "events"), Step("time_features", ["ts"], "time_parts"))
    return out.select("event_id", "ts_hour", "ts_minute", "ts_second")


_CYCLE = {"month": ("month(ts)", 12), "weekday": ("(isodow(ts) - 1)", 7), "hour": ("hour(ts)", 24)}


@query(
    "time_cyclical",
    "SELECT event_id, "
    + ", ".join(f"{r(f'{fn}(2 * pi() / {n} * {e})')} AS ts_{name}_{fn}" for name, (e, n) in _CYCLE.items() for fn in ("sin", "cos"))
    + " FROM events",
)
def _cyclical(spark, sf):
    out = apply_step(table(spark, sf, "events"), Step("time_features", ["ts"], "cyclical"))
    return rounded(out.select("event_id", *[c for c in out.columns if c.startswith("ts_")]))


HOLIDAYS = ["2024-01-01", "2024-01-15"]


@query("time_holidays", "SELECT event_id, CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15') AS ts_is_holiday FROM events")
def _holidays(spark, sf):
    out = apply_step(table(spark, sf, "events"), Step("time_features", ["ts"], "holidays", {"holidays": HOLIDAYS}))
    return out.select("event_id", "ts_is_holiday")


@query(
    "time_lag",
    """SELECT event_id, user_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 3) OVER w AS value_lag_3 FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _lag(spark, sf):
    step = Step("time_features", ["value"], "lag_features", {"lags": [1, 3]}, order_by=["ts", "event_id"], partition_by=["user_id"])
    return apply_step(table(spark, sf, "events"), step).select("event_id", "user_id", "value_lag_1", "value_lag_3")
