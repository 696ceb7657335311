"""Checks, splits, models, metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..models import metrics as M
from ..models import train as T
from ..models.validate import model_candidates, problem_type, validate
from ..operators.charts import histogram
from ..operators.profile import value_counts
from .charting import histogram_sql
from .common import PREDICTIONS, PREDICTIONS_3, REGRESSION, Input, query, r, rounded, table, union

# ---- before training


def _type_sql(t, y, text):
    kind = "'classification'" if text else f"CASE WHEN count(DISTINCT {y}) < 10 THEN 'classification' ELSE 'regression' END"
    return f"SELECT '{y}' AS target, {kind} AS problem FROM {t}" + (" HAVING count(*) > 0" if text else "")


@query("problem_type", union([_type_sql("lineitem", "l_returnflag", True), _type_sql("lineitem", "l_linenumber", False), _type_sql("lineitem", "l_extendedprice", False)]))
def _problem(spark, sf):
    df = table(spark, sf, "lineitem")
    return spark.createDataFrame([(y, problem_type(df, y)) for y in ("l_returnflag", "l_linenumber", "l_extendedprice")], "target string, problem string")


@query(
    "target_distribution",
    f"""SELECT l_returnflag AS value, count(*) AS "count", {r('100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)', 1)} AS percent FROM lineitem GROUP BY 1""",
)
def _target(spark, sf):
    out = value_counts(table(spark, sf, "lineitem"), "l_returnflag")
    return out.select("value", "count", F.round(F.col("share") * 100, 1).alias("percent"))


@query("target_histogram", histogram_sql("lineitem", "l_extendedprice", 30))
def _target_histogram(spark, sf):
    return rounded(histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30))


CHECKED = Input(
    "events",
    ("event_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value_n", "props", "CASE WHEN event_id < 3 THEN 'rare' WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS target"),
)


@query(
    "validate_ml",
    f"""
    WITH e AS {CHECKED.sql}
    SELECT 'feature_nulls' AS check_name, 'value_n' AS "column", CAST(count(*) FILTER (value_n IS NULL) AS VARCHAR) AS detail FROM e HAVING count(*) FILTER (value_n IS NULL) > 0
    UNION ALL SELECT 'target_nulls', 'target', CAST(count(*) FILTER (target IS NULL) AS VARCHAR) FROM e HAVING count(*) FILTER (target IS NULL) > 0
    UNION ALL SELECT 'text_feature', 'props', 'string'
    UNION ALL SELECT 'few_rows', NULL, CAST(count(*) AS VARCHAR) FROM e HAVING count(*) < 10
    UNION ALL SELECT 'small_class', 'target', target || '=' || CAST(count(*) AS VARCHAR) FROM e WHERE target IS NOT NULL GROUP BY target HAVING count(*) < 5
    UNION ALL SELECT 'one_class', 'target', CAST(count(DISTINCT target) AS VARCHAR) FROM e HAVING count(DISTINCT target) < 2
    """,
)
def _validate(spark, sf):
    return validate(CHECKED.df(spark, sf), ["value_n", "event_id", "props"], "target")


_ISTEST = "substr(md5(concat('42|', CAST(o_orderkey AS VARCHAR))), 1, 8) < '33333333'"


@query("split_random", f"SELECT o_orderkey, o_orderstatus, {_ISTEST} AS is_test FROM orders")
def _split(spark, sf):
    return T.split_random(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query(
    "split_stratified",
    """SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat('42|', CAST(o_orderkey AS VARCHAR))), o_orderkey)
    <= ceil(0.2 * count(*) OVER (PARTITION BY o_orderstatus)) AS is_test FROM orders""",
)
def _stratified(spark, sf):
    return T.split_stratified(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query(
    "assemble_features",
    """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label, [o_totalprice, CAST(o_custkey AS DOUBLE)] AS features FROM orders""",
)
def _assemble(spark, sf):
    out = T.assemble(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], "o_orderstatus", "o_orderkey")
    return out.select("o_orderkey", "label", vector_to_array("features").alias("features"))


def _candidate_sql() -> str:
    rows = [
        ("logistic_regression", "k = 2", "true", "NULL"),
        ("svm", "n < 10000", "n <= 10000", "CASE WHEN n > 10000 THEN 'many_rows' END"),
        ("naive_bayes", "false", "true", "NULL"),
        ("knn", "false", "n <= 10000", "CASE WHEN n > 10000 THEN 'many_rows' END"),
        ("decision_tree", "false", "true", "CASE WHEN n < 100 THEN 'few_rows' END"),
        ("random_forest", "true", "true", "CASE WHEN n > 100000 THEN 'many_rows' END"),
        ("gradient_boosting", "true", "true", "CASE WHEN n > 50000 THEN 'many_rows' END"),
        ("xgboost", "false", "true", "CASE WHEN n > 100000 THEN 'many_rows' END"),
    ]
    profile = "(SELECT sum(c) AS n, count(*) AS k, max(c) AS top FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_returnflag))"
    return union(
        [
            f"SELECT 'classification' AS problem, '{m}' AS model, {rec} AS recommended, {ok} AS suitable, CAST({w} AS VARCHAR) AS warning, top / n > 0.7 AS resample FROM {profile}"
            for m, rec, ok, w in rows
        ]
    )


@query("model_candidates", _candidate_sql())
def _candidates(spark, sf):
    return model_candidates(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag")


# ---- models: paid is what the line costs after discount and tax, plus a part no feature explains

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
_PAID = "l_quantity * (1 - l_discount) * (1 + l_tax) * 100 + l_extendedprice / 100"
LINES = Input(
    "lineitem",
    (
        "l_orderkey * 1000 + l_partkey * 7 + l_linenumber AS line_key", "l_quantity", "l_discount", "l_tax", "CAST(l_linenumber AS DOUBLE) AS l_linenumber",
        f"{_PAID} AS paid", f"CASE WHEN {_PAID} > 4000 THEN 1 ELSE 0 END AS dear",
        f"CASE WHEN {_PAID} > 4000 THEN 2 WHEN {_PAID} > 2000 THEN 1 ELSE 0 END AS band",
    ),
)


def _parts(spark, sf, target):
    """Train and test vectors by hash split; the caller's query is one fit and one lazy prediction."""
    df = T.split_random(LINES.df(spark, sf), "line_key")
    train = T.assemble(df.filter(~F.col("is_test")), FEATURES, target, "line_key")
    test = T.assemble(df.filter("is_test"), FEATURES, target, "line_key")
    return T.spread(train), test


def _classifier(key: str, model: str, target: str = "dear", sql: str | None = None, **params):
    @query(key, sql)
    def run(spark, sf):
        train, test = _parts(spark, sf, target)
        classes = 2 if target == "dear" else 3
        try:
            pred = T.fit_predict(model, "classification", train, test, classes, **params)
        finally:
            train.unpersist()
        return rounded(T.metric_table(pred, "classification", [float(i) for i in range(classes)]), 4)

    return run


def _regressor(key: str, model: str, **params):
    @query(key)
    def run(spark, sf):
        train, test = _parts(spark, sf, "paid")
        try:
            pred = T.fit_predict(model, "regression", train, test, **params)
        finally:
            train.unpersist()
        return rounded(M.metrics_regression(pred), 4)

    return run


_classifier("clf_logistic", "logistic_regression", "band")
_classifier("clf_tree", "decision_tree", "band")
# forests to depth 10: to the default, which is no limit, a test run over all queries would take them minutes
_classifier("clf_forest", "random_forest", "band", maxDepth=10)
_classifier("clf_svm", "svm")
_classifier("clf_gbt", "gradient_boosting")
_classifier("clf_xgb", "xgboost")
_regressor("reg_tree", "decision_tree")
_regressor("reg_forest", "random_forest", maxDepth=10)
_regressor("reg_gbt", "gradient_boosting")
_regressor("reg_xgb", "xgboost")
_regressor("reg_ridge", "ridge")
_regressor("reg_lasso", "lasso")
_regressor("reg_svr", "svr")


@query(
    "reg_linear",
    f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_quantity, {r('a * l_quantity + b', 4)} AS prediction FROM lineitem, f""",
)
def _reg_linear(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    train = T.assemble(df, ["l_quantity"], "l_extendedprice")
    model = T.estimator("linear_regression", "regression", solver="normal").fit(train)
    from pyspark.ml.feature import VectorAssembler

    out = model.transform(VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(df))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity", "prediction"), 4)


KNN_ORDERS = Input("orders", ("o_orderkey", "o_orderstatus", "o_totalprice", "o_totalprice / 1000 AS f1", "CAST(o_custkey AS DOUBLE) / 10 AS f2"))


def _knn_sql(agg: str, value: str) -> str:
    return f"""
    WITH o AS (SELECT *, {_ISTEST} AS is_test FROM {KNN_ORDERS.sql}),
    d AS (SELECT q.o_orderkey AS k, t.o_orderkey AS tk, t.{value} AS v, (q.f1 - t.f1) * (q.f1 - t.f1) + (q.f2 - t.f2) * (q.f2 - t.f2) AS dist
      FROM o q, o t WHERE q.is_test AND NOT t.is_test),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dist, tk) AS rk FROM d) WHERE rk <= 5)
    {agg}"""


def _knn_parts(spark, sf):
    df = T.split_random(KNN_ORDERS.df(spark, sf), "o_orderkey")
    return df.filter(~F.col("is_test")), df.filter("is_test")


@query(
    "clf_knn",
    _knn_sql(
        """SELECT k AS o_orderkey, o_orderstatus AS label, v AS prediction FROM (
        SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, v) AS best FROM n GROUP BY k, v) JOIN o ON k = o_orderkey WHERE best = 1""",
        "o_orderstatus",
    ),
)
def _clf_knn(spark, sf):
    train, test = _knn_parts(spark, sf)
    return T.knn_predict(train, test, ["f1", "f2"], "o_orderstatus", "o_orderkey", "classification")


@query(
    "reg_knn",
    _knn_sql(
        f"SELECT k AS o_orderkey, {r('any_value(o_totalprice)')} AS label, {r('avg(v)')} AS prediction FROM n JOIN o ON k = o_orderkey GROUP BY k",
        "o_totalprice",
    ),
)
def _reg_knn(spark, sf):
    train, test = _knn_parts(spark, sf)
    return rounded(T.knn_predict(train, test, ["f1", "f2"], "o_totalprice", "o_orderkey", "regression"))


# ---- metrics on a fixed prediction rule, so that the oracle is exact

P, P3, G = PREDICTIONS.sql, PREDICTIONS_3.sql, REGRESSION.sql


@query(
    "confusion_matrix",
    f"""SELECT label, prediction, count(*) AS "count", {r('100.0 * count(*) / CAST(sum(count(*)) OVER (PARTITION BY label) AS DOUBLE)')} AS row_pct
    FROM {P3} GROUP BY label, prediction""",
)
def _confusion(spark, sf):
    return rounded(M.confusion_matrix(PREDICTIONS_3.df(spark, sf)))


_PER = f"""c AS (SELECT l AS cls, (SELECT count(*) FROM p WHERE label = l AND prediction = l) AS tp, (SELECT count(*) FROM p WHERE label = l) AS t,
    (SELECT count(*) FROM p WHERE prediction = l) AS q FROM (SELECT DISTINCT label AS l FROM p UNION SELECT DISTINCT prediction FROM p)),
    s AS (SELECT *, coalesce(tp / nullif(CAST(q AS DOUBLE), 0), 0) AS pr, coalesce(tp / nullif(CAST(t AS DOUBLE), 0), 0) AS rc,
      coalesce(2 * tp / nullif(CAST(q + t AS DOUBLE), 0), 0) AS f1 FROM c)"""


def classification_sql(src: str) -> str:
    return f"""WITH p AS {src}, {_PER}, m AS (SELECT CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(t) AS DOUBLE) AS n, sum(pr * t) AS wp, sum(rc * t) AS wr, sum(f1 * t) AS wf,
      avg(rc) FILTER (t > 0) AS ba, CAST(sum(q * t) AS DOUBLE) AS pt, CAST(sum(q * q) AS DOUBLE) AS pp, CAST(sum(t * t) AS DOUBLE) AS tt FROM s)
    SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'balanced_accuracy', 'matthews']) AS metric,
      unnest([{r('c / n')}, {r('wp / n')}, {r('wr / n')}, {r('wf / n')}, {r('ba')}, {r('(c * n - pt) / (sqrt(n * n - pp) * sqrt(n * n - tt))')}]) AS value FROM m"""


@query("metrics_classification", classification_sql(P3))
def _classification(spark, sf):
    return rounded(M.metrics_classification(PREDICTIONS_3.df(spark, sf)))


def _auc_sql(src: str, positive: str, score: str) -> str:
    return f"""SELECT (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * CAST(count(*) FILTER (NOT y) AS DOUBLE)) AS auc,
    count(*) FILTER (y) AS n FROM (SELECT {positive} AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk FROM {src})"""


@query("metric_roc_auc", f"SELECT {r('auc')} AS auc FROM ({_auc_sql(P, 'label = 1', 'score')})")
def _auc(spark, sf):
    return rounded(M.roc_auc(PREDICTIONS.df(spark, sf)))


_SCORES = {"F": "score_f", "O": "score_o", "P": "score_p"}
_AUC3 = union([_auc_sql(P3, "label = '" + c + "'", s) for c, s in _SCORES.items()])


@query("metric_roc_auc_multiclass", f"SELECT {r('sum(auc * n) / sum(n)')} AS auc FROM ({_AUC3})")
def _auc3(spark, sf):
    return rounded(M.roc_auc_multiclass(PREDICTIONS_3.df(spark, sf), _SCORES))


@query(
    "metrics_regression",
    f"""WITH m AS (SELECT avg((label - prediction) * (label - prediction)) AS mse, avg(abs(label - prediction)) AS mae, max(abs(label - prediction)) AS mx,
      quantile_cont(abs(label - prediction), 0.5) AS md, var_pop(label) AS vy, var_pop(label - prediction) AS ve FROM {G})
    SELECT unnest(['mse', 'rmse', 'mae', 'r2', 'explained_variance', 'max_error', 'median_absolute_error']) AS metric,
      unnest([{r('mse', 1)}, {r('sqrt(mse)', 4)}, {r('mae', 4)}, {r('1 - mse / vy', 4)}, {r('1 - ve / vy', 4)}, {r('mx', 4)}, {r('md', 4)}]) AS value FROM m""",
)
def _regression(spark, sf):
    out = M.metrics_regression(REGRESSION.df(spark, sf))
    return out.withColumn("value", F.when(F.col("metric") == "mse", F.round("value", 1)).otherwise(F.round("value", 4)))


# naive Bayes: moments per class of the training part, log densities of the test part
_LINE_TEST = "substr(md5(concat('42|', CAST(line_key AS VARCHAR))), 1, 8) < '33333333'"
_NB_STATS = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in FEATURES)
_NB_DENSITY = " - ".join(["ln(c.n / CAST(w.n AS DOUBLE))", *[f"0.5 * ln(2 * pi() * (v_{f} + w.eps)) - (t.{f} - m_{f}) * (t.{f} - m_{f}) / (v_{f} + w.eps) / 2" for f in FEATURES]])
_NB_SQL = f"""
    WITH a AS (SELECT *, row_number() OVER () AS id FROM {LINES.sql}),
    c AS (SELECT band, count(*) AS n, {_NB_STATS} FROM a WHERE NOT {_LINE_TEST} GROUP BY band),
    w AS (SELECT count(*) AS n, 1e-9 * greatest({', '.join(f'var_pop({f})' for f in FEATURES)}) AS eps FROM a WHERE NOT {_LINE_TEST}),
    s AS (SELECT t.id, t.band AS label, c.band AS cls, {_NB_DENSITY} AS score FROM a t, c, w WHERE {_LINE_TEST}),
    x AS (SELECT *, exp(score - max(score) OVER (PARTITION BY id)) AS e, row_number() OVER (PARTITION BY id ORDER BY score DESC, cls) AS best FROM s),
    p AS (SELECT id, any_value(label) AS label, max(cls) FILTER (best = 1) AS prediction, max(e) FILTER (cls = 0) / sum(e) AS s0, max(e) FILTER (cls = 1) / sum(e) AS s1,
      max(e) FILTER (cls = 2) / sum(e) AS s2 FROM x GROUP BY id),
    {_PER.replace('s AS (', 'q AS (')},
    m AS (SELECT CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(t) AS DOUBLE) AS n, sum(pr * t) AS wp, sum(rc * t) AS wr, sum(f1 * t) AS wf,
      avg(rc) FILTER (t > 0) AS ba, CAST(sum(q * t) AS DOUBLE) AS pt, CAST(sum(q * q) AS DOUBLE) AS pp, CAST(sum(t * t) AS DOUBLE) AS tt FROM q),
    u AS (SELECT sum(auc * n) / sum(n) AS auc FROM ({union([_auc_sql('p', f'label = {i}', f's{i}') for i in range(3)])}))
    SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'balanced_accuracy', 'matthews', 'roc_auc']) AS metric,
      unnest([{r('c / n', 4)}, {r('wp / n', 4)}, {r('wr / n', 4)}, {r('wf / n', 4)}, {r('ba', 4)}, {r('(c * n - pt) / (sqrt(n * n - pp) * sqrt(n * n - tt))', 4)}, {r('auc', 4)}]) AS value FROM m, u
""".replace("c AS (SELECT l AS cls", "k AS (SELECT l AS cls").replace("AS f1 FROM c)", "AS f1 FROM k)")
_classifier("clf_nb", "naive_bayes", "band", _NB_SQL)


_CUM = f"""g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM {P} GROUP BY score),
    k AS (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""


@query("roc_curve", f"WITH {_CUM} SELECT {r('score')} AS threshold, {r('fp / CAST(n AS DOUBLE)')} AS fpr, {r('tp / CAST(p AS DOUBLE)')} AS tpr FROM k UNION ALL SELECT NULL, 0, 0")
def _roc(spark, sf):
    return rounded(M.roc_curve(PREDICTIONS.df(spark, sf)))


@query("pr_curve", f"WITH {_CUM} SELECT {r('score')} AS threshold, {r('tp / CAST(tp + fp AS DOUBLE)')} AS precision, {r('tp / CAST(p AS DOUBLE)')} AS recall FROM k UNION ALL SELECT NULL, 1, 0")
def _pr(spark, sf):
    return rounded(M.pr_curve(PREDICTIONS.df(spark, sf)))


@query("average_precision", f"WITH {_CUM} SELECT {r('sum(pos / CAST(p AS DOUBLE) * tp / CAST(tp + fp AS DOUBLE))')} AS average_precision FROM k")
def _ap(spark, sf):
    return rounded(M.average_precision(PREDICTIONS.df(spark, sf)))


@query("class_report", f"WITH p AS {P3}, {_PER} SELECT cls, {r('pr')} AS precision, {r('rc')} AS recall, {r('f1')} AS f1, t AS support FROM s")
def _report(spark, sf):
    return rounded(M.class_report(PREDICTIONS_3.df(spark, sf)))


@query(
    "test_class_distribution",
    f"""SELECT o_orderstatus AS label, count(*) AS "count", {r('100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS percent
    FROM orders WHERE {_ISTEST} GROUP BY 1""",
)
def _distribution(spark, sf):
    test = T.split_random(table(spark, sf, "orders"), "o_orderkey").filter("is_test").withColumnRenamed("o_orderstatus", "label")
    return rounded(M.class_distribution(test))


@query("residuals", f"SELECT o_orderkey, {r('label', 4)} AS label, {r('prediction', 4)} AS prediction, {r('label - prediction', 4)} AS residual FROM {G}")
def _residuals(spark, sf):
    return rounded(M.residuals(REGRESSION.df(spark, sf)), 4)


@query("residual_histogram", histogram_sql(G, "(label - prediction)", 30))
def _residual_histogram(spark, sf):
    return rounded(M.residual_histogram(REGRESSION.df(spark, sf)))


@query("prediction_range", f"SELECT {r('least(min(label), min(prediction))')} AS low, {r('greatest(max(label), max(prediction))')} AS high FROM {G}")
def _range(spark, sf):
    return rounded(M.prediction_range(REGRESSION.df(spark, sf)))


def _poly_sql(x: str, ks, last: bool = False) -> str:
    out = "0.0"
    for k in [*ks, *([1.0] if last else [])]:
        out = f"({out} * {x} + ({k}))"
    return out


_PPF = f"""CASE WHEN p < {M.PPF_LOW} THEN {_poly_sql('t', M.PPF_C)} / {_poly_sql('t', M.PPF_D, True)}
    WHEN p > 1 - {M.PPF_LOW} THEN -{_poly_sql('t', M.PPF_C)} / {_poly_sql('t', M.PPF_D, True)}
    ELSE {_poly_sql('(q * q)', M.PPF_A)} * q / {_poly_sql('(q * q)', M.PPF_B, True)} END"""
_QQ = f"""
    WITH e AS (SELECT o_orderkey, label - prediction AS residual, row_number() OVER (ORDER BY label - prediction, o_orderkey) AS i, count(*) OVER () AS n FROM {G}),
    u AS (SELECT *, CASE WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) WHEN i = n THEN pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END AS p FROM e),
    z AS (SELECT *, CAST(p AS DOUBLE) - 0.5 AS q, sqrt(-2 * ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END)) AS t FROM u),
    f AS (SELECT o_orderkey, i, residual, CAST({_PPF} AS DOUBLE) AS theoretical FROM z)
"""


@query("qq_points", f"{_QQ} SELECT o_orderkey, i AS position, {r('theoretical')} AS theoretical, {r('residual', 4)} AS residual FROM f")
def _qq(spark, sf):
    out = M.qq_points(REGRESSION.df(spark, sf), "o_orderkey")
    return out.select("o_orderkey", "position", F.round("theoretical", 6).alias("theoretical"), F.round("residual", 4).alias("residual"))


@query(
    "qq_line",
    f"{_QQ} SELECT {r('regr_slope(residual, theoretical)', 3)} AS slope, {r('regr_intercept(residual, theoretical)', 3)} AS intercept, {r('sqrt(regr_r2(residual, theoretical))', 6)} AS r FROM f",
)
def _qq_line(spark, sf):
    out = M.qq_line(M.qq_points(REGRESSION.df(spark, sf), "o_orderkey"))
    return out.select(F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 6).alias("r"))


# ---- training


@query("feature_importance")
def _importance(spark, sf):
    train, _ = _parts(spark, sf, "dear")
    try:
        model = T.fit_model("random_forest", "classification", train, maxDepth=5)
    finally:
        train.unpersist()
    return spark.createDataFrame([(f, round(v, 6)) for f, v in T.feature_importance(model, FEATURES)], "feature string, importance double")


@query("cross_validate")
def _cv(spark, sf):
    return rounded(T.cross_validate(LINES.df(spark, sf), FEATURES, "paid", "line_key", "linear_regression", 5), 4)


@query("grid_search")
def _grid(spark, sf):
    return rounded(T.grid_search(LINES.df(spark, sf), FEATURES, "dear", "line_key", "decision_tree"), 4)


def _bucket(key: str, folds: int) -> str:
    return f"CAST('0x' || substr(md5(concat('42|', CAST({key} AS VARCHAR))), 1, 8) AS BIGINT) % {folds}"


def _summary(points: str, folds: int) -> str:
    """Mean and deviation of a point's scores, added in the order of the folds."""
    at = [f"max(score) FILTER (fold = {f})" for f in range(folds)]
    mean = f"({' + '.join(at)}) / {folds}"
    dev = " + ".join(f"pow({x} - {mean}, 2)" for x in at)
    return f"SELECT {points}, {mean} AS mean, sqrt(({dev}) / {folds}) AS std FROM f GROUP BY {points}"


KNN_PART = Input("part", ("p_partkey", "p_type", "p_retailprice", "CAST(p_size AS DOUBLE) AS f1", "p_retailprice / 10 AS f2"))


def _knn_folds(folds: int, ks: list[int], weights: list[str]) -> str:
    """Every part's neighbours in other folds by brute force, votes of every point, accuracy per fold."""
    w = "CASE w WHEN 'uniform' THEN 1.0::DOUBLE ELSE least(1 / nullif(sqrt(dist), 0), 1e12) END"
    return f"""
    WITH o AS (SELECT *, {_bucket('p_partkey', folds)} AS fold FROM {KNN_PART.sql}),
    d AS (SELECT q.p_partkey AS id, q.fold, q.p_type AS label, t.p_type AS v, t.p_partkey AS tk, (q.f1 - t.f1) * (q.f1 - t.f1) + (q.f2 - t.f2) * (q.f2 - t.f2) AS dist
      FROM o q, o t WHERE q.fold <> t.fold),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, tk) AS rk FROM d QUALIFY rk <= {max(ks)}),
    g AS (SELECT * FROM (SELECT unnest({ks}) AS k), (SELECT unnest({weights}) AS w)),
    v AS (SELECT id, fold, label, k, w, v, sum(coalesce({w}, 1e12) ORDER BY rk) AS votes FROM n, g WHERE rk <= k GROUP BY ALL),
    b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id, k, w ORDER BY votes DESC, v) = 1),
    f AS (SELECT k, w, fold, avg(CASE WHEN v = label THEN 1.0 ELSE 0.0 END) AS score FROM b GROUP BY k, w, fold),
    z AS ({_summary('k, w', folds)})"""


@query("cross_validate_knn", f"{_knn_folds(5, [5], ['uniform'])} SELECT CAST(fold AS INTEGER) AS fold, {r('score', 4)} AS score, {r('mean', 4)} AS mean, {r('std', 4)} AS std FROM f JOIN z USING (k, w)")
def _cv_knn(spark, sf):
    return rounded(T.cross_validate(KNN_PART.df(spark, sf), ["f1", "f2"], "p_type", "p_partkey", "knn", 5), 4)


@query(
    "grid_search_knn",
    f"""{_knn_folds(3, T.GRIDS['knn']['n_neighbors'], T.GRIDS['knn']['weights'])},
    j AS (SELECT *, '{{"n_neighbors": ' || k || ', "weights": "' || w || '"}}' AS params FROM z)
    SELECT CAST(row_number() OVER (ORDER BY mean DESC, params) AS INTEGER) AS rank, params, {r('mean', 4)} AS mean_score, {r('std', 4)} AS std_score FROM j""",
)
def _grid_knn(spark, sf):
    return rounded(T.grid_search(KNN_PART.df(spark, sf), ["f1", "f2"], "p_type", "p_partkey", "knn"), 4)


_NB_GRID_SQL = f"""
    WITH a AS (SELECT *, row_number() OVER () AS id, {_bucket('line_key', 3)} AS fold FROM {LINES.sql}),
    h AS (SELECT unnest([0, 1, 2]) AS held), g AS (SELECT unnest([1e-9, 1e-8, 1e-7, 1e-6]) AS k),
    c AS (SELECT held, band, count(*) AS n, {_NB_STATS} FROM a, h WHERE fold <> held GROUP BY held, band),
    w AS (SELECT held, k, count(*) AS n, k * greatest({', '.join(f'var_pop({f})' for f in FEATURES)}) AS eps FROM a, h, g WHERE fold <> held GROUP BY held, k),
    s AS (SELECT t.id, t.fold, w.k, t.band AS label, c.band AS cls, {_NB_DENSITY} AS score FROM a t JOIN c ON c.held = t.fold JOIN w ON w.held = t.fold),
    b AS (SELECT id, fold, k, label, arg_min(cls, {{'a': -score, 'b': cls}}) AS v FROM s GROUP BY id, fold, k, label),
    f AS (SELECT k, fold, avg(CASE WHEN v = label THEN 1.0 ELSE 0.0 END) AS score FROM b GROUP BY k, fold),
    z AS ({_summary('k', 3)}), j AS (SELECT *, '{{"var_smoothing": ' || CASE k WHEN 1e-9 THEN '1e-09' WHEN 1e-8 THEN '1e-08' WHEN 1e-7 THEN '1e-07' ELSE '1e-06' END || '}}' AS params FROM z)
    SELECT CAST(row_number() OVER (ORDER BY mean DESC, params) AS INTEGER) AS rank, params, {r('mean', 4)} AS mean_score, {r('std', 4)} AS std_score FROM j"""


@query("grid_search_nb", _NB_GRID_SQL)
def _grid_nb(spark, sf):
    return rounded(T.grid_search(LINES.df(spark, sf), FEATURES, "band", "line_key", "naive_bayes"), 4)


@query("train_many")
def _train_many(spark, sf):
    df = T.split_random(LINES.df(spark, sf), "line_key")
    train, test = df.filter(~F.col("is_test")).drop("is_test"), df.filter("is_test").drop("is_test")
    return rounded(T.train_many(train, test, FEATURES, "dear", "line_key", ["logistic_regression", "decision_tree", "knn", "naive_bayes"], cv=2), 4)


# two fixed rules as competing models, and one failed run
_RULES = {"rule_50": 50, "rule_30": 30}


@query(
    "best_model",
    "\nUNION ALL\n".join(
        f"""SELECT * FROM (WITH p AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_orderkey * 37 % 101 AS x FROM orders),
        b AS (SELECT m, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (label = 1) / 2 + avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (label = 0) / 2 AS ba,
          avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS acc FROM (SELECT m, label, (x > lim) = (label = 1) AS hit FROM p, (SELECT 'rule_50' AS m, 50 AS lim UNION ALL SELECT 'rule_30', 30)) GROUP BY m)
        SELECT m AS model, 'balanced_accuracy' AS metric, {r('ba')} AS value, CASE WHEN acc > 0.9 THEN 'excellent' WHEN acc > 0.8 THEN 'good' WHEN acc > 0.7 THEN 'moderate' ELSE 'poor' END AS grade
        FROM b ORDER BY ba DESC, m LIMIT 1)"""
        for _ in range(1)
    ),
)
def _best(spark, sf):
    runs = None
    for name, limit in _RULES.items():
        x = (F.col("o_orderkey") * 37) % 101
        pred = table(spark, sf, "orders").select(
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"), F.when(x > limit, 1).otherwise(0).alias("prediction")
        )
        part = M.metrics_classification(pred).withColumns({"model": F.lit(name), "error": F.lit(None).cast("string")})
        runs = part if runs is None else runs.unionByName(part)
    failed = spark.createDataFrame([("balanced_accuracy", 1.0, "broken", "ValueError")], "metric string, value double, model string, error string")
    return rounded(M.best_model(runs.unionByName(failed), "classification"))
