"""Chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as V
from ..operators.correlate import matrix_kendall, matrix_pearson, matrix_spearman, top_pairs
from .common import EVENTS_N, LINE_PAIR, ORDERS_N, query, r, rounded, table, union
from .issueset import pair_sql


def histogram_sql(src: str, c: str, bins: int, digits: int = 6) -> str:
    return f"""
    WITH h AS (SELECT {c} AS x FROM {src}), m AS (SELECT min(x) AS lo, max(x) AS hi FROM h),
    b AS (SELECT unnest(range(0, {bins})) AS bin),
    c AS (SELECT least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1})::INTEGER AS i, count(*) AS n FROM h, m WHERE x IS NOT NULL GROUP BY 1)
    SELECT CAST(bin AS INTEGER) AS bin, {r(f'm.lo + bin * ((hi - m.lo) / {bins})', digits)} AS lo, {r(f'm.lo + (bin + 1) * ((hi - m.lo) / {bins})', digits)} AS hi,
      coalesce(n, 0) AS n FROM b CROSS JOIN m LEFT JOIN c ON bin = i"""


@query("chart_histogram", histogram_sql("orders", "o_totalprice", 20))
def _histogram(spark, sf):
    return rounded(V.histogram(table(spark, sf, "orders"), "o_totalprice", 20))


@query(
    "chart_histogram_stats",
    f"""SELECT {r('avg(value_n)')} AS mean, {r('quantile_cont(value_n, 0.5)')} AS median, {r('stddev_samp(value_n)')} AS std, {r('min(value_n)')} AS min,
    {r('max(value_n)')} AS max, {r('skewness(value_n)')} AS skew, {r('kurtosis(value_n)')} AS kurtosis, count(*) FILTER (value_n IS NULL) AS missing
    FROM {EVENTS_N.sql}""",
)
def _histogram_stats(spark, sf):
    return rounded(V.histogram_stats(EVENTS_N.df(spark, sf), "value_n"))


def box_sql(group: str) -> str:
    return f"""
    WITH e AS (SELECT {group} AS g, value_n AS x FROM {EVENTS_N.sql} WHERE value_n IS NOT NULL),
    q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS md, quantile_cont(x, 0.75) AS q3 FROM e GROUP BY g),
    j AS (SELECT e.g, x, q1, md, q3, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM e JOIN q ON e.g = q.g)
    SELECT g AS "group", {r('avg(x)')} AS mean, {r('any_value(md)')} AS median, {r('any_value(q1)')} AS q1, {r('any_value(q3)')} AS q3,
      {r('any_value(q3 - q1)')} AS iqr, count(*) FILTER (NOT ok) AS outliers, {r('min(x) FILTER (ok)')} AS low_whisker, {r('max(x) FILTER (ok)')} AS high_whisker
    FROM j GROUP BY g"""


@query("chart_box", union([f"SELECT * FROM ({box_sql(g)})" for g in ("'all'", "event_type")]))
def _box(spark, sf):
    df = EVENTS_N.df(spark, sf)
    return rounded(V.box(df, "value_n").unionByName(V.box(df, "value_n", "event_type")))


@query(
    "chart_scatter",
    f"""SELECT {r('corr(l_quantity, l_extendedprice)')} AS correlation, {r('avg(l_quantity)')} AS x_mean, {r('avg(l_extendedprice)')} AS y_mean,
    {r('stddev_samp(l_quantity)')} AS x_std, {r('stddev_samp(l_extendedprice)')} AS y_std FROM lineitem""",
)
def _scatter(spark, sf):
    return rounded(V.scatter_stats(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query(
    "chart_scatter_points",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders ORDER BY md5(concat('42|', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 1000""",
)
def _points(spark, sf):
    return V.scatter_points(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey", color_by="o_orderstatus")


@query(
    "chart_trendline",
    f"""SELECT {r('regr_slope(l_extendedprice, l_quantity)')} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)')} AS intercept,
    {r('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem""",
)
def _trend(spark, sf):
    return rounded(V.trendline(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


MATRIX = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def matrix_sql(pairs: str, columns) -> str:
    """Both triangles and the diagonal from ``(col1, col2, r)``."""
    same = union([f"SELECT '{c}', '{c}', 1.0" for c in columns])
    return f"""SELECT col1, col2, {r('r')} AS r FROM (WITH p AS ({pairs})
    SELECT col1, col2, r FROM p UNION ALL SELECT col2, col1, r FROM p UNION ALL {same})"""


def plain_pairs(src: str, columns, expr: str) -> str:
    return union(
        [f"SELECT '{a}' AS col1, '{b}' AS col2, {expr.format(a=a, b=b)} AS r FROM {src}" for i, a in enumerate(columns) for b in columns[i + 1 :]]
    )


@query("corr_matrix_pearson", matrix_sql(plain_pairs("lineitem", MATRIX, "corr({a}, {b})"), MATRIX))
def _pearson(spark, sf):
    return rounded(matrix_pearson(table(spark, sf, "lineitem"), list(MATRIX)))


RANKED = (
    "(SELECT "
    + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in MATRIX)
    + " FROM lineitem)"
)


@query("corr_matrix_spearman", matrix_sql(plain_pairs(RANKED, MATRIX, "corr({a}, {b})"), MATRIX))
def _spearman(spark, sf):
    return rounded(matrix_spearman(table(spark, sf, "lineitem"), list(MATRIX)))


def kendall_sql(a: str, b: str) -> str:
    return f"""
    SELECT '{a}' AS col1, '{b}' AS col2, s / (sqrt(n0 - tx) * sqrt(n0 - ty)) AS r FROM (
      SELECT (SELECT sum(p.n * CAST(q.n AS DOUBLE) * sign(p.y - q.y)) FROM c_{a}_{b} p JOIN c_{a}_{b} q ON p.x > q.x) AS s,
        (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c_{a}_{b} GROUP BY x)) AS tx,
        (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c_{a}_{b} GROUP BY y)) AS ty,
        (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM c_{a}_{b}) AS n0)"""


KENDALL = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
_KPAIRS = [(a, b) for i, a in enumerate(KENDALL) for b in KENDALL[i + 1 :]]
_CELLS = ", ".join(f"c_{a}_{b} AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM lineitem GROUP BY 1, 2)" for a, b in _KPAIRS)


@query("corr_matrix_kendall", f"WITH {_CELLS} SELECT * FROM ({matrix_sql(union([kendall_sql(a, b) for a, b in _KPAIRS]), KENDALL)})")
def _kendall(spark, sf):
    return rounded(matrix_kendall(table(spark, sf, "lineitem"), list(KENDALL)))


TOP = ("l_quantity", "l_extendedprice", "price_line", "l_discount", "l_tax")


@query(
    "top_correlations",
    f"SELECT * FROM ({pair_sql(LINE_PAIR.sql, TOP, f'{r(chr(114))} AS r', 'true')}) ORDER BY r DESC, col1, col2 LIMIT 5",
)
def _top(spark, sf):
    return rounded(top_pairs(LINE_PAIR.df(spark, sf), list(TOP)))


@query(
    "chart_bar",
    f"""SELECT priority_n AS value, count(*) AS "count", (SELECT count(DISTINCT priority_n) FROM {ORDERS_N.sql}) AS unique_count,
    (SELECT count(*) FROM {ORDERS_N.sql} WHERE priority_n IS NULL) AS missing FROM {ORDERS_N.sql} WHERE priority_n IS NOT NULL
    GROUP BY priority_n ORDER BY "count" DESC, value LIMIT 3""",
)
def _bar(spark, sf):
    return V.bar(ORDERS_N.df(spark, sf), "priority_n", 3)


@query(
    "chart_pie",
    f"""SELECT CASE WHEN rk <= 10 THEN v ELSE 'Other' END AS value, sum(n)::BIGINT AS "count", {r('sum(n) / CAST(max(total) AS DOUBLE)')} AS share FROM (
    SELECT p_brand AS v, count(*) AS n, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rk FROM part GROUP BY p_brand)
    GROUP BY 1""",
)
def _pie(spark, sf):
    return rounded(V.pie(table(spark, sf, "part"), "p_brand", 10))


@query(
    "chart_line",
    f"""SELECT {r('min(epoch_us(ts)) / 1e6')} AS x_min, {r('max(epoch_us(ts)) / 1e6')} AS x_max, {r('min(value)')} AS y_min, {r('max(value)')} AS y_max,
    {r('avg(value)')} AS y_mean, CASE WHEN corr(epoch_us(ts) / 1e6, value) > 0 THEN 'increasing' WHEN corr(epoch_us(ts) / 1e6, value) < 0 THEN 'decreasing' ELSE 'flat' END AS trend
    FROM events""",
)
def _line(spark, sf):
    return rounded(V.line_stats(table(spark, sf, "events"), "ts", "value"))


@query(
    "chart_line_series",
    f"""SELECT event_type AS "group", strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS bucket, {r('avg(value)')} AS y_mean, count(*) AS n
    FROM events GROUP BY 1, 2""",
)
def _series(spark, sf):
    return rounded(V.line_series(table(spark, sf, "events"), "ts", "value", "day", "event_type"))


_AT = "CAST(least(floor((o_custkey - lo) / ((hi - lo) / 100.0)), 99) AS INTEGER)"


@query(
    "chart_line_numeric",
    f"""
    WITH e AS (SELECT CAST(min(o_custkey) AS DOUBLE) AS lo, CAST(max(o_custkey) AS DOUBLE) AS hi FROM orders),
    p AS (SELECT o_orderstatus AS "group", {_AT} AS "column", CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders, e),
    c AS (SELECT "group", "column", count(*) AS n, min({{'x': x, 'y': y}}) AS a, max({{'x': x, 'y': y}}) AS b, min({{'y': y, 'x': x}}) AS l, max({{'y': y, 'x': x}}) AS h FROM p GROUP BY 1, 2)
    SELECT "group", "column", n, a.x AS x_first, a.y AS y_first, b.x AS x_last, b.y AS y_last, l.x AS x_low, l.y AS y_low, h.x AS x_high, h.y AS y_high FROM c
    """,
)
def _line_numeric(spark, sf):
    return V.line_points(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderstatus", 100)


PAIR = ("o_totalprice", "o_custkey")


@query("chart_pair", matrix_sql(plain_pairs("orders", PAIR, "corr({a}, {b})"), PAIR))
def _pair(spark, sf):
    return rounded(V.pair_plot(table(spark, sf, "orders"), list(PAIR), "o_orderkey", "o_orderstatus")[0])


@query(
    "chart_pair_points",
    "SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus FROM orders ORDER BY md5(concat('42|', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 1000",
)
def _pair_points(spark, sf):
    return V.pair_plot(table(spark, sf, "orders"), list(PAIR), "o_orderkey", "o_orderstatus")[1]


@query("chart_count", "SELECT l_returnflag AS value, l_linestatus AS hue, count(*) AS \"count\" FROM lineitem GROUP BY 1, 2")
def _count(spark, sf):
    return V.count_chart(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


def _violin_sql(group: str) -> str:
    return f"""SELECT {group} AS "group", {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('skewness(value)')} AS skew,
    {r('kurtosis(value)')} AS kurtosis, {r('quantile_cont(value, 0.5)')} AS median FROM events GROUP BY 1"""


@query("chart_violin", union([_violin_sql("'all'"), _violin_sql("event_type")]))
def _violin(spark, sf):
    return rounded(V.violin(table(spark, sf, "events"), "value", "event_type"))


def _density_sql(c: str, digits: int) -> str:
    return f"""
    WITH v AS (SELECT {c} AS v, count(*) AS w FROM lineitem GROUP BY 1),
    s AS (SELECT count(*) AS n, min({c}) AS lo, max({c}) AS hi, stddev_samp({c}) AS sd FROM lineitem),
    h AS (SELECT *, sd * pow(n, -0.2) AS h FROM s),
    g AS (SELECT unnest(range(0, 1000)) AS point),
    d AS (SELECT point, any_value(lo + point * ((hi - lo) / 999)) AS x,
      sum(w * exp(-0.5 * pow((lo + point * ((hi - lo) / 999) - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())) AS density FROM g, h, v GROUP BY point),
    b AS (SELECT max(n) AS peak FROM (SELECT count(*) AS n FROM lineitem, s GROUP BY least(floor(({c} - lo) / ((hi - lo) / 20)), 19)))
    SELECT CAST(point AS INTEGER) AS point, {r('x')} AS x, {r('density', digits)} AS density, {r('density * peak / (SELECT max(density) FROM d)', 3)} AS scaled FROM d, b
    """


def _density_of(c: str, digits: int):
    def run(spark, sf):
        out = V.density(table(spark, sf, "lineitem"), c)
        return out.select("point", F.round("x", 6).alias("x"), F.round("density", digits).alias("density"), F.round("scaled", 3).alias("scaled"))

    return run


query("density_curve", _density_sql("l_quantity", 8))(_density_of("l_quantity", 8))
# densities of prices are about 1e-5: eight of their digits
query("density_curve_continuous", _density_sql("l_extendedprice", 13))(_density_of("l_extendedprice", 13))


@query(
    "group_compare",
    f"""SELECT l_returnflag AS "group", {r('avg(l_extendedprice)', 4)} AS mean, {r('sum(l_extendedprice)', 2)} AS sum, count(l_extendedprice) AS "count"
    FROM lineitem GROUP BY 1""",
)
def _group(spark, sf):
    out = V.group_compare(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.withColumns({"mean": F.round("mean", 4), "sum": F.round("sum", 2)})


@query(
    "insight_facts",
    f"""SELECT {r('m')} AS mean, {r('md')} AS median, CASE WHEN m > md THEN 'right' WHEN m < md THEN 'left' ELSE 'none' END AS skew_direction
    FROM (SELECT avg(value) AS m, quantile_cont(value, 0.5) AS md FROM events)""",
)
def _facts(spark, sf):
    return rounded(V.insight_facts(table(spark, sf, "events"), "value"))


_CHART_NUM = ("event_id", "user_id", "value")


def _recommend_sql() -> str:
    """The rules as SQL over the events table (three numeric, two text, one time column)."""
    skew = union([f"SELECT '{c}' AS c, {i} AS pos, skewness({c}) AS sk FROM events" for i, c in enumerate(_CHART_NUM)])
    unique = union([f"SELECT '{c}' AS c, {i} AS pos, count(DISTINCT {c}) AS k FROM events" for i, c in enumerate(("event_type", "props"))])
    out = union(
        [
            f"""SELECT c, {i} AS pos, count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) * 100.0 / count(*) AS p FROM
            (SELECT '{c}' AS c, {c} AS x FROM events), (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM events) GROUP BY c"""
            for i, c in enumerate(_CHART_NUM)
        ]
    )
    pairs = [(a, b) for i, a in enumerate(_CHART_NUM) for b in _CHART_NUM[i + 1 :]]
    corr = union([f"SELECT '{a},{b}' AS c, {i} AS pos, abs(corr({a}, {b})) AS r FROM events" for i, (a, b) in enumerate(pairs)])
    first = "(SELECT c FROM u WHERE k BETWEEN {lo} AND {hi} ORDER BY pos LIMIT 1)"
    none = "coalesce({x}, '')"
    up_to = lambda hi: none.format(x=first.format(lo=0, hi=hi))
    grouping = first.format(lo=2, hi=6)
    return f"""
    WITH s AS ({skew}), u AS ({unique}), o AS ({out}), k AS ({corr}),
    found AS (
      SELECT 3 AS pri, 1 AS rule, pos, 'histogram' AS chart, c AS columns, CASE WHEN sk > 2 THEN 'log' ELSE 'linear' END AS setting FROM s WHERE abs(sk) > 1
      UNION ALL SELECT 2, 2, pos, 'box', c, {up_to(8)} FROM o WHERE p > 0.5
      UNION ALL SELECT * FROM (SELECT 1, 3, pos, 'scatter', c, {up_to(6)} FROM k WHERE r > 0.9 ORDER BY pos LIMIT 3)
      UNION ALL SELECT 4, 4, pos, 'bar', c, 'top=' || CAST(least(k, 12) AS VARCHAR) FROM u WHERE k <= 15
      UNION ALL SELECT 3, 5, pos, 'histogram', c, 'linear' FROM s WHERE NOT abs(sk) > 1
      UNION ALL SELECT 5, 7, 0, 'line', 'ts,event_id', ''
      UNION ALL SELECT 4, 8, n, 'group_bar', {grouping} || ',' || c, 'top=' || CAST((SELECT k FROM u WHERE c = {grouping}) AS VARCHAR)
        FROM (SELECT 0 AS n, 'event_id' AS c UNION ALL SELECT 1, 'user_id') WHERE {grouping} IS NOT NULL
      UNION ALL SELECT 4, 9, pos, 'pie', c, '' FROM u WHERE k BETWEEN 2 AND 6
      UNION ALL SELECT 5, 10, 0, 'pair', 'event_id,user_id,value', {up_to(5)}
    ), ranked AS (SELECT *, row_number() OVER (ORDER BY pri, rule, pos) AS rk FROM found)
    SELECT CAST(rk AS INTEGER) AS rank, chart, columns, setting FROM ranked WHERE rk <= 8
    """


@query("recommend_charts", _recommend_sql())
def _recommend(spark, sf):
    return V.recommend_charts(table(spark, sf, "events"))
