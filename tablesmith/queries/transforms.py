"""Transforms, types, cardinality, binning, scaling, interactions, correlation steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.binning import bin_ranges
from ..operators.correlate import pairs_over, vif_table
from ..operators.transform import LAMBDA_ROUNDS, LAMBDA_START, LAMBDA_STEP
from ..plans.step import Step, apply_step, fit_step
from .cleaning import log_sql
from .common import LINE_PAIR, PART_MIXED, Input, query, r, rounded, table
from .issueset import NUMBER_SQL, PAIR_COLUMNS, pair_sql

CUSTOMER = "(SELECT * FROM customer)"


def _customer(step: Step):
    def run(spark, sf):
        return rounded(apply_step(table(spark, sf, "customer"), step).select("c_custkey", "c_acctbal"))

    return run


def _simple(key: str, method: str, sql: str):
    query(key, f"SELECT c_custkey, {r(sql)} AS c_acctbal FROM customer")(_customer(Step("transform", ["c_acctbal"], method)))


query("transform_log", log_sql(CUSTOMER, "c_custkey", "c_acctbal"))(_customer(Step("transform", ["c_acctbal"], "log")))
_simple("transform_sqrt", "sqrt", "sqrt(c_acctbal + (SELECT CASE WHEN min(c_acctbal) < 0 THEN abs(min(c_acctbal)) ELSE 0 END FROM customer))")
_simple("transform_reciprocal", "reciprocal", "1.0 / nullif(c_acctbal, 0)")
_simple("transform_square", "square", "c_acctbal * c_acctbal")


# x^3 reaches 1e12: six digits there are beyond double precision
@query("transform_cube", f"SELECT c_custkey, {r('c_acctbal * c_acctbal * c_acctbal', 1)} AS c_acctbal FROM customer")
def _cube(spark, sf):
    return rounded(apply_step(table(spark, sf, "customer"), Step("transform", ["c_acctbal"], "cube")).select("c_custkey", "c_acctbal"), 1)


def lambda_sql(src: str, c: str, form: str, jacobian: str) -> str:
    """The same grid search in SQL: one step per round, the best exponent of each feeds the next."""
    half = round(LAMBDA_START / LAMBDA_STEP)
    parts = ["l0 AS (SELECT CAST(0 AS DOUBLE) AS lam)"]
    step = LAMBDA_STEP
    for i in range(1, LAMBDA_ROUNDS + 1):
        parts.append(
            f"g{i} AS (SELECT round((SELECT lam FROM l{i - 1}) + j * {step}, 6) AS lam FROM (SELECT unnest(range(-{half}, {half + 1})) AS j)), "
            f"s{i} AS (SELECT lam, (lam - 1) * sum({jacobian}) - count(*) / 2.0 * ln(var_pop({form})) AS score FROM g{i}, (SELECT {c} AS x FROM {src} WHERE {c} IS NOT NULL) GROUP BY lam), "
            f"l{i} AS (SELECT lam FROM s{i} WHERE isfinite(score) ORDER BY score DESC, lam LIMIT 1)"
        )
        step, half = round(step / 10, 9), 10
    return ", ".join(parts)


_BC = "CASE WHEN abs(lam) < 1e-9 THEN ln(x) ELSE (pow(x, lam) - 1) / lam END"
_YJ = """CASE WHEN x >= 0 THEN (CASE WHEN abs(lam) < 1e-9 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END)
    ELSE (CASE WHEN abs(lam - 2) < 1e-9 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END) END"""
_L = f"l{LAMBDA_ROUNDS}"


@query(
    "transform_boxcox",
    f"WITH {lambda_sql('events', 'value', _BC, 'ln(x)')} SELECT event_id, {r(_BC, 4)} AS value FROM (SELECT event_id, value AS x, lam FROM events, {_L})",
)
def _boxcox(spark, sf):
    out = apply_step(table(spark, sf, "events"), Step("transform", ["value"], "box-cox"))
    return rounded(out.select("event_id", "value"), 4)


_SMALL_BAL = Input("customer", ("c_custkey", "c_acctbal / 1000 AS bal"))


@query(
    "transform_yeojohnson",
    f"""WITH {lambda_sql(_SMALL_BAL.sql, 'bal', _YJ, 'sign(x) * ln(1 + abs(x))')}
    SELECT c_custkey, {r(_YJ, 4)} AS bal FROM (SELECT c_custkey, bal AS x, lam FROM {_SMALL_BAL.sql}, {_L})""",
)
def _yeojohnson(spark, sf):
    return rounded(apply_step(_SMALL_BAL.df(spark, sf), Step("transform", ["bal"], "yeo-johnson")), 4)


# ---- types

_NUM = f"CASE WHEN regexp_matches(mixed, '{NUMBER_SQL}') THEN CAST(trim(mixed) AS DOUBLE) END"


@query("to_numeric", f"SELECT p_partkey, {_NUM} AS mixed FROM {PART_MIXED.sql}")
def _to_numeric(spark, sf):
    return apply_step(PART_MIXED.df(spark, sf), Step("convert_type", ["mixed"], "to_numeric")).select("p_partkey", "mixed")


@query("to_categorical", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
def _to_categorical(spark, sf):
    return apply_step(table(spark, sf, "part"), Step("convert_type", ["p_size"], "to_categorical")).select("p_partkey", "p_size")


_DATES = Input("orders", ("o_orderkey", "CASE WHEN o_orderkey % 6 = 0 THEN o_orderpriority ELSE substr(CAST(o_orderdate AS STRING), 1, 19) END AS d"))


@query("to_datetime", f"SELECT o_orderkey, epoch(try_cast(d AS TIMESTAMP))::BIGINT AS seconds FROM {_DATES.sql}")
def _to_datetime(spark, sf):
    out = apply_step(_DATES.df(spark, sf), Step("convert_type", ["d"], "to_datetime"))
    return out.select("o_orderkey", F.unix_seconds("d").alias("seconds"))


_FLAGS = Input("orders", ("o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN 'Yes' WHEN o_orderkey % 4 = 1 THEN 'false' WHEN o_orderkey % 4 = 2 THEN '1' ELSE o_orderstatus END AS flag"))


@query(
    "to_boolean",
    f"""SELECT o_orderkey, CASE WHEN lower(flag) IN ('true', 't', 'yes', 'y', '1', '1.0') THEN true
    WHEN lower(flag) IN ('false', 'f', 'no', 'n', '0', '0.0') THEN false END AS flag FROM {_FLAGS.sql}""",
)
def _to_boolean(spark, sf):
    return apply_step(_FLAGS.df(spark, sf), Step("convert_type", ["flag"], "to_boolean"))


# ---- cardinality


@query(
    "group_rare",
    """WITH c AS (SELECT role AS v, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM conversations GROUP BY role)
    SELECT conv_id, turn, CASE WHEN share < 0.05 THEN 'Other' ELSE role END AS role FROM conversations JOIN c ON role = v""",
)
def _group_rare(spark, sf):
    out = apply_step(table(spark, sf, "conversations"), Step("reduce_cardinality", ["role"], "group_rare", {"threshold": 0.05}))
    return out.select("conv_id", "turn", "role")


def _cluster(method):
    def run(spark, sf):
        step = Step("reduce_cardinality", ["p_brand"], method, {"target_column": "p_retailprice", "n_clusters": 4})
        out = apply_step(table(spark, sf, "part"), step)
        return out.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))

    return run


query("cardinality_kmeans")(_cluster("kmeans_clustering"))
query("cardinality_hierarchical")(_cluster("hierarchical_clustering"))

# ---- binning


def _bins(step: Step):
    def run(spark, sf):
        out = apply_step(table(spark, sf, "orders"), step)
        return out.select("o_orderkey", "o_totalprice_binned", "o_totalprice_bin_index")

    return run


def _bin_out(index: str, src: str) -> str:
    return f"""SELECT o_orderkey, CASE WHEN i IS NOT NULL THEN 'Bin ' || CAST(i AS VARCHAR) END AS o_totalprice_binned,
    CAST(i AS INTEGER) AS o_totalprice_bin_index FROM (SELECT o_orderkey, {index} AS i FROM {src})"""


_WIDTH = "(SELECT *, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi FROM orders)"
query("bin_equal_width", _bin_out("least(greatest(ceil((o_totalprice - lo) / ((hi - lo) / 5)), 1), 5)::INTEGER", _WIDTH))(
    _bins(Step("binning", ["o_totalprice"], "equal_width", {"n_bins": 5}))
)
_FREQ = "(SELECT * FROM orders, (SELECT quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM orders))"
query(
    "bin_equal_freq",
    _bin_out("CASE WHEN o_totalprice <= e[2] THEN 1 WHEN o_totalprice <= e[3] THEN 2 WHEN o_totalprice <= e[4] THEN 3 WHEN o_totalprice <= e[5] THEN 4 ELSE 5 END", _FREQ),
)(_bins(Step("binning", ["o_totalprice"], "equal_frequency", {"n_bins": 5})))
query("bin_kmeans")(_bins(Step("binning", ["o_totalprice"], "kmeans", {"n_bins": 5})))
query(
    "bin_custom",
    _bin_out(
        "CASE WHEN o_totalprice < 10000 THEN NULL WHEN o_totalprice <= 50000 THEN 1 WHEN o_totalprice <= 200000 THEN 2 WHEN o_totalprice <= 400000 THEN 3 END",
        "orders",
    ),
)(_bins(Step("binning", ["o_totalprice"], "custom", {"bin_edges": [10000, 50000, 200000, 400000]})))


@query(
    "bin_ranges",
    f"""WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    b AS (SELECT unnest(range(1, 6)) AS bin), c AS (SELECT o_totalprice_bin_index AS i, count(*) AS n FROM ({_bin_out("least(greatest(ceil((o_totalprice - lo) / ((hi - lo) / 5)), 1), 5)::INTEGER", _WIDTH)}) GROUP BY 1)
    SELECT CAST(bin AS INTEGER) AS bin, {r('m.lo + (hi - m.lo) * (bin - 1) / 5')} AS lo, {r('m.lo + (hi - m.lo) * bin / 5')} AS hi, coalesce(n, 0) AS n
    FROM b CROSS JOIN m LEFT JOIN c ON bin = i""",
)
def _bin_ranges(spark, sf):
    df, step = table(spark, sf, "orders"), Step("binning", ["o_totalprice"], "equal_width", {"n_bins": 5})
    fitted = fit_step(df, step)
    return rounded(bin_ranges(df, step, fitted, apply_step(df, step, fitted)))


# ---- scaling

PRICE = ("o_totalprice", "o_custkey")


def _scaled(method: str):
    def run(spark, sf):
        out = apply_step(table(spark, sf, "orders").select("o_orderkey", *PRICE), Step("scale", PRICE, method))
        return rounded(out)

    return run


def _scale_sql(expr: str, stats: str) -> str:
    cols = ", ".join(f"{r(expr.format(c=c))} AS {c}" for c in PRICE)
    aggs = ", ".join(stats.format(c=c) for c in PRICE)
    return f"SELECT o_orderkey, {cols} FROM orders, (SELECT {aggs} FROM orders)"


query("scale_standard", _scale_sql("({c} - m_{c}) / s_{c}", "avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}"))(_scaled("standard"))
query("scale_minmax", _scale_sql("({c} - m_{c}) / CAST(x_{c} - m_{c} AS DOUBLE)", "min({c}) AS m_{c}, max({c}) AS x_{c}"))(_scaled("minmax"))
_Q3 = ", ".join(f"quantile_cont(CAST({{c}} AS DOUBLE), {p}) AS {n}_{{c}}" for n, p in (("a", 0.25), ("m", 0.5), ("b", 0.75)))
query("scale_robust", _scale_sql("({c} - m_{c}) / (b_{c} - a_{c})", _Q3))(_scaled("robust"))
query("scale_maxabs", _scale_sql("{c} / CAST(x_{c} AS DOUBLE)", "max(abs({c})) AS x_{c}"))(_scaled("maxabs"))
query(
    "scale_quantile",
    "SELECT o_orderkey, "
    + ", ".join(
        r(f"(rank() OVER (ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / (count(*) OVER () - 1)") + f" AS {c}" for c in PRICE
    )
    + " FROM orders",
)(_scaled("quantile"))


@query(
    "scale_power",
    f"""WITH {lambda_sql(_SMALL_BAL.sql, 'bal', _YJ, 'sign(x) * ln(1 + abs(x))')},
    y AS (SELECT c_custkey, {_YJ} AS y FROM (SELECT c_custkey, bal AS x, lam FROM {_SMALL_BAL.sql}, {_L}))
    SELECT c_custkey, {r('(y - (SELECT avg(y) FROM y)) / (SELECT stddev_pop(y) FROM y)', 4)} AS bal FROM y""",
)
def _scale_power(spark, sf):
    return rounded(apply_step(_SMALL_BAL.df(spark, sf), Step("scale", ["bal"], "power")), 4)


# ---- interactions

CUST_LINE = ("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def _pair(key, method, short, expr):
    name = f"l_quantity_{short}_l_discount"

    @query(key, f"SELECT l_orderkey, l_linenumber, {r(expr)} AS {name} FROM lineitem")
    def run(spark, sf):
        df = table(spark, sf, "lineitem").select(*CUST_LINE)
        out = apply_step(df, Step("feature_interaction", ["l_quantity", "l_discount"], method))
        return rounded(out.select("l_orderkey", "l_linenumber", name))


_pair("interact_mul", "multiplication", "mul", "l_quantity * l_discount")
_pair("interact_add", "addition", "add", "l_quantity + l_discount")
_pair("interact_sub", "subtraction", "sub", "l_quantity - l_discount")
_pair("interact_div", "division", "div", "l_quantity / nullif(l_discount, 0)")


@query(
    "interact_polynomial",
    f"""SELECT l_orderkey, l_linenumber, {r('l_quantity * l_quantity')} AS l_quantity_x_l_quantity, {r('l_quantity * l_discount')} AS l_quantity_x_l_discount,
    {r('l_discount * l_discount')} AS l_discount_x_l_discount FROM lineitem""",
)
def _poly(spark, sf):
    df = table(spark, sf, "lineitem").select(*CUST_LINE)
    out = apply_step(df, Step("feature_interaction", ["l_quantity", "l_discount"], "polynomial"))
    return rounded(out.drop("l_quantity", "l_discount"))


# ---- correlation steps


@query(
    "corr_drop_one",
    f"""SELECT {r('l_quantity')} AS l_quantity, {r('l_extendedprice')} AS l_extendedprice, {r('l_discount')} AS l_discount,
    {r('l_tax')} AS l_tax, one FROM {LINE_PAIR.sql}""",
)
def _drop_one(spark, sf):
    df = LINE_PAIR.df(spark, sf)
    pairs = pairs_over(df, list(PAIR_COLUMNS), 0.9).orderBy("col1", "col2").collect()
    for p in pairs:
        if p["col1"] in df.columns and p["col2"] in df.columns:
            df = apply_step(df, Step("handle_correlation", [p["col1"], p["col2"]], "drop_one"))
    return rounded(df)


@query("corr_pairs_threshold", pair_sql(LINE_PAIR.sql, PAIR_COLUMNS, f"{r('abs(r)')} AS correlation", "abs(r) >= 0.01"))
def _pairs(spark, sf):
    return rounded(pairs_over(LINE_PAIR.df(spark, sf), list(PAIR_COLUMNS), 0.01, strict=False))


# first component of a 2 x 2 covariance in closed form
@query(
    "corr_pca",
    f"""
    WITH s AS (SELECT avg(l_quantity) AS ma, avg(l_discount * 100) AS mb, var_samp(l_quantity) AS aa, var_samp(l_discount * 100) AS bb,
      covar_samp(l_quantity, l_discount * 100) AS ab FROM lineitem),
    l AS (SELECT *, (aa + bb) / 2 + sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS top FROM s),
    v AS (SELECT *, ab AS x, top - aa AS y FROM l),
    w AS (SELECT *, (CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END) / sqrt(x * x + y * y) AS k FROM v)
    SELECT l_orderkey, {r('(l_quantity - ma) * x * k + (l_discount * 100 - mb) * y * k', 4)} AS l_quantity_cents_pca FROM lineitem, w
    """,
)
def _corr_pca(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_quantity", "l_discount * 100 AS cents")
    return rounded(apply_step(df, Step("handle_correlation", ["l_quantity", "cents"], "pca")), 4)


@query("corr_vif")
def _vif(spark, sf):
    return rounded(vif_table(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
