"""Category encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.step import Step, apply_step
from .common import ORDERS_N, query, r, rounded, table

CODES = f"""SELECT v, row_number() OVER (ORDER BY first) - 1 AS code FROM (
    SELECT coalesce(priority_n, 'nan') AS v, min(o_orderkey) AS first FROM {ORDERS_N.sql} GROUP BY 1)"""


@query("encode_label", f"SELECT o_orderkey, CAST(code AS INTEGER) AS priority_n FROM {ORDERS_N.sql} JOIN ({CODES}) ON coalesce(priority_n, 'nan') = v")
def _label(spark, sf):
    out = apply_step(ORDERS_N.df(spark, sf), Step("encode", ["priority_n"], "label", order_by=["o_orderkey"]))
    return out.select("o_orderkey", "priority_n")


@query("encode_onehot", "SELECT o_orderkey, coalesce(o_orderstatus = 'F', false) AS \"o_orderstatus_F\", coalesce(o_orderstatus = 'O', false) AS \"o_orderstatus_O\", coalesce(o_orderstatus = 'P', false) AS \"o_orderstatus_P\" FROM orders")
def _onehot(spark, sf):
    return apply_step(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), Step("encode", ["o_orderstatus"], "onehot"))


@query(
    "encode_onehot_sparse",
    """SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name_index,
    concat('(', (SELECT count(DISTINCT c_name) FROM customer), ',[', dense_rank() OVER (ORDER BY c_name) - 1, '],[1.0])') AS vector FROM customer""",
)
def _onehot_sparse(spark, sf):
    out = apply_step(table(spark, sf, "customer"), Step("encode", ["c_name"], "onehot_sparse"))
    return out.select("c_custkey", "c_name_index", F.col("c_name_onehot").cast("string").alias("vector"))


@query(
    "encode_target",
    f"""WITH o AS {ORDERS_N.sql}, m AS (SELECT priority_n AS v, avg(o_totalprice) AS m FROM o WHERE priority_n IS NOT NULL GROUP BY priority_n)
    SELECT o_orderkey, {r('coalesce(m, (SELECT avg(o_totalprice) FROM o))')} AS priority_n_target_encoded FROM o LEFT JOIN m ON priority_n = v""",
)
def _target(spark, sf):
    out = apply_step(ORDERS_N.df(spark, sf), Step("encode", ["priority_n"], "target", {"target_column": "o_totalprice", "drop_original": True}))
    return rounded(out.select("o_orderkey", "priority_n_target_encoded"))


_COUNT = f"(SELECT priority_n AS v, count(*) AS n FROM {ORDERS_N.sql} WHERE priority_n IS NOT NULL GROUP BY priority_n)"


@query(
    "encode_frequency",
    f"""SELECT o_orderkey, {r(f'n / CAST((SELECT count(priority_n) FROM {ORDERS_N.sql}) AS DOUBLE)')} AS priority_n_freq_encoded
    FROM {ORDERS_N.sql} LEFT JOIN {_COUNT} ON priority_n = v""",
)
def _frequency(spark, sf):
    out = apply_step(ORDERS_N.df(spark, sf), Step("encode", ["priority_n"], "frequency"))
    return rounded(out.select("o_orderkey", "priority_n_freq_encoded"))


@query(
    "encode_binary",
    f"""SELECT p_partkey, {', '.join(f'CAST((code >> {4 - i}) & 1 AS INTEGER) AS p_brand_bin_{i}' for i in range(5))} FROM part JOIN (
    SELECT v, row_number() OVER (ORDER BY first) AS code FROM (SELECT p_brand AS v, min(p_partkey) AS first FROM part GROUP BY 1)) ON p_brand = v""",
)
def _binary(spark, sf):
    out = apply_step(table(spark, sf, "part"), Step("encode", ["p_brand"], "binary", order_by=["p_partkey"]))
    return out.select("p_partkey", *[c for c in out.columns if c.startswith("p_brand_bin_")])


@query(
    "encode_ordinal",
    """WITH d AS (SELECT DISTINCT o_orderpriority AS v FROM orders), u AS (SELECT v, row_number() OVER (ORDER BY v) + 1 AS code FROM d
      WHERE v NOT IN ('5-LOW', '1-URGENT')), c AS (SELECT * FROM u UNION ALL SELECT '5-LOW', 0 UNION ALL SELECT '1-URGENT', 1)
    SELECT o_orderkey, CAST(code AS INTEGER) AS given, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS alphabetical
    FROM orders JOIN c ON o_orderpriority = v""",
)
def _ordinal(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    given = apply_step(df, Step("encode", ["o_orderpriority"], "ordinal", {"order": ["5-LOW", "1-URGENT"]}))
    given = given.withColumnRenamed("o_orderpriority_ordinal", "given")
    both = apply_step(given, Step("encode", ["o_orderpriority"], "ordinal", {"drop_original": True}))
    return both.withColumnRenamed("o_orderpriority_ordinal", "alphabetical")


@query("encode_count", f"SELECT o_orderkey, n AS priority_n_count_encoded FROM {ORDERS_N.sql} LEFT JOIN {_COUNT} ON priority_n = v")
def _count(spark, sf):
    out = apply_step(ORDERS_N.df(spark, sf), Step("encode", ["priority_n"], "count"))
    return out.select("o_orderkey", "priority_n_count_encoded")


@query(
    "encode_helmert",
    """WITH c AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS k FROM orders)
    SELECT o_orderkey, """
    + ", ".join(
        f"CAST(CASE WHEN k <= {j} THEN -1 WHEN k = {j + 1} THEN {j + 1} ELSE 0 END AS INTEGER) AS o_orderpriority_helmert_{j}" for j in range(4)
    )
    + " FROM c",
)
def _helmert(spark, sf):
    out = apply_step(table(spark, sf, "orders"), Step("encode", ["o_orderpriority"], "helmert"))
    return out.select("o_orderkey", *[c for c in out.columns if "_helmert_" in c])


