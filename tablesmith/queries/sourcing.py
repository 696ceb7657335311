"""Sources, sinks and registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.step import Step, Workflow
from ..session import new_path
from ..sources.readers import sample_n, scan, scan_csv, scan_json
from ..sources.registry import upsert, vector_topk
from ..sources.sinks import write_csv, write_metrics
from ..models.metrics import metrics_classification
from .common import EVENTS_N, PREDICTIONS, Input, query, r, rounded, table, union
from .modelling import classification_sql

ORDER_PLAIN = Input("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
_ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


@query("scan_csv", ORDER_PLAIN.sql)
def _scan_csv(spark, sf):
    path = new_path(spark, "orders-csv")
    write_csv(ORDER_PLAIN.df(spark, sf), path)
    return scan_csv(spark, path, _ORDER_SCHEMA)


@query("scan_json", ORDER_PLAIN.sql)
def _scan_json(spark, sf):
    path = new_path(spark, "orders-json")
    ORDER_PLAIN.df(spark, sf).write.json(path)
    return scan_json(spark, path, _ORDER_SCHEMA)


@query("scan_named", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _scan_named(spark, sf):
    return table(spark, sf, "part")


_ENDINGS = ("csv", "json", "jsonl", "parquet")


@query(
    "dispatch_format",
    union([f"SELECT '{e}' AS ending, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer" for e in _ENDINGS]),
)
def _dispatch(spark, sf):
    source, parts = table(spark, sf, "customer"), None
    for ending in _ENDINGS:
        path = new_path(spark, "customer") + f".{ending}"
        if ending == "csv":
            write_csv(source, path)
        else:
            source.write.format("parquet" if ending == "parquet" else "json").save(path)
        part = scan(spark, path, source.schema).select(F.lit(ending).alias("ending"), *source.columns)
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("sample_n", "SELECT event_id, user_id, event_type, value FROM events ORDER BY md5(concat('42|', CAST(event_id AS VARCHAR))), event_id LIMIT 1000")
def _sample(spark, sf):
    return sample_n(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), "event_id")


@query("write_csv", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _write_csv(spark, sf):
    path = new_path(spark, "parts-out")
    source = table(spark, sf, "part")
    write_csv(source, path)
    return scan_csv(spark, path, source.schema)


@query("write_metrics", f"SELECT 'rule' AS model, metric, value FROM ({classification_sql(PREDICTIONS.sql)})")
def _write_metrics(spark, sf):
    path = new_path(spark, "metrics-out")
    metrics = metrics_classification(PREDICTIONS.df(spark, sf)).withColumn("model", F.lit("rule"))
    write_metrics(metrics, path)
    return rounded(scan_csv(spark, path, "model string, metric string, value double"))


@query(
    "registry_upsert",
    """
    WITH entries AS (
      SELECT event_type || '-' || CAST(user_id AS VARCHAR) AS name, value AS amount, event_id AS ts FROM events
    ), latest AS (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC) AS rn FROM entries
    )
    SELECT name, amount, ts FROM latest WHERE rn = 1
    """,
)
def _upsert(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("name"),
        F.col("value").alias("amount"),
        F.col("event_id").alias("ts"),
    )
    half = F.pmod(F.col("ts"), F.lit(2)) == 0
    return upsert(e.filter(half), e.filter(~half))


@query(
    "vector_topk",
    f"""
    WITH parts AS (
      SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings
    ), centre AS (
      SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM parts GROUP BY label, pos
    ), q AS (
      SELECT label AS query_id, list(x ORDER BY pos) AS v FROM centre GROUP BY label
    ), scored AS (
      SELECT query_id, vec_id AS item,
        list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS similarity
      FROM embeddings, q
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item) AS rk FROM scored
    )
    SELECT query_id, CAST(rk AS INTEGER) AS rank, item, {r('similarity')} AS similarity FROM ranked WHERE rk <= 3
    """,
)
def _topk(spark, sf):
    e = table(spark, sf, "embeddings")
    centre = (
        e.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(F.col("label").alias("query_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("query_vector"))
    )
    return rounded(vector_topk(e, centre, "vec_id", "embedding", 3))


AUDITED = [
    Step("impute_missing", ["value_n"], "mean"),
    Step("handle_outliers", ["value"], "winsorize"),
    Step("transform", ["value_n"], "log"),
]


_STEPS = [
    '{"columns": ["value_n"], "key": null, "method": "mean", "order_by": [], "params": {}, "partition_by": [], "reason": "", "step": "impute_missing"}',
    '{"columns": ["value"], "key": null, "method": "winsorize", "order_by": [], "params": {}, "partition_by": [], "reason": "", "step": "handle_outliers"}',
    '{"columns": ["value_n"], "key": null, "method": "log", "order_by": [], "params": {}, "partition_by": [], "reason": "", "step": "transform"}',
]


@query(
    "workflow_json",
    union(
        [
            f"SELECT CAST({i} AS INTEGER) AS step_no, 'events' AS dataset, count(*) AS row_count, CAST(6 AS INTEGER) AS column_count, 'event_id,ts,user_id,event_type,value,value_n' AS columns, '{s}' AS step FROM events"
            for i, s in enumerate(_STEPS, start=1)
        ]
    ),
)
def _workflow_json(spark, sf):
    flow = Workflow.from_json(Workflow(AUDITED).to_json(dataset="events"))
    return flow.describe(EVENTS_N.df(spark, sf), "events")


@query(
    "step_audit",
    f"""
    WITH e AS {EVENTS_N.sql}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM e),
    f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)
    SELECT 1 AS step_no, 'impute_missing' AS step, 'value_n' AS "column", 'mean' AS method, count(*) FILTER (value_n IS NULL) AS affected FROM e
    UNION ALL
    SELECT 2, 'handle_outliers', 'value', 'winsorize', count(*) FROM e, f WHERE value < lo OR value > hi
    UNION ALL
    SELECT 3, 'transform', 'value_n', 'log', count(*) FROM e
    """,
)
def _audit(spark, sf):
    df = EVENTS_N.df(spark, sf)
    return Workflow(AUDITED).fit(df).audit(df).drop("fitted")


