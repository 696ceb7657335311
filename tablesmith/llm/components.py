"""Connected components of links by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SALTS


ROWS_PER_TASK = 50_000


def with_least(df: DataFrame, key: str, value: str, tasks: int, salts: int = SALTS) -> DataFrame:
    """Adds ``m``, the smallest value of each key; a key of any share of the rows is met in ``salts`` parts.

    The rows are few next to the documents, so between shuffles they are held in no more tasks than they need.
    """
    cut = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    parts = cut.groupBy(key, "_salt").agg(F.min(value).alias("_m")).coalesce(tasks)  # at most ``salts`` rows per key
    parts = parts.select(key, "_salt", F.min("_m").over(Window.partitionBy(key)).alias("m")).coalesce(tasks)
    return cut.join(parts.hint("merge"), [key, "_salt"]).drop("_salt").coalesce(tasks)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); the root is the smallest node reachable.

    Each round hangs larger neighbours under the smallest one seen (large star, then small star); the number of rounds grows with
    the logarithm of the component's size. Hubs are met in salted parts, so one node may hold any share of the links.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark, n = None, edges.count()
    for _ in range(max_rounds):
        tasks = 2 * n // ROWS_PER_TASK + 1
        edges = edges.coalesce(tasks)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = with_least(both, "u", "v", tasks).where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct()
        seen = with_least(cut_lineage(large).coalesce(tasks), "hi", "lo", tasks)
        small = seen.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        edges = cut_lineage(small.where("hi <> lo").distinct())
        # a star forest does not change any more: compare count and two sums of hashes
        now = edges.agg(F.count("hi"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
