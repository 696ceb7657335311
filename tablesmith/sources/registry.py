"""Registry of dataset profiles, and similarity look-ups in a vector table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows of a block: bounds the memory of a task, not the tables
STORE_ROWS, QUERY_ROWS = 50_000, 1_000


def upsert(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Registry with the entries added; per name the latest time stamp wins (the new entry on a tie)."""
    both = registry.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
    spec = Window.partitionBy("name").orderBy(F.desc("ts"), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(spec)).filter("_rn = 1").drop("_rn", "_new")


def vector_topk(store: DataFrame, queries: DataFrame, key: str, vector: str, n: int = 3) -> DataFrame:
    """``(query_id, rank, item, similarity)``: the n most cosine-similar stored items per query.

    ``queries`` is ``(query_id, query_vector)``, of any size. Store and queries are cut into blocks of bounded rows; a task scores
    one block of each as a matrix product and emits n rows per query, never the pairs. Vectors that are null, hold nulls or have
    another length than the query's are not comparable and take no part; a zero vector has no similarity and comes last.
    """
    items = store.select(F.col(key).alias("item"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL)")
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v")).where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL)")
    n_items, n_asked = -(-items.count() // STORE_ROWS) or 1, -(-asked.count() // QUERY_ROWS) or 1
    left = items.withColumn("i", F.pmod(F.xxhash64("item", "v"), F.lit(n_items))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    right = asked.withColumn("j", F.pmod(F.xxhash64("query_id", "v"), F.lit(n_asked)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_items - 1).cast("long"))))
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, similarity double"

    def nearest(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes, wanted = block["v"].str.len(), asked["v"].str.len()
        for size in set(sizes) & set(wanted):
            own, ask = block[sizes == size], asked[wanted == size]
            if not size:
                continue
            x, q = np.stack(own["v"].to_numpy()), np.stack(ask["v"].to_numpy())
            with np.errstate(all="ignore"):
                s = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))
            s[~np.isfinite(s)] = np.nan
            rank = np.where(np.isnan(s), -np.inf, s)
            items = own["item"].to_numpy()
            by_item = np.argsort(items, kind="stable")
            for query_id, row, r in zip(ask["query_id"], s, rank):
                top = by_item[np.argsort(-r[by_item], kind="stable")[:n]]
                out += [(query_id, items[t], None if np.isnan(row[t]) else float(row[t])) for t in top]
        return pd.DataFrame(out, columns=["query_id", "item", "similarity"])

    scored = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(nearest, kinds)
    spec = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "item")
    return scored.withColumn("rank", F.row_number().over(spec)).filter(F.col("rank") <= n).select("query_id", "rank", "item", "similarity")
