"""Left look-ups in a table with a row per key, where a few keys may hold most rows.

A small table is broadcast whole. Beside a large one its rows for the heaviest keys are kept, found by a frequent-items sketch over the rows it was
fitted on: they are broadcast, at most ``HOT_KEYS`` of them, and only rows with other keys meet the large table by shuffle. Rows
that are answered already and rows without a key take part in no match, so they are dealt evenly instead of to the task of their key. Everything is
one pass over the rows; the sketch is part of the fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, local_table
from .schema import col

#: keys that are broadcast beside a large table, values the sketch tracks (a value of a share above 1 / TRACKED is never missed)
HOT_KEYS, TRACKED = 256, 10_000
#: parts over which rows that need no match are dealt
DEALT = 4_096


def mapping_tables(name: str, table: DataFrame, rows: DataFrame, value: Column, key: str = "v") -> dict[str, DataFrame]:
    """A fitted mapping: ``name``, and ``name_hot`` beside a table too large to be broadcast.

    ``value`` is what the rows will be looked up by.
    """
    small = local_table(table)
    if small is not None:
        return {name: small}
    large = cut_lineage(table)
    values = rows.select(value.alias("v")).where("v IS NOT NULL")
    top = values.agg(F.expr(f"approx_top_k(v, {HOT_KEYS}, {TRACKED})").alias("top"))
    hot = top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("_key"))
    found = large.join(F.broadcast(hot), col(key) == F.col("_key"), "left_semi")
    # at most HOT_KEYS rows; only values of extreme length make them too large to be held here
    held = local_table(found)
    return {name: large} if held is None else {name: large, f"{name}_hot": held}


def look_up(df: DataFrame, tables: dict[str, DataFrame], name: str, column: str, key: str = "v") -> DataFrame:
    """Left join of ``df`` to a fitted mapping by ``column``; its other columns are added."""
    table, hot = tables[name], tables.get(f"{name}_hot")
    if hot is None:
        return df.join(table.withColumnRenamed(key, "_lk"), col(column) == F.col("_lk"), "left").drop("_lk")
    given = [c for c in table.columns if c != key]
    known = hot.select(col(key).alias("_hk"), F.lit(True).alias("_hot"), *[col(c).alias(f"_h_{c}") for c in given])
    out = df.join(F.broadcast(known), col(column) == F.col("_hk"), "left").drop("_hk")
    done = F.col("_hot").isNotNull() | col(column).isNull()
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    out = out.withColumns(
        {"_rk": F.when(~done, col(column)), "_rs": F.when(done, F.pmod(F.xxhash64(*[col(c) for c in plain]), F.lit(DEALT)) + 1).otherwise(0).cast("long")}
    )
    # the second key is 0 for every row of the table, in a form that stays part of the equality and so of the partitioning
    rest = table.select(col(key).alias("_lk"), F.pmod(F.xxhash64(col(key)), F.lit(1)).cast("long").alias("_ls"), *[col(c).alias(f"_t_{c}") for c in given])
    out = out.join(rest, (F.col("_rk") == F.col("_lk")) & (F.col("_rs") == F.col("_ls")), "left")
    values = [F.when(F.col("_hot"), F.col(f"_h_{c}")).otherwise(F.col(f"_t_{c}")).alias(c) for c in given]
    return out.select(*[col(c) for c in df.columns], *values)
