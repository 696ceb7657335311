"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SALTS = 64


def salted_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, salts: int = SALTS) -> DataFrame:
    """Left join of a large table to one with a row per key, without one task per hot key.

    ``spread`` gives each row of the left table an integer hash that differs between rows of one key. Every key is cut
    into ``salts`` parts: the parts that occur are looked up once each (at most ``salts`` rows per key), and
    the rows meet their part. Null keys match null keys. The left table is read twice, so it should be cheap to read. Both joins
    are merge joins: rounds of look-ups would otherwise build many broadcast tables on the driver.
    """
    salt = F.pmod(spread, F.lit(salts)).cast("int")
    cut = left.withColumn("_salt", salt)
    parts = cut.select(*keys, "_salt").distinct().alias("p")
    r = right.hint("merge").alias("r")
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    found = parts.join(r, _all(same), "inner").select("p.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])
    l, f = cut.alias("l"), found.hint("merge").alias("f")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*keys, "_salt"]]
    values = [F.col(f"f.{c}") for c in right.columns if c not in keys]
    return l.join(f, _all(same), "left").select(*[F.col(f"l.{c}") for c in left.columns], *values)


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def only(df: DataFrame, **names: str) -> DataFrame:
    """Just the named columns under fixed names, whatever else the table holds."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def keep_rows(docs: DataFrame, kept: DataFrame, once: bool = False) -> DataFrame:
    """Rows of documents whose (doc_id, hash of the text) is in ``kept``, columns as they were.

    ``kept`` has the columns doc_id and raw (``text_hash``). With ``once``, of rows that agree in both one stays.
    """
    d = docs.withColumn("_raw", text_hash(F.col("text"))).alias("d")
    k = kept.select("doc_id", "raw").distinct().alias("k")
    on = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d._raw") == F.col("k.raw"))
    out = d.join(k, on, "left_semi")
    if once:
        out = out.dropDuplicates(["doc_id", "_raw"])
    return out.drop("_raw")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def hash_sample(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The n distinct values of the columns with the smallest hash, all of them if there are fewer.

    The distinct values are estimated first and most rows are dropped by a bound on the hash, so no task meets n rows of every other
    task. Should fewer than n values lie below the bound, it is raised until n do or nothing is dropped. The sample is fixed in the
    shared folder; the table is read twice, as a rule.
    """
    h = F.xxhash64(*columns)
    distinct = df.agg(F.approx_count_distinct(h, 0.02)).first()[0]
    share = (4 * n + 100) / max(distinct, 1)
    while True:
        rows = df.select(*columns) if share >= 1 else df.select(*columns).where(h < -(1 << 63) + int(2.0**64 * share))
        sample = cut_lineage(rows.distinct().orderBy(h, *columns).limit(n))
        if share >= 1 or sample.count() >= n:
            return sample
        share *= 8


def per_worker(key: Hashable, make: Callable[[], object]):
    """A Python worker's own instance of what is costly to make; tasks that follow one another share it."""
    here = sys.modules.setdefault("_tablesmith_worker", types.ModuleType("_tablesmith_worker"))
    kept = here.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]
