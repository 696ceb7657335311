"""Exact duplicates by a tree merge of sorted digest runs (DataFrame functions only).

Every input partition is a run: its digests, sorted, each with the smallest identifier and a count. Runs are merged in binomial
rounds. In round r a run exchanges with the runs whose number differs in the r-th group of ``fan_in_bits`` bits: each digest moves
to the run that has, at those bits, the leading bits of the digest, and up to ``2 ** fan_in_bits`` sorted runs are merged into one
there (a sort-based aggregate, once before and once after the shuffle). After the last round every digest is at the run named by its
own leading bits, so the runs are disjoint digest ranges and no run ever holds the whole. The winners then travel down the same tree.
A group of copies of any size arrives as at most ``2 ** fan_in_bits`` rows per merge, in either direction.

Merges are verified: rows merge only when SHA-256, byte length and an independent 64-bit hash of the text all agree.

Null text counts as empty. A null identifier ranks after all others. Of rows that repeat identifier and text, the first read stays.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import only, text_hash

FAN_IN_BITS = 4
KEY = ["digest", "n_bytes", "proof"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def leaf_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document with its digest and run, fixed in the shared folder."""
    norm = only(docs, doc_id=id_col, text=text_col).select("doc_id", text_hash(F.col("text")).alias("raw"), normalised(F.col("text")).alias("norm"))
    return cut_lineage(
        norm.select(
            "doc_id",
            "raw",
            F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
            F.octet_length("norm").cast("long").alias("n_bytes"),
            F.xxhash64("norm").alias("proof"),
            F.spark_partition_id().cast("long").alias("run"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )


def _leading(bits: int) -> Column:
    """The first bits of the digest as a number."""
    return F.shiftright(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), 56 - bits)


def _moved(at: Column, level: int, fan_in_bits: int, bits: int) -> Column:
    """Where a digest of run ``at`` goes in the given round."""
    mask = ((1 << fan_in_bits) - 1) << (level * fan_in_bits)
    return at.bitwiseAND(F.lit(~mask)).bitwiseOR(_leading(bits).bitwiseAND(F.lit(mask)))


def _merge(rows: DataFrame) -> DataFrame:
    # the smallest struct is a sort-based aggregate: sorted runs in, one sorted run out
    return rows.groupBy("run", *KEY).agg(F.min("head").alias("head"), F.sum("n").alias("n"))


def tree_merge(leaves: DataFrame, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """Per row of ``leaf_rows``: the head of its group (``null_id``, ``doc_id``, ``uid``) and the group's size."""
    runs = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    rounds = math.ceil(math.log2(runs) / fan_in_bits) if runs > 1 else 0
    bits = rounds * fan_in_bits
    head = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "uid")
    levels = [cut_lineage(_merge(leaves.select("run", *KEY, head.alias("head"), F.lit(1).cast("long").alias("n"))))]
    for level in range(rounds):
        moved = levels[-1].withColumn("run", _moved(F.col("run"), level, fan_in_bits, bits))
        levels.append(cut_lineage(_merge(moved)))
    won = levels[-1]
    for level in reversed(range(rounds)):
        below = levels[level].select("run", *KEY, _moved(F.col("run"), level, fan_in_bits, bits).alias("up"))
        won = below.join(won.withColumnRenamed("run", "up"), ["up", *KEY]).drop("up")
    return leaves.join(won, ["run", *KEY])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 and raw (hash of the text as it was)."""
    return tree_merge(leaf_rows(docs, id_col, text_col), fan_in_bits).select(
        "doc_id",
        F.col("head.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("head.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "raw",
    )
