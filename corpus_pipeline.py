"""Documents to packed training sequences: language, exact and near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next one. All but the
last return documents with all their columns. Decisions find their rows by identifier and hash of the text, so rows that
share an identifier but not the text are decided each on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablesmith.llm.common import keep_rows
from tablesmith.llm.exact_dedup import exact_dedup
from tablesmith.llm.language import identify
from tablesmith.llm.mixing import mix
from tablesmith.llm.near_dedup import near_dedup
from tablesmith.llm.packing import pack
from tablesmith.session import new_path
from tablesmith.sources.readers import scan_named


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return keep_rows(docs, identify(docs).where("NOT rejected"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays."""
    return keep_rows(docs, exact_dedup(docs).where("kept"), once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return keep_rows(docs, near_dedup(docs).where("kept"))


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of sources, languages and topics."""
    return keep_rows(docs, mix(docs).where("kept"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens."""
    return pack(docs)


STAGES = [
    ("language", known_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", sample_mix),
    ("packing", pack_windows),
]

ORACLE_SQL = None  # a trained model decides, which SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan_named(spark, "documents", sf_dir)
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
