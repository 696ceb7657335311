"""Readers: by format, by file ending, by dataset name, and bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import hash_key
from ..functions.schema import col, nan_to_null

# Fixed value: the tables of the local catalog.
NAMED_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def scan_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header. Give a schema for large inputs: inference reads the files once more."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def scan_json(spark: SparkSession, path: str, schema=None, lines: bool = True) -> DataFrame:
    """JSON records: one per line, or (``lines=False``) an array per file, which cannot be split."""
    reader = spark.read.option("multiLine", not lines)
    return nan_to_null((reader.schema(schema) if schema else reader).json(path))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def scan(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Reader by file ending; unsupported endings are an error."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ending == "csv":
        return scan_csv(spark, path, schema)
    if ending in ("json", "jsonl"):
        return scan_json(spark, path, schema)
    if ending == "parquet":
        return scan_parquet(spark, path)
    raise ValueError(f"unsupported file format: '{path}'")


def scan_named(spark: SparkSession, name: str, root: str) -> DataFrame:
    """A table of the catalog under ``root``; unknown names are an error."""
    if name not in NAMED_TABLES:
        raise ValueError(f"unknown dataset '{name}'; known: {', '.join(NAMED_TABLES)}")
    return scan_parquet(spark, f"{root}/{name}.parquet")


def sample_n(df: DataFrame, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """At most n rows, chosen by seeded hash of the key: top-n per task, then one merge of n rows."""
    return df.withColumn("_h", hash_key(col(key), seed)).orderBy("_h", col(key)).limit(n).drop("_h")
