"""Session helpers: a local session for tests, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_scratch: str | None = None


def local_session(cores: int | str = "*", app: str = "tablesmith", memory: str = "8g") -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the cluster's checkpoint folder.

    Only a local session, where driver and executors are one process, may fall
    back to a temporary folder of the machine.
    """
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="tablesmith-")
    return _local_scratch


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


SMALL_TABLE_ROWS = 10_000
SMALL_TABLE_CHARS = 8_000_000


def local_table(table: DataFrame) -> DataFrame | None:
    """The table as a local one that is broadcast, if it has at most SMALL_TABLE_ROWS rows and SMALL_TABLE_CHARS characters."""
    try:
        rows = table.limit(SMALL_TABLE_ROWS + 1).collect()
    except PySparkException as e:
        if "maxResultSize" not in str(e):
            raise
        return None
    chars = sum(len(v) for r in rows for v in r if isinstance(v, str))
    if len(rows) > SMALL_TABLE_ROWS or chars > SMALL_TABLE_CHARS:
        return None
    # a local table has no size estimate of its own, hence the hint
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def small_or_cut(table: DataFrame) -> DataFrame:
    """Fixes a small derived table before it is joined to a large one: a local table, or beyond that size a checkpoint in the shared folder."""
    small = local_table(table)
    return cut_lineage(table) if small is None else small
