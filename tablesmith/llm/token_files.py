"""Documents in flat token files without an index: found by a scan for separators.

A flat file is nothing but little-endian ids, documents one after the other, each closed by the end-of-document id. Files are cut
into blocks of equal size whatever their documents; a task reads a block and finds the separators with one vectorised comparison.
Blocks are stitched by prefix scans over one row per block: tokens before the block (a running sum), documents before it (a running sum
of separators) and the place of the last separator before it (a running maximum). Scans run in two levels, within groups of blocks and
over the groups, so a file of any size is no single task. A document over many blocks is the distance between two separators.

Defined cases: an empty file has no document; ids after the last separator are a document of their own (unless there are none); two
separators in a row enclose a document of no tokens. Writing: null and empty texts are documents of no tokens, rows that repeat
an identifier are documents each, null identifiers are kept; other columns are ignored; an empty table gives no file and no rows.
Special tokens in a text are spelt out, unlike in ``packing``: a literal ``<|endoftext|>`` would otherwise be a separator.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, new_path
from .common import only
from .tokens import word_ids

END_OF_DOCUMENT = 49407
ITEM = 2
BLOCK_TOKENS = 1 << 21
BLOCKS_PER_GROUP = 1024


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """Writes one flat file of unsigned 16-bit ids per task; returns (file, ordinal, doc_id), fixed in the shared folder.

    A task that runs twice writes two files; only the file of the run that counted is named in the result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        ids, end, file, out, n = word_ids(path, spell_special=True), separator.to_bytes(ITEM, "little"), "", None, 0
        for b in batches:
            if out is None:
                file = f"{folder}/{uuid.uuid4().hex}.bin"
                store, where = fs.FileSystem.from_uri(file)
                store.create_dir(where.rpartition("/")[0])
                out = store.open_output_stream(where)
            for text in b["text"]:
                out.write(np.frombuffer(ids.ids(text), "<u4").astype("<u2").tobytes() + end)
            yield pd.DataFrame({"file": file, "ordinal": np.arange(n, n + len(b)), "doc_id": b["doc_id"].astype("Int64")})
            n += len(b)
        if out is not None:
            out.close()

    return cut_lineage(only(docs, doc_id="doc_id", text="text").mapInPandas(run, "file string, ordinal long, doc_id long"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n_bytes) of a folder of flat files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("file"), F.col("length").alias("n_bytes"))


def scan_blocks(files: DataFrame, separator: int = END_OF_DOCUMENT, item: int = ITEM, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block: file, block, n_tokens and ``ends``, the places of the separators within the block."""
    step = block_tokens * item

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for file, block, n_bytes in zip(b["file"], b["block"], b["n_bytes"]):
                store, where = fs.FileSystem.from_uri(file)
                with store.open_input_file(where) as f:
                    data = f.read_at(min(step, n_bytes - block * step), block * step)
                found = np.frombuffer(data, f"<u{item}")
                ends = np.flatnonzero(found == separator)
                yield pd.DataFrame({"file": [file], "block": [block], "n_tokens": [len(found)], "ends": [ends]})

    blocks = files.where("n_bytes > 0").select("file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n_bytes") - 1) / step).cast("long"))).alias("block"))
    # a row per block: spread the rows, as each stands for megabytes
    return blocks.repartition("file", "block").mapInPandas(run, "file string, block long, n_tokens long, ends array<long>")


def _running(blocks: DataFrame, name: str, value: str, fold, empty: int) -> DataFrame:
    """Exclusive running fold over the blocks of a file, in two levels."""
    groups = blocks.groupBy("file", "grp").agg(fold(value).alias("_g"))
    before = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    carried = groups.select("file", "grp", fold("_g").over(before).alias("_c"))
    inside = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = blocks.withColumn("_o", fold(value).over(inside)).join(carried, ["file", "grp"])
    both = F.greatest("_c", "_o") if fold is F.max else F.coalesce("_c", F.lit(0)) + F.coalesce("_o", F.lit(0))
    return own.withColumn(name, F.coalesce(both, F.lit(empty))).drop("_c", "_o")


def separator_scan(files: DataFrame, separator: int = END_OF_DOCUMENT, item: int = ITEM, block_tokens: int = BLOCK_TOKENS, blocks_per_group: int = BLOCKS_PER_GROUP) -> DataFrame:
    """One row per document: file, ordinal (from 0), start (ids before it, separators too), n_tokens (without separator), n_blocks."""
    blocks = cut_lineage(scan_blocks(files, separator, item, block_tokens)).withColumns({"grp": F.expr(f"block div {blocks_per_group}"), "n_ends": F.size("ends").cast("long")})
    stitched = _running(_running(blocks, "first", "n_tokens", F.sum, 0), "ordinal", "n_ends", F.sum, 0)
    stitched = stitched.withColumn("_last", F.col("first") + F.try_element_at("ends", F.lit(-1)))  # null without a separator
    stitched = _running(stitched, "carried", "_last", F.max, -1)
    ends = F.transform("ends", lambda e: F.col("first") + e)
    starts = F.transform(F.concat(F.array("carried"), ends), lambda e: e + 1)
    docs = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z, i: F.struct((F.col("ordinal") + i).alias("ordinal"), z["s"].alias("start"), (z["e"] - z["s"]).alias("n_tokens")))
    closed = stitched.select("file", F.explode(F.slice(docs, 1, F.size("ends"))).alias("d")).select("file", "d.*")
    open_end = stitched.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.sum("n_ends").alias("ordinal"), F.coalesce(F.max("_last"), F.lit(-1)).alias("last"))
    rest = open_end.where("last + 1 < total").select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("total") - F.col("last") - 1).alias("n_tokens"))
    out = closed.unionByName(rest)
    return out.withColumn("n_blocks", F.expr(f"(start + n_tokens) div {block_tokens} - start div {block_tokens} + 1"))


def token_counts(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents to flat files and back: doc_id, n_tokens and the number of blocks the document and its separator touch."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    manifest = write_token_files(docs, folder, path)
    names = manifest.select("file").distinct()
    if not manifest.head(1):
        return manifest.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_blocks"))
    name = F.substring_index("file", "/", -1)
    files = list_files(spark, folder).join(names.select(name.alias("name")), name == F.col("name"), "left_semi")
    found = separator_scan(files, block_tokens=block_tokens).withColumn("name", name).drop("file")
    return found.join(manifest.withColumn("name", name).drop("file"), ["name", "ordinal"]).select("doc_id", "n_tokens", "n_blocks")
