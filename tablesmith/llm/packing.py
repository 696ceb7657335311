"""Packing documents into fixed windows by non-negative least squares over length combinations.

Each document is its ids and one end id. Whole windows are cut from its front and are sequences of their own. The tails are counted
in a histogram (at most ``window - 1`` lengths, whatever the corpus). On the driver shallow combinations of two to four tail
lengths that fill a window exactly are enumerated, their repeat counts are solved against the histogram by non-negative least
squares, rounded down and topped up while stock lasts. Tails take their place by rank within their length. What is left is packed
greedily: one after the other, cut at every window edge; the last window is cut into powers of two, so nothing is padded.

Ranks and running totals are taken in two levels (within parts of bounded size, then over the parts), so a length shared by any
share of the documents is not one task. Special tokens in a text get their own ids. Null and empty texts are the end id alone. Rows that repeat an identifier are packed each;
null identifiers are packed too. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import only
from .tokens import word_ids

WINDOW = 2048
END_ID = 1
#: tail lengths from which triples and quadruples are formed
ANCHORS = (48, 16)
ROWS_PER_PART = 100_000


def token_rows(docs: DataFrame, path: str | None, window: int, end_id: int) -> DataFrame:
    """uid, doc_id, doc_tokens, CRCs of the whole windows, and the tail with its CRC."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, end, step = word_ids(path), end_id.to_bytes(4, "little"), 4 * window
        for b in batches:
            out = []
            for uid, doc_id, text in zip(b["uid"], b["doc_id"], b["text"]):
                data = memoryview(ids.ids(text) + end)
                whole = len(data) // step * step
                out.append((uid, doc_id, len(data) // 4, [zlib.crc32(data[i : i + step]) for i in range(0, whole, step)], zlib.crc32(data[whole:]), np.frombuffer(data[whole:], "<u4").astype("<u2" if ids.tokenizer.get_vocab_size() <= 1 << 16 else "<u4").tobytes()))
            yield pd.DataFrame(out, columns=["uid", "doc_id", "doc_tokens", "crcs", "tail_crc", "tail"]).astype({"doc_id": "Int64"})

    rows = only(docs, doc_id="doc_id", text="text").withColumn("uid", F.monotonically_increasing_id())
    return rows.mapInPandas(run, "uid long, doc_id long, doc_tokens long, crcs array<long>, tail_crc long, tail binary")


def combinations(stock: np.ndarray, window: int, anchors: tuple[int, int] = ANCHORS) -> list[tuple[int, ...]]:
    """Combinations of two to four lengths in stock that sum to the window; stock counts by length, 0 to window - 1."""
    have = stock > 0
    found = {(a, window - a) for a in range(1, window // 2 + 1) if have[a] and have[window - a]}
    common = [int(x) for x in np.lexsort((np.arange(len(stock)), -stock)) if stock[x] > 0]
    first, second = (sorted(common[:n]) for n in anchors)
    for i, a in enumerate(first):
        for b in first[i:]:
            c = window - a - b
            if c > 0 and have[c]:
                found.add(tuple(sorted((a, b, c))))
    for i, a in enumerate(second):
        for j, b in enumerate(second[i:], i):
            for c in second[j:]:
                d = window - a - b - c
                if d > 0 and have[d]:
                    found.add(tuple(sorted((a, b, c, d))))
    return sorted(found)


def repeats(patterns: list[tuple[int, ...]], stock: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts with the least squared distance to the stock, by accelerated projected gradients."""
    row = np.array([length for p in patterns for length in p])
    col = np.array([i for i, p in enumerate(patterns) for _ in p])
    n, h = len(patterns), stock.astype(float)

    def times(x):
        return np.bincount(row, x[col], len(stock))

    def back(r):
        return np.bincount(col, r[row], n)

    v = np.ones(n)
    for _ in range(30):  # largest squared singular value
        v = back(times(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(times(y) - h) / (1.05 * size))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def solve(stock: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with whole repeat counts that the stock can serve."""
    patterns = combinations(stock, window)
    if not patterns:
        return []
    want, left, got = repeats(patterns, stock), stock.astype(np.int64).copy(), np.zeros(len(patterns), np.int64)
    order = np.argsort(-want, kind="stable")
    for rounds in (np.floor(want), np.full(len(patterns), np.inf)):  # the solution rounded down, then what stock remains
        for i in order:
            lengths, need = np.unique(patterns[i], return_counts=True)
            n = int(min(rounds[i], (left[lengths] // need).min()))
            left[lengths] -= n * need
            got[i] += n
    return [(patterns[i], int(got[i])) for i in range(len(patterns)) if got[i]]


def _places(solved: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple], int]:
    """For each length the ranks that go to a slot: (tail, from, to, first sequence, offset); and the sequences used."""
    used: dict[int, int] = {}
    out, seq = [], 0
    for pattern, n in solved:
        offset = 0
        for length in pattern:
            start = used.get(length, 0)
            out.append((length, start, start + n, seq, offset))
            used[length] = start + n
            offset += length
        seq += n
    return out, seq


def _prefix(df: DataFrame, part: list[str], values: dict[str, str], over: list[str]) -> DataFrame:
    """Adds per name the exclusive running total of a column, in two levels: within ``part``, then over the parts of ``over``."""
    totals = df.groupBy(*part).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    rest = [c for c in part if c not in over]
    w = Window.partitionBy(*over).orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*part, *[F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy(*part).orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumns({f"_o_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()})
    out = own.join(base, part)
    return out.withColumns({n: F.col(f"_b_{n}") + F.col(f"_o_{n}") for n in values}).drop(*[f"_{x}_{n}" for x in "bo" for n in values])


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    wide = cut_lineage(token_rows(docs, path, window, end_id))
    n_rows = wide.count()
    parts = n_rows // rows_per_part + 1
    slim = cut_lineage(
        wide.select("uid", F.size("crcs").cast("long").alias("whole"), (F.col("doc_tokens") % window).cast("int").alias("tail_len")).withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)))
    )
    slim = slim.withColumns({"one": F.lit(1).cast("long"), "all": F.lit(0)})
    counts = {r[0]: r[1] for r in slim.groupBy("tail_len").count().collect()}  # at most one row per length below the window
    stock = np.zeros(window, np.int64)
    for length, n in counts.items():
        if length:
            stock[length] = n
    n_whole = slim.agg(F.sum("whole")).first()[0] or 0
    places, n_solved = _places(solve(stock, window))

    ranked = _prefix(slim, ["tail_len", "part"], {"rank": "one"}, ["tail_len"])
    ranked = _prefix(ranked, ["all", "part"], {"first_whole": "whole"}, ["all"])
    # bounded: a few slots for each of the enumerated patterns
    slots = F.broadcast(spark.createDataFrame(places, "tail_len int, lo long, hi long, first_seq long, offset long"))
    placed = ranked.alias("r").join(
        slots.alias("s"), (F.col("r.tail_len") == F.col("s.tail_len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left"
    )
    placed = cut_lineage(placed.select("uid", "part", "all", "r.tail_len", "first_whole", (F.col("first_seq") + F.col("rank") - F.col("lo") + n_whole).alias("seq"), "offset"))
    rest = placed.where("seq IS NULL AND tail_len > 0")
    n_rest = rest.agg(F.sum("tail_len")).first()[0] or 0
    at = _prefix(rest, ["all", "part"], {"at": "tail_len"}, ["all"])
    edges = []  # the last window's own sequences: powers of two, largest first
    full, start = n_rest // window, n_rest // window * window
    for bit in reversed(range(window.bit_length())):
        if (n_rest - start) >> bit & 1:
            edges.append((start, 1 << bit))
            start += 1 << bit
    base = n_whole + n_solved
    last = F.array(*[F.struct(F.lit(s).cast("long").alias("lo"), F.lit(s + n).cast("long").alias("hi"), F.lit(base + full + i).cast("long").alias("seq")) for i, (s, n) in enumerate(edges)]) if edges else None
    end = F.col("at") + F.col("tail_len")
    windows = F.transform(
        F.expr(f"sequence(at div {window}, (at + tail_len - 1) div {window})"),
        lambda k: F.struct((k * window).alias("lo"), ((k + 1) * window).alias("hi"), (k + base).alias("seq")),
    )
    if last is not None:
        windows = F.concat(F.filter(windows, lambda w: w["seq"] < base + full), last)
    cuts = F.transform(
        F.filter(windows, lambda w: (w["lo"] < end) & (w["hi"] > F.col("at"))),
        lambda w: F.struct(
            (F.greatest(w["lo"], F.col("at")) - F.col("at")).alias("lo"), (F.least(w["hi"], end) - F.col("at")).alias("hi"), w["seq"].alias("seq"), (F.greatest(w["lo"], F.col("at")) - w["lo"]).alias("offset")
        ),
    )
    plan = placed.where("seq IS NOT NULL OR tail_len = 0").select("uid", "first_whole", "seq", "offset", F.lit(None).cast("array<struct<lo:long,hi:long,seq:long,offset:long>>").alias("cuts"))
    plan = plan.unionByName(at.select("uid", "first_whole", "seq", "offset", cuts.alias("cuts")))
    row = "struct<start:long,length:long,ids_crc32:long,sequence_id:long,offset:long>"
    joined = wide.join(plan, "uid")
    whole = F.transform(F.col("crcs"), lambda c, i: F.struct((i * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), c.alias("ids_crc32"), (F.col("first_whole") + i).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    done = F.col("doc_tokens") - F.col("doc_tokens") % window
    tail = F.when(F.col("seq").isNotNull(), F.array(F.struct(done.alias("start"), (F.col("doc_tokens") % window).alias("length"), F.col("tail_crc").alias("ids_crc32"), F.col("seq").alias("sequence_id"), F.col("offset").alias("offset"))))
    pieces = joined.where("cuts IS NULL").select("doc_id", "doc_tokens", F.explode(F.concat(whole, F.coalesce(tail, F.array().cast(f"array<{row}>"))).cast(f"array<{row}>")).alias("p"))
    out = ["doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, n, crcs, first, tail, cuts in zip(b["doc_id"], b["doc_tokens"], b["crcs"], b["first_whole"], b["tail"], b["cuts"]):
                front = n // window * window
                rows += [(doc_id, i * window, window, c, n, first + i, 0) for i, c in enumerate(crcs)]
                ids = np.frombuffer(tail, "<u2" if len(tail) == 2 * (n - front) else "<u4").astype("<u4")
                rows += [(doc_id, front + c["lo"], c["hi"] - c["lo"], zlib.crc32(ids[c["lo"] : c["hi"]].tobytes()), n, c["seq"], c["offset"]) for c in cuts]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    cut_rows = joined.where("cuts IS NOT NULL").select("doc_id", "doc_tokens", "crcs", "first_whole", "tail", "cuts")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.select(*out).unionByName(cut_rows.mapInPandas(cut, schema))
