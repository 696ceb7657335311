"""Repeated passages by sorted suffixes: sampled splitters, range-cut buckets, multikey quicksort, comparison across boundaries.

Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another.

1. *Which suffixes.* Of each ``length``-byte window the ``gram``-byte string with the smallest hash (the leftmost of equal ones) is the window's
   anchor. Equal windows have it at the same place, so only suffixes that begin at anchors, about one in 85, need sorting. An anchor's context
   holds all windows it stands for.
2. *Buckets.* Splitters sampled from the suffixes' leading bytes cut them into ranges of about ``rows_per_bucket``. A
   leading string that fills several ranges is dealt on by the hash of its context. Tasks send one compressed block per bucket; contexts that are
   equal within a task's block of texts are sent once, marked as repeated.
3. *Sorting.* A bucket sorts its suffixes by multikey quicksort over 8-byte words, only rows that still agree with a neighbour go on to the next
   word, and likewise the strings that lead up to the anchors, backwards. Both orders have the length that neighbours share; two windows at offset a of their
   anchors are equal if they fall in the same run of both orders, of a bytes to the left and the rest to the right.
4. *Boundaries.* Windows whose right part agrees with the bucket's first or last suffix may have a twin beyond: their digests, one per
   distinct window and bucket, are counted over all buckets.

Nothing is capped. A task holds one bucket or one block of texts; the driver gets about ``SAMPLES`` leading strings a bucket.

Defined cases: null text is empty; texts shorter than ``length`` keep all. Rows with equal texts get equal results, whatever their
identifiers. Texts longer than a block are cut into blocks that overlap by ``length`` - 1 bytes. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .common import only, salted_lookup

LENGTH, GRAM, LEAD = 200, 32, 48
ROWS_PER_BUCKET = 60_000
#: leading strings sampled for each bucket; texts in the sample
SAMPLES, SAMPLE_TEXTS = 20, 4_000
#: bytes of text hashed at a time, and sent at a time
STEP, BLOCK = 500_000, 4_000_000


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each position on, by doubling; ``size`` is a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n = 1
    while n < size:
        h = (h[:-n] ^ (h[:-n] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[n:]
        n *= 2
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` neighbours, in two passes over blocks of ``w``."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: bytes, starts: np.ndarray, stops: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor) of joined texts; every window of a text belongs to exactly one row."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    bits = np.uint64(len(h).bit_length())
    least = sliding_min((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # windows lie inside a text
    n = np.maximum(stops - starts - length + 1, 0)
    text = np.repeat(np.arange(len(starts)), n)
    p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    if not len(p):
        return (np.zeros(0, np.int64),) * 4
    at = at[p]
    new = np.r_[True, at[1:] != at[:-1]]
    first = np.flatnonzero(new)
    return text[first], p[first], np.diff(np.r_[first, len(p)]), at[first]


def _pieces(batches: Iterator[pd.DataFrame], length: int, step: int) -> Iterator[tuple[bytes, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts of about ``step`` bytes: (data, ids, place of the first byte in its text, starts, stops)."""
    held, size = [], 0
    for b in batches:
        for uid, text in zip(b["id"], b["text"]):
            raw = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(len(raw) - length + 1, 0), step):
                held.append((uid, at, raw[at : at + step + length - 1]))
                size += len(held[-1][2])
                if size >= step:
                    yield _join(held)
                    held, size = [], 0
    if held:
        yield _join(held)


def _join(held):
    n = np.array([len(r) for _, _, r in held], np.int64)
    stops = np.cumsum(n)
    return b"".join(r for _, _, r in held), [u for u, _, _ in held], np.array([a for _, a, _ in held], np.int64), stops - n, stops


def _blocks(batches, length: int, gram: int, splitters: list[bytes], lead: int, step: int, block: int) -> Iterator[pd.DataFrame]:
    """(bucket, rows): the contexts of a block of texts that go to a bucket, compressed."""
    import zstandard
    from xxhash import xxh64_intdigest

    cuts = np.array(splitters, f"S{lead + 1}")  # a closing 1 keeps trailing zero bytes
    pack = zstandard.ZstdCompressor(3)
    ids, first, off, many, contexts, spans, known, size = [], [], [], [], [], [], {}, 0

    def send() -> pd.DataFrame:
        leads = np.array([c[o : o + lead] + b"\1" for c, o in zip(contexts, off)], f"S{lead + 1}")
        low, high = np.searchsorted(cuts, leads, "left"), np.searchsorted(cuts, leads, "right")
        tie = np.array([xxh64_intdigest(c) for c in contexts], np.uint64)
        bucket = (low + (tie % (high - low + 1).astype(np.uint64)).astype(np.int64)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            body = ([ids[i] for i in rows], [first[i] for i in rows], [off[i] for i in rows], [many[i] for i in rows], [len(contexts[i]) for i in rows], b"".join([contexts[i] for i in rows]), [s for i in rows for s in spans[i]])
            out.append((int(bucket[rows[0]]), pack.compress(pickle.dumps(body, 5))))
        return pd.DataFrame(out, columns=["bucket", "rows"])

    for data, uids, base, starts, stops in _pieces(batches, length, step):
        text, p, n, at = anchors(data, starts, stops, length, gram)
        for t, a, stop, o, own in zip(text.tolist(), p.tolist(), (p + n - 1 + length).tolist(), (at - p).tolist(), (base[text] + p - starts[text]).tolist()):
            c = data[a:stop]
            i = known.setdefault(c, len(contexts))
            if i < len(contexts):
                many[i] = True
                spans[i].append((uids[t], own, own + len(c)))
                continue
            ids.append(uids[t]), first.append(own), off.append(o), many.append(False), contexts.append(c), spans.append([])
        size += len(data)
        if size >= block and contexts:
            yield send()
            ids, first, off, many, contexts, spans, known, size = [], [], [], [], [], [], {}, 0
    if contexts:
        yield send()


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (bytes, a multiple of 8 wide) and how many bytes each shares with the one before it.

    Multikey quicksort by words of 8 bytes: rows are sorted by one word, and only runs that agree go on to the next.
    """
    n, width = rows.shape
    words = rows.view(">u8")
    order, shared = np.arange(n), np.full(n, width)
    live, run = np.arange(n), np.zeros(n, np.int64)
    for d in range(width // 8):
        if not len(live):
            break
        w = words[order[live], d].astype(np.uint64)
        by = np.lexsort((w, run)) if d else np.argsort(w)
        order[live], w = order[live[by]], w[by]  # runs keep their places
        same_run = run[1:] == run[:-1]
        differ = w[1:] ^ w[:-1]
        apart = same_run & (differ != 0)
        bytes_same = sum((differ < np.uint64(1 << (56 - 8 * k))).astype(np.int64) for k in range(7))
        shared[live[1:][apart]] = 8 * d + bytes_same[apart]
        starts = np.r_[True, ~same_run | apart]
        run = np.cumsum(starts) - 1
        alone = np.bincount(run)[run] == 1
        live, run = live[~alone], run[~alone]
    if n:
        shared[0] = 0
    return order, shared


def _matrix(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """``width`` bytes from each start on (or backwards from it), zeros beyond the size."""
    width = -(-width // 8) * 8
    out = np.zeros((len(starts), width), np.uint8)
    for at in range(0, len(starts), 20_000):
        k = np.arange(width)
        inside = k < sizes[at : at + 20_000, None]
        where = starts[at : at + 20_000, None] + (-1 - k if back else k)
        out[at : at + 20_000][inside] = data[where[inside]]
    return out


def _shared_with(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    differ = rows != row
    return np.where(differ.any(1), differ.argmax(1), rows.shape[1])


def repeated(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, off: np.ndarray, length: int, gram: int, lead: int):
    """Of one bucket's contexts: (row, offset) marks of repeated windows and of windows that may have twins in other buckets."""
    n, width = len(starts), length - gram + 1
    found, beyond = np.zeros((n, width), bool), np.zeros((n, width), bool)
    right = _matrix(data, starts + off, sizes - off, length)
    order, shared = multikey_sort(right)
    reach = np.maximum(shared, np.r_[shared[1:], 0])  # the most bytes shared with a neighbour
    to_right = np.empty(n, np.int64)
    to_right[order] = reach
    edge = np.maximum(_shared_with(right, right[order[0]]), _shared_with(right, right[order[-1]]))
    edge[edge >= lead] = length
    live = np.flatnonzero(np.maximum(to_right, edge) >= gram)
    left = _matrix(data, (starts + off)[live], off[live], width, back=True)
    order_l, shared_l = multikey_sort(left)
    place = np.full(n, -1)
    place[live] = np.arange(len(live))
    keep = place[order] >= 0
    order_r, shared_r = place[order[keep]], _least_between(shared, keep)
    to_left = np.empty(len(live), np.int64)
    to_left[order_l] = np.maximum(shared_l, np.r_[shared_l[1:], 0])
    high = off[live]
    low = high - (sizes[live] - length)
    cls_r, cls_l = np.empty(len(live), np.int64), np.empty(len(live), np.int64)
    for a in range(width):
        own = (low <= a) & (a <= high)
        ask = np.flatnonzero(own & (to_left >= a) & (to_right[live] >= length - a))
        cross = np.flatnonzero(own & (edge[live] >= length - a))
        if len(cross):
            beyond[live[cross], a] = True
        if len(ask) < 2:
            continue
        cls_r[order_r], cls_l[order_l] = np.cumsum(shared_r < length - a), np.cumsum(shared_l < a)
        key = cls_l[ask] * (len(live) + 1) + cls_r[ask]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        twice = np.r_[same, False] | np.r_[False, same]
        found[live[ask[by[twice]]], a] = True
    return found, beyond


def _least_between(shared: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Shared length of neighbours among the kept rows: the least since the kept row before."""
    kept = np.flatnonzero(keep)
    if not len(kept):
        return shared[:0]
    starts = np.r_[0, kept[:-1] + 1]
    return np.minimum.reduceat(shared[: kept[-1] + 1], starts)


def _bucket(key, pdf: pd.DataFrame, length: int, gram: int, lead: int) -> pd.DataFrame:
    """Spans of repeated windows (start, stop), and open windows (window digest; without id if it is known to repeat here)."""
    import zstandard
    from xxhash import xxh3_128_digest

    unpack = zstandard.ZstdDecompressor()
    ids, first, off, many, sizes, parts, spans = [], [], [], [], [], [], []
    for blob in pdf["rows"]:
        body = pickle.loads(unpack.decompress(blob))
        for whole, part in zip((ids, first, off, many, sizes), body[:5]):
            whole.extend(part)
        parts.append(body[5])
        spans.extend(body[6])
    first, off, many, sizes = (np.array(x, np.int64) for x in (first, off, many, sizes))
    raw = b"".join(parts)
    starts = np.cumsum(sizes) - sizes
    found, beyond = repeated(np.frombuffer(raw, np.uint8), starts, sizes, off, length, gram, lead)
    width = found.shape[1]
    high, low = off, off - (sizes - length)
    a = np.arange(width)
    found |= (many[:, None] > 0) & (a >= low[:, None]) & (a <= high[:, None])
    # windows in text order run from the highest offset down
    edges = np.diff(np.pad(found[:, ::-1].astype(np.int8), ((0, 0), (1, 1))), axis=1)
    r, s = np.nonzero(edges == 1)
    _, e = np.nonzero(edges == -1)
    start = first[r] + high[r] - (width - 1 - s)
    stop = first[r] + high[r] - (width - e) + length
    out = [pd.DataFrame({"id": [ids[i] for i in r], "start": start, "stop": stop, "window": None})]
    if spans:
        out.append(pd.DataFrame(spans, columns=["id", "start", "stop"]).assign(window=None))
    r, s = np.nonzero(beyond)
    windows, told = [], set()
    for i, o in zip(r.tolist(), s.tolist()):
        at = starts[i] + high[i] - o
        digest = xxh3_128_digest(raw[at : at + length])
        if not found[i, o]:
            own = int(first[i] + high[i] - o)
            windows.append((ids[i], own, own + length, digest))
        elif digest not in told:
            told.add(digest)
            windows.append((None, 0, 0, digest))
    if windows:
        out.append(pd.DataFrame(windows, columns=["id", "start", "stop", "window"]))
    return pd.concat(out, ignore_index=True)


def find_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, lead: int = LEAD, rows_per_bucket: int = ROWS_PER_BUCKET, step: int = STEP, block: int = BLOCK) -> DataFrame:
    """(id, spans): bytes covered by repeated strings, for texts (id binary, text) that have any; spans may overlap."""
    if gram & (gram - 1) or not gram <= length:
        raise ValueError("gram is a power of two, at most the length")
    lead = max(lead, gram)
    spark = texts.sparkSession
    long = texts.where(F.octet_length("text") >= length)
    n, size = long.agg(F.count("*"), F.sum(F.octet_length("text").cast("double"))).first()
    buckets = int((size or 0) * 2 / (length - gram + 2) / rows_per_bucket) + 1
    splitters: list[bytes] = []
    if buckets > 1:

        # texts by a bound on their hash, then anchors: about SAMPLES for each bucket, whatever the size of the table
        share = min(1.0, max(SAMPLE_TEXTS, SAMPLES * buckets) / n)
        part = min(1.0, SAMPLES * buckets / (share * size * 2 / (length - gram + 2)))

        def leads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from xxhash import xxh64_intdigest

            for data, uids, base, starts, stops in _pieces(batches, length, step):
                text, _, _, at = anchors(data, starts, stops, length, gram)
                own = np.array([xxh64_intdigest(u) for u in uids], np.uint64)[text] + (base[text] + at - starts[text]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                own = (own ^ (own >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                yield pd.DataFrame({"lead": [data[x : x + lead] + b"\1" for x in at[own <= np.uint64((2**64 - 4096) * part)].tolist()]})

        bound = -(1 << 63) + int((2.0**64 - 4096) * share)
        some = long.where(F.xxhash64("id") <= bound).mapInPandas(leads, "lead binary")
        ordered = sorted(bytes(r.lead) for r in some.collect())
        splitters = [ordered[i * len(ordered) // buckets] for i in range(1, buckets)] if ordered else []
    blocks = long.mapInPandas(lambda b: _blocks(b, length, gram, splitters, lead, step, block), "bucket long, rows binary")
    path = new_path(spark, "suffix-spans")
    out = blocks.groupBy("bucket").applyInPandas(lambda key, pdf: _bucket(key, pdf, length, gram, lead), "id binary, start long, stop long, window binary")
    out.write.option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    open_windows = out.where("window IS NOT NULL")
    # a window that repeats within a bucket counts twice
    counts = open_windows.groupBy("window").agg(F.sum(F.when(F.col("id").isNull(), 2).otherwise(1)).alias("n")).where("n > 1").select("window")
    crossing = open_windows.where("id IS NOT NULL").join(counts, "window", "left_semi")
    spans = out.where("window IS NULL").select("id", "start", "stop").unionByName(crossing.select("id", "start", "stop"))
    return spans.groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans, in order."""
    out: list[list[int]] = []
    for start, stop in sorted(zip(starts.tolist(), stops.tolist())):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(start, stop) for start, stop in out]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (what goes, maximal runs in order), kept (the bytes that stay)."""
    rows = only(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.unhex(F.md5("text")))
    found = find_spans(rows.select("id", "text"), length, **sizes)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, starts, stops in zip(b["text"], b["starts"], b["stops"]):
                raw = text.encode("utf-8", "surrogatepass")
                runs = merged(starts, stops) if starts is not None else []
                kept, at = [], 0
                for start, stop in runs:
                    kept.append(raw[at:start])
                    at = stop
                kept.append(raw[at:])
                out.append((len(raw), [s for s, _ in runs], [e for _, e in runs], b"".join(kept)))
            yield pd.concat([b[["doc_id"]], pd.DataFrame(out, columns=["n_bytes", "start", "stop", "kept"], index=b.index)], axis=1)

    both = salted_lookup(rows, found, ["id"], F.xxhash64("doc_id"))
    kind = dict(rows.dtypes)["doc_id"]
    # identifiers as text: with nulls pandas would make them floats
    given = both.select(F.col("doc_id").cast("string"), "text", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    out = given.mapInPandas(cut, "doc_id string, n_bytes long, start array<long>, stop array<long>, kept binary")
    return out.select(F.col("doc_id").cast(kind), "n_bytes", F.arrays_zip("start", "stop").alias("spans"), "kept")
