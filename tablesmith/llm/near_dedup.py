"""Near duplicates: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A document's set holds its distinct five-word shingles (words lower-cased A-Z, split at ASCII white space), as 64-bit hashes. Equal sets are
one node. A node's signature has ``CHUNKS * CHUNK`` positions of 16 bits, each from one MinHash. Pigeonhole: two signatures that differ at no
more than ``DISTANCE = CHUNKS * (ERRORS + 1) - 1`` positions differ at ``ERRORS`` or fewer in some chunk. All ways to leave out ``ERRORS``
positions of a chunk are enumerated and the rest is the key, so such a pair always shares a key: the join meets every pair
within that distance, and what shares a key is decided on full sets. At similarity 0.75 a pair is farther apart with chance 8e-6 (34 or more of 68
positions), at 0.8 with 3e-8 or less; nothing else is approximate.

Postings are sorted by range of (key, node), so a key of any size is spread over tasks, and keys of one node are dropped there.
1. Neighbours in that order are candidates; each node's ``NEAREST`` nearest by signature are confirmed and contracted to components.
2. Then the nodes of each key that are still in different components are compared, in tiles of at most ``2 * BLOCK`` nodes; tiles inside
   the key's largest component are left out. Pairs within the distance in tiles of at most ``SMALL`` nodes are confirmed as they are. In larger tiles, nodes
   without a partner within the distance drop out. Of each other node a tile then holds bits: which shingles
   of a common vocabulary it has, and into which of ``HASHED`` places its other shingles fall. Bits in common, and the smaller number of
   shingles that share a place, bound the intersection, so most pairs below the threshold go without a look at their sets; only the
   rest is confirmed. The vocabulary is that of ``PIVOTS`` nodes of the key's largest component: copies of one text
   agree on it or not, whatever else they hold.

Pairs inside one component need no confirmation, so a group of n near copies costs about n links instead of n * n / 2, and copies that lie
just below the threshold meet as bits in a tile, never as rows. No partner, candidate or group is capped.

Defined cases: null text is empty; an empty set is linked with nothing and is its own component. Equal sets are linked. Null
identifiers are linked like others; a component's id is the smallest identifier that is not null (null if there is none). Rows that
repeat an identifier share the decision of their own text. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SALTS, only, salted_lookup, text_hash
from .components import components

WORDS = 5
CHUNKS, CHUNK, ERRORS = 17, 4, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: sorted neighbours that differ at more positions are not tried first
FAR = 29
NEAREST = 3
BLOCK, SET_BLOCK = 4096, 2048
#: rows of a tile up to which its pairs are told as they are
SMALL = 32
#: nodes whose sets make a vocabulary, its shingles at most (any vocabulary gives right bounds), and places for all others
PIVOTS, BITS, HASHED = 4, 16_384, 1_024
MAX_WORDS = 500_000
_rng = np.random.default_rng(20)
_STEP = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, CHUNKS * CHUNK, dtype=np.uint64) * np.uint64(2)
_TURN = _rng.integers(1, 1 << 63, CHUNKS * CHUNK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# positions that make up each key
KEYS = [[c * CHUNK + p for p in kept] for c in range(CHUNKS) for kept in combinations(range(CHUNK), CHUNK - ERRORS)]
_PLACES = np.array(KEYS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, known: dict[bytes, int], size: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; ``known`` caches word hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    try:
        h = np.array(list(map(known.__getitem__, words)), np.uint64)
    except KeyError:
        if len(known) > MAX_WORDS:
            known.clear()
        known.update((w, xxh64_intdigest(w)) for w in set(words).difference(known))
        h = np.array(list(map(known.__getitem__, words)), np.uint64)
    n = min(size, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _STEP[k]
    return np.unique(_mixed(total))


def signature(s: np.ndarray) -> np.ndarray:
    """Low 16 bits of the MinHash of each position."""
    low = np.full(len(_TURN), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        part = s[at : at + 2048, None]
        low = np.minimum(low, ((part ^ _FLIP) * _TURN).min(0))
    return (low & np.uint64(0xFFFF)).astype("<u2")


def set_rows(docs: DataFrame) -> DataFrame:
    """Per document: uid, doc_id, raw, n_shingles, node (digest of the set, null if empty), sig."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        known: dict[bytes, int] = {}
        for b in batches:
            out = []
            for text in b.pop("text"):
                s = shingles(text, known)
                out.append((len(s), xxh3_128_digest(s.tobytes()), signature(s).tobytes()) if len(s) else (0, None, None))
            b["doc_id"] = b["doc_id"].astype("Int64")
            b[["n_shingles", "node", "sig"]] = pd.DataFrame(out, columns=["n_shingles", "node", "sig"], index=b.index)
            yield b

    rows = only(docs, doc_id="doc_id", text="text").select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("raw"), "text")
    return cut_lineage(rows.mapInPandas(run, "uid long, doc_id long, raw long, n_shingles long, node binary, sig binary"))


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), -1)


def live_postings(nodes: DataFrame) -> DataFrame:
    """(key, node, prev) of keys with several nodes; ``prev`` is the node before it under the key in the sorted order."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sig = _sigs(b.pop("sig")).astype(np.int64)
            out = np.stack([sum(sig[:, p] << (16 * i) for i, p in enumerate(places)) | (k << 48) for k, places in enumerate(KEYS)], 1)
            b["keys"] = list(out)
            yield b

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, prev, first = None, None, True  # the last row waits for its successor
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            k, node = b["key"].to_numpy(), b["node"].to_numpy()
            same = k[1:] == k[:-1]
            before = np.r_[prev is not None and prev[0] == k[0] if len(k) else False, same]
            live = before[:-1] | same
            if first and len(live):
                live[0], first = True, False  # its key may have started in the partition before
            prevs = np.r_[[prev[1] if before[0] else None], np.where(same, node[:-1], None)].astype(object)
            yield pd.DataFrame({"key": k[:-1][live], "node": node[:-1][live], "prev": prevs[:-1][live]})
            held, prev = b.iloc[-1:], (k[-2], node[-2]) if len(k) > 1 else prev
        if held is not None:
            k, node = held["key"].iloc[0], held["node"].iloc[0]
            yield pd.DataFrame({"key": [k], "node": [node], "prev": [prev[1] if prev is not None and prev[0] == k else None]})

    postings = nodes.select("node", "sig").mapInPandas(keys, "node binary, keys array<long>").select(F.explode("keys").alias("key"), "node")
    ordered = postings.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return cut_lineage(ordered.mapInPandas(neighbours, "key long, node binary, prev binary"))


def near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that differ at few positions, with how many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["d"] = (_sigs(b.pop("sa")) != _sigs(b.pop("sb"))).sum(1)
            yield b[b["d"] <= FAR]

    sig = nodes.select("node", "sig").hint("merge")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInPandas(run, "a binary, b binary, d int")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) for the given nodes, from one document each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "shingles": [shingles(t, known).view(np.int64) for t in b["text"]]})

    rows = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("raw"), "text").alias("d")
    want = nodes.select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.raw").alias("raw")).alias("w")
    found = rows.join(want, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.raw") == F.col("w.raw")))
    sets = found.select("w.node", "text").mapInPandas(run, "node binary, shingles array<long>")
    return cut_lineage(sets.dropDuplicates(["node"]))


def confirmed(pairs: DataFrame, sets: DataFrame, block: int = SET_BLOCK) -> DataFrame:
    """The pairs whose full sets reach the similarity.

    Nodes are dealt to blocks and pairs to tiles of two blocks, and a tile gets each of its nodes' sets once: many pairs among few
    nodes cost few copies of a set, and no tile holds more than two blocks of them.
    """
    parts = F.lit(sets.count() // block + 1)
    tiled = cut_lineage(pairs.select("a", "b", F.pmod(F.xxhash64("a"), parts).alias("i"), F.pmod(F.xxhash64("b"), parts).alias("j")))
    asked = tiled.select("i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    given = asked.join(sets.hint("merge"), "node").select(F.col("i").alias("gi"), F.col("j").alias("gj"), "node", "shingles")

    def compare(pairs: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(given["node"], given["shingles"]))
        size = np.array([(len(own[a]), len(own[b])) for a, b in zip(pairs["a"], pairs["b"])]).reshape(-1, 2)
        same = np.array([len(np.intersect1d(own[a], own[b], assume_unique=True)) for a, b in zip(pairs["a"], pairs["b"])])
        return pairs.loc[100 * same >= 75 * (size.sum(1) - same), ["a", "b"]]

    found = tiled.groupBy("i", "j").cogroup(given.groupBy("gi", "gj")).applyInPandas(compare, "a binary, b binary")
    return cut_lineage(found)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole tiles with the place of each tile's first row; rows come sorted by tile."""

    def starts(b: pd.DataFrame) -> np.ndarray:
        ids = b[["key", "i", "j"]].to_numpy()
        return np.r_[0, np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1]

    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        at = starts(b) if len(b) else np.zeros(1, int)
        held = b.iloc[at[-1] :].reset_index(drop=True)
        if len(at) > 1:
            yield b.iloc[: at[-1]], at[:-1]
    if held is not None and len(held):
        yield held, np.zeros(1, int)


def _partners(kind: np.ndarray, root: np.ndarray, i: int) -> np.ndarray:
    """Rows that row i meets in its tile: the other block, or all of its own, but for its component."""
    return np.flatnonzero((kind == 2 if kind[i] == 2 else kind == 1 - kind[i]) & (root != root[i]))


def _told_here(equal: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of pairs that share several keys only the first one tells."""
    return equal[:, _PLACES].all(2).argmax(1) == key >> 48


def _near_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (node, other) within the distance and across components of small tiles; of larger ones (node, root, top) of nodes that are in such a pair, once a task and top."""
    told: set[tuple[bytes, bytes]] = set()
    for t, starts in _whole(batches):
        sizes = np.diff(np.r_[starts, len(t)])
        tile, few = np.repeat(starts, sizes), np.repeat(sizes <= SMALL, sizes)
        sig, kind, key, node, roots = _sigs(t["sig"]), t["side"].to_numpy(), t["key"].to_numpy(), t["node"].to_numpy(), t["root"].to_numpy()
        _, root = np.unique(roots.astype("S16"), return_inverse=True)
        out = []
        for k in range(1, min(SMALL, len(t))):
            both = few[:-k] & (tile[:-k] == tile[k:]) & (root[:-k] != root[k:])
            at = np.flatnonzero(both & ((kind[:-k] != kind[k:]) | (kind[:-k] == 2)))
            equal = sig[at] == sig[at + k]
            near = equal.sum(1) >= equal.shape[1] - DISTANCE
            at = at[near][_told_here(equal[near], key[at[near]])]
            out += [(min(node[i], node[i + k]), None, None, max(node[i], node[i + k])) for i in at.tolist()]
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            top, own = t["top"].iloc[s], slice(s, s + n)
            for i in range(n):
                if (node[s + i], top) in told:
                    continue
                with_ = s + _partners(kind[own], root[own], i)
                for at in range(0, len(with_), 256):  # most find one soon
                    if ((sig[with_[at : at + 256]] != sig[s + i]).sum(1) <= DISTANCE).any():
                        told.add((node[s + i], top))
                        out.append((node[s + i], roots[s + i], top, None))
                        break
        yield pd.DataFrame(out, columns=["node", "root", "top", "other"])


def _cross_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs across components whose bound reaches the similarity, tile by tile, each once."""
    for whole, starts in _whole(batches):
        out = set()
        for s, e in zip(starts, [*starts[1:], len(whole)]):
            t = whole.iloc[s:e]
            sig, root, node, kind = _sigs(t["sig"]), t["root"].to_numpy(), t["node"].to_numpy(), t["side"].to_numpy()
            size, others, key = t["n"].to_numpy(), t["others"].to_numpy(), t["key"].to_numpy()
            bits = np.frombuffer(b"".join(t["bits"]), np.uint64).reshape(len(t), -1)
            _, root = np.unique(root.astype("S16"), return_inverse=True)
            for i in np.flatnonzero(kind != 1):
                with_ = _partners(kind, root, i)
                with_ = with_[with_ > i] if kind[i] == 2 else with_
                most = np.bitwise_count(bits[with_] & bits[i]).sum(1, dtype=np.int64) + np.minimum(others[with_], others[i])
                with_ = with_[100 * most >= 75 * (size[with_] + size[i] - most)]
                with_ = with_[_told_here(sig[with_] == sig[i], key[with_])]
                out.update((min(node[i], node[j]), max(node[i], node[j])) for j in with_)
        yield pd.DataFrame(sorted(out), columns=["a", "b"])


def vocabulary_bits(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, top, n, others, bits) for each (node, root, top): set size, bits as described above, and how many shingles share a place with another."""
    asked = cut_lineage(asked)
    order = [F.col("root") != F.col("top"), F.xxhash64("node"), "node"]
    members = asked.withColumn("r", F.row_number().over(Window.partitionBy("top").orderBy(*order))).where(F.col("r") <= PIVOTS)
    words = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("shingles")))), 1, BITS)
    vocabulary = members.select("node", "top").join(sets.hint("merge"), "node").groupBy("top").agg(words.alias("shingles"))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    parts = asked.select("top", salt).distinct().join(vocabulary.hint("merge"), "top").select("top", "salt", F.lit(None).cast("binary").alias("node"), "shingles")
    rows = parts.unionByName(asked.join(sets.hint("merge"), "node").select("top", salt, "node", "shingles"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, width = np.zeros(0, np.int64), 0
        for b in batches:
            out = []
            for top, node, own in zip(b["top"], b["node"], b["shingles"]):
                if node is None:
                    words, width = np.sort(own), -(-len(own) // 64) * 64
                    continue
                held = np.zeros(width + HASHED, bool)
                at = np.searchsorted(words, own)
                inside = words[np.minimum(at, len(words) - 1)] == own
                held[at[inside]] = True
                held[width + own[~inside].view(np.uint64) % np.uint64(HASHED)] = True
                out.append((node, top, len(own), len(own) - int(held.sum()), np.packbits(held).tobytes()))
            yield pd.DataFrame(out, columns=["node", "top", "n", "others", "bits"])

    dealt = rows.repartition("top", "salt").sortWithinPartitions("top", "salt", F.col("node").asc_nulls_first())
    return dealt.select("top", "node", "shingles").mapInPandas(run, "node binary, top binary, n long, others long, bits binary")


def remaining_pairs(live: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of one key, each once, in different components and with a bound that reaches the similarity."""
    own = live.select("key", "node").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = cut_lineage(own)
    sizes = own.groupBy("key", "root").count()
    keys = sizes.groupBy("key").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("n"), F.count("root").alias("roots"))
    keys = keys.where("roots > 1").select("key", F.col("top.root").alias("top"), F.expr(f"(top.count - 1) div {block} + 1").alias("n_top"), F.expr(f"(n - top.count - 1) div {block} + 1").alias("n_rest"), (F.col("n") <= block).alias("one"))
    rows = salted_lookup(own, keys, ["key"], F.xxhash64("node")).where("n_rest IS NOT NULL")
    # blocks 0 .. n_rest - 1 hold the other components, the next n_top the largest one, which is not met with itself; few nodes are one tile
    spread = F.xxhash64("node")
    at = F.when(F.col("one"), 0).when(F.col("root") == F.col("top"), F.col("n_rest") + F.pmod(spread, F.col("n_top"))).otherwise(F.pmod(spread, F.col("n_rest")))
    rows = rows.withColumn("at", at)
    met = F.when(F.col("one"), 1).when(F.col("at") < F.col("n_rest"), F.col("n_rest") + F.col("n_top")).otherwise(F.col("n_rest"))
    rows = rows.select("key", "node", "root", "top", "at", F.explode(F.sequence(F.lit(0).cast("long"), met - 1)).alias("o"))
    side = F.when(F.col("at") == F.col("o"), 2).when(F.col("at") < F.col("o"), 0).otherwise(1)
    rows = rows.select("key", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "node", "root", "top", side.alias("side"))
    rows = cut_lineage(rows.join(nodes.select("node", "sig").hint("merge"), "node"))
    tile = ["key", "i", "j"]
    dealt = rows.repartition(*tile).sortWithinPartitions(*tile)
    near = cut_lineage(dealt.select(*tile, "node", "root", "top", "side", "sig").mapInPandas(_near_nodes, "node binary, root binary, top binary, other binary"))
    few = near.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    bits = cut_lineage(vocabulary_bits(near.where("other IS NULL").select("node", "root", "top").distinct(), sets))
    dealt = rows.join(bits.hint("merge"), ["node", "top"]).repartition(*tile).sortWithinPartitions(*tile)
    many = dealt.select(*tile, "node", "root", "side", "sig", "n", "others", "bits").mapInPandas(_cross_pairs, "a binary, b binary")
    return few.unionByName(many).distinct()


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, raw."""
    rows = set_rows(docs)
    rep = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "raw")
    nodes = cut_lineage(rows.where("node IS NOT NULL").groupBy("node").agg(F.min(rep).alias("rep"), F.min("sig").alias("sig")))
    live = live_postings(nodes)
    chain = live.where("prev IS NOT NULL").select(F.least("node", "prev").alias("a"), F.greatest("node", "prev").alias("b")).distinct()
    chain = cut_lineage(near_pairs(chain, nodes))
    ends = chain.select("a", "b", "d", F.explode(F.array("a", "b")).alias("end"))
    nearest = ends.withColumn("r", F.row_number().over(Window.partitionBy("end").orderBy("d", "a", "b"))).where(F.col("r") <= NEAREST).select("a", "b").distinct()
    sets = full_sets(docs, nodes.join(live.select("node").distinct().hint("merge"), "node", "left_semi"))
    nearest = cut_lineage(nearest)
    links = confirmed(nearest, sets)
    roots = cut_lineage(components(links))
    rest = remaining_pairs(live, roots, nodes, sets).join(nearest.hint("merge"), ["a", "b"], "left_anti")
    more = confirmed(rest, sets)
    named = nodes.select("node", F.col("rep.doc_id").alias("least")).join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut_lineage(named)
    if more.head(1):  # links between components: the roots are the nodes now
        root = named.select("node", "root").hint("merge")
        ends = more.join(root.toDF("a", "ra"), "a").join(root.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        top = components(ends).toDF("root", "top")
        named = cut_lineage(salted_lookup(named, top, ["root"], F.xxhash64("node")).select("node", "least", F.coalesce("top", "root").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(salted_lookup(named, ids, ["root"], F.xxhash64("node")).select("node", "component_id"))
    out = salted_lookup(rows.select("uid", "doc_id", "raw", "n_shingles", "node"), named, ["node"], F.xxhash64("uid"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "raw")
