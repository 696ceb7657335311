"""Two tokenizers' tokens of the same text, aligned by bytes and linked, with corpus-wide counts of linked ids.

Texts are tokenised whole by a byte-level BPE (A, on space + text) and a sentence-piece BPE (B, which adds the space itself). Byte offsets at which
a token ends and the next begins with a space are candidates for anchors; those that both token rows share are verified ends and cut a
text into windows of a word or so. A window's groups and links depend on its two tuples of ids alone, so they are worked out once
per tuple pair and worker and looked up after that. Groups are cut where tokens of both rows end; a link is a pair of tokens that share bytes.

Counts of linked id pairs (how many documents hold them) are summed per block of texts first. A block keeps its distinct pairs and each
document points to them, so what is looked up in the corpus-wide counts are a block's distinct pairs, not those of every document.

Scale: tasks hold one block of about ``BLOCK`` bytes of text (a longer text is a block of its own); a pair is looked up once per block; the
window over an A id has at most as many rows as B has ids. Nothing is collected to the driver.

Defined cases: texts that are null, empty or not reproduced by the joined bytes of either row have no tokens: zeros, empty groups. Repeated
rows are documents of their own and counted each. Special tokens' strings are plain text. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_path
from .common import only, per_worker

BLOCK = 2_500_000
#: windows kept per worker; windows of more tokens are not kept
MAX_WINDOWS, MAX_TOKENS = 200_000, 64
#: between the ids of A and of B in a window's key; no id has this value
BETWEEN = b"\xff\xff\xff\xff"
#: characters of a run without a word boundary from which on the slower engine takes a text
RUN = 1_000


def spelt_bytes() -> dict[str, int]:
    """Byte of each character by which byte-level vocabularies spell it."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids of a byte-level BPE file. Merges go by rank, which is the id, so the faster engine gets the file's own vocabulary.

    Runs without a word boundary go to the engine whose time does not grow with the square of a run.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte = spelt_bytes()
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
        self.path, self.slow = path, None
        self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def _long(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    @staticmethod
    def runs(text: str) -> bool:
        """Whether a text has a long run of white space or of anything else."""
        if len(text) < RUN:
            return False
        sizes = list(map(len, text.split()))
        return max(sizes, default=0) >= RUN or (len(text) - sum(sizes) >= RUN and re.search(rf"\s{{{RUN}}}", text) is not None)

    def ids(self, texts: list[str]) -> list[list[int]]:
        fast = self.fast.encode_ordinary
        return [self._long(t) if self.runs(t) else fast(t) for t in texts]

    def spell(self, ids: list[int]) -> bytes:
        return self.fast.decode_bytes(ids)


class Pieces:
    """Ids of a sentence-piece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in range(n))]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


class Aligner:
    """Token rows of blocks of texts, and the worker's windows."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = (np.array([len(t) for t in v.bytes], np.int64) for v in (self.a, self.b))
        self.space_a, self.space_b = (np.array([t[:1] == b" " for t in v.bytes]) for v in (self.a, self.b))
        # a token's text in the groups: inside a group, or as the last of its side
        a, b = range(len(self.size_a)), range(len(self.size_b))
        self.said = [f"{i}," for i in a] + [f"{i}|" for i in a] + [f"{i}," for i in b] + [f"{i};" for i in b]
        self.said_size = np.array([len(x) for x in self.said], np.int64)
        self.forget()

    def forget(self) -> None:
        self.windows: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.n_groups = self.n_links = self.links = self.pair = np.zeros(0, np.int64)
        self.pairs: dict[int, int] = {}

    def learn(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> None:
        """Groups and links of windows, given their tokens in a row and how many of them each has; both rows spell the same bytes."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        of = np.repeat(np.arange(len(in_a)), in_a)
        # the tokens of B that share bytes with a token of A
        low, high = np.searchsorted(end_b, end_a - self.size_a[a], "right"), np.searchsorted(end_b, end_a)
        count = high - low + 1
        pair = (np.repeat(a, count).astype(np.int64) << 32) | b[_ranges(low, count)]
        known, place = np.unique(pair, return_inverse=True)
        numbers = np.array([self.pairs.setdefault(p, len(self.pairs)) for p in known.tolist()], np.int64)
        if len(self.pairs) > len(self.pair):
            self.pair = np.fromiter(self.pairs, np.int64, len(self.pairs))
        self.links = np.r_[self.links, numbers[place]]
        self.n_links = np.r_[self.n_links, np.bincount(of, count, len(in_a)).astype(np.int64)]
        # groups end where both rows have an end
        both_a, both_b = end_b[high] == end_a, end_a[np.searchsorted(end_a, end_b)] == end_b
        self.n_groups = np.r_[self.n_groups, np.bincount(of, both_a, len(in_a)).astype(np.int64)]
        group = np.r_[2 * (np.cumsum(both_a) - both_a), 2 * (np.cumsum(both_b) - both_b) + 1]
        size_a, size_b = len(self.size_a), len(self.size_b)
        code = np.r_[a + size_a * both_a, 2 * size_a + b + size_b * both_b][np.argsort(group, kind="stable")]
        text = "".join(map(self.said.__getitem__, code.tolist()))
        stops = np.cumsum(self.said_size[code])[np.cumsum(in_a + in_b) - 1].tolist()
        self.groups += [text[x : y - 1] for x, y in zip([0, *stops], stops)]

    @staticmethod
    def cuts(ids: np.ndarray, last: np.ndarray, size: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets at which a token ends before one with a space (or its text ends), and how many tokens are done there."""
        at = space[np.r_[ids[1:], 0]]
        at[last - 1] = True
        done = np.flatnonzero(at) + 1
        return np.cumsum(size[ids])[done - 1], done

    def block(self, texts: list[str | None]):
        """Per text (n_a, n_b, n_groups, n_links, groups, places, times), and the block's pairs (a, b, documents)."""
        if len(self.groups) > MAX_WINDOWS:
            self.forget()
        raws = [(" " + t).encode() if t else b"" for t in texts]
        asked = [i for i, r in enumerate(raws) if r]
        a = self.a.ids([" " + texts[i] for i in asked])
        b = self.b.ids([texts[i] for i in asked])
        join, spelt = b"".join, self.b.bytes.__getitem__
        good = [k for k, i in enumerate(asked) if join(map(spelt, b[k])) == raws[i] == self.a.spell(a[k])]
        del raws
        out: list[tuple] = [(0, 0, 0, 0, "", b"", b"")] * len(texts)
        if not good:
            return out, np.zeros((3, 0), np.int64)
        last_a, last_b = np.cumsum([len(a[k]) for k in good]), np.cumsum([len(b[k]) for k in good])
        flat_a, flat_b = (np.fromiter(chain.from_iterable([rows[k] for k in good]), np.uint32, n) for rows, n in ((a, last_a[-1]), (b, last_b[-1])))
        sizes = [(len(x), len(y)) for x, y in zip(a, b)]
        del a, b
        # texts of equal total length in both rows follow one another, so offsets stay comparable
        at_a, done_a = self.cuts(flat_a, last_a, self.size_a, self.space_a)
        at_b, done_b = self.cuts(flat_b, last_b, self.size_b, self.space_b)
        _, in_a, in_b = np.intersect1d(at_a, at_b, assume_unique=True, return_indices=True)
        stop_a, stop_b = done_a[in_a], done_b[in_b]
        raw_a, raw_b, known = flat_a.tobytes(), flat_b.tobytes(), self.windows
        seen, new, next_one = [], [], len(self.groups)
        s = t = 0
        for n, (e, f) in enumerate(zip((4 * stop_a).tolist(), (4 * stop_b).tolist())):
            key = raw_a[s:e] + BETWEEN + raw_b[t:f]
            w = known.get(key)
            if w is None:
                w = next_one
                next_one += 1
                new.append(n)
                if len(key) <= 4 * MAX_TOKENS:
                    known[key] = w
            seen.append(w)
            s, t = e, f
        if new:
            more_a, more_b = np.diff(stop_a, prepend=0)[new], np.diff(stop_b, prepend=0)[new]
            self.learn(flat_a[_ranges(stop_a[new] - more_a, more_a)], flat_b[_ranges(stop_b[new] - more_b, more_b)], more_a, more_b)
        win = np.array(seen)
        firsts = np.r_[0, np.searchsorted(stop_a, last_a[:-1], "right")]  # each text's first window
        lasts = [*firsts[1:].tolist(), len(win)]
        links_of, groups_of = np.add.reduceat(self.n_links[win], firsts), np.add.reduceat(self.n_groups[win], firsts)
        # pair numbers of all links, in a row
        count = self.n_links[win]
        which = self.links[_ranges((np.cumsum(self.n_links) - self.n_links)[win], count)]
        text = np.repeat(np.arange(len(good)), links_of)
        both, times = np.unique(text * len(self.pairs) + which, return_counts=True)
        text, which = both // len(self.pairs), both % len(self.pairs)
        used, place, documents = np.unique(which, return_inverse=True, return_counts=True)
        pairs = self.pair[used]
        cut = np.flatnonzero(np.diff(text)) + 1
        words = self.groups
        for g, (k, places, n) in enumerate(zip(good, np.split(place, cut), np.split(times, cut))):
            step = np.diff(places, prepend=0)
            said = ";".join([words[w] for w in seen[firsts[g] : lasts[g]]])
            out[asked[k]] = (*sizes[k], int(groups_of[g]), int(links_of[g]), said, _packed(step), _packed(n))
        return out, np.vstack([pairs >> 32, pairs & 0xFFFFFFFF, documents])


def _packed(v: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as all of them fit in, told by the first byte."""
    width = 1 if v.max() < 256 else 2 if v.max() < 65536 else 4
    return bytes([width]) + v.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64) if raw else np.zeros(0, np.int64)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), n_best, count_sum.

    ``groups`` is what is kept of that column, an expression over the columns before it; by default all of it.
    """
    import public_tokenizers

    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    rows = only(docs, doc_id="doc_id", text="text")
    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # with nulls pandas would make numbers floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        aligner = per_worker(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        names = ["n_a", "n_b", "n_groups", "n_links", "groups", "places", "times"]
        n = TaskContext.get().partitionId() << 32
        for b in batches:
            sizes = b["text"].str.len().fillna(0).cumsum()
            for _, part in b.groupby((sizes // block).astype(int), sort=False):
                found, pairs = aligner.block([None if x is None or x != x else x for x in part["text"]])
                out = pd.DataFrame(found, columns=names, index=part.index).assign(doc_id=part["doc_id"], block=n, pairs=None)
                yield out
                if pairs.shape[1]:
                    yield pd.DataFrame({"doc_id": [None], "block": [n], "pairs": [pairs.astype("<u4").tobytes()], **{c: [None] for c in names}})
                n += 1

    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, places binary, times binary, block long, pairs binary"
    made = rows.mapInPandas(run, schema)
    if groups is not None:
        made = made.withColumn("groups", F.when(F.col("pairs").isNull(), groups))
    path = new_path(spark, "alignment")
    made.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(made.schema).parquet(path)

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, raw in zip(b["block"], b["pairs"]):
                x, y, documents = np.frombuffer(raw, "<u4").reshape(3, -1).astype(np.int64)
                yield pd.DataFrame({"block": n, "place": np.arange(len(x)), "a": x, "b": y, "documents": documents})

    pairs = made.where("pairs IS NOT NULL").select("block", "pairs").mapInPandas(unfold, "block long, place int, a int, b int, documents long")
    counts = pairs.groupBy("a", "b").agg(F.sum("documents").alias("count"))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))
    told = pairs.select("block", "place", "a", "b").join(counts.hint("shuffle_merge"), ["a", "b"]).select(F.col("block").alias("in"), "place", "count", "best")

    def score(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        count, best = np.zeros(len(told), np.int64), np.zeros(len(told), np.int64)
        count[told["place"]], best[told["place"]] = told["count"], told["best"]
        out = []
        for places, times in zip(own["places"], own["times"]):
            at, n = np.cumsum(_unpacked(places)), _unpacked(times)
            out.append((int((best[at] * n).sum()), int((count[at] * n).sum())))
        own[["n_best", "count_sum"]] = pd.DataFrame(out, columns=["n_best", "count_sum"], index=own.index)
        return own.drop(columns=["places", "times", "block"])

    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    own = made.where("pairs IS NULL").select(*columns, "places", "times", "block")
    scored = own.groupBy("block").cogroup(told.groupBy("in")).applyInPandas(score, "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))
