"""Word vectors by skip-gram with negative sampling (Mikolov et al., 2013), trained on all cores.

Every pair of words at most ``WINDOW`` apart takes part in every pass, with the share of passes in which word2vec's shrinking window would hold it.
Words travel as numbers, made once. A task trains a copy of the vectors on a bounded number of words; after each pass the copies are
averaged, each word over the copies that saw it. Steps are taken for some thousand words at once, by matrix operations, and are scaled
word by word with the gradients so far (AdaGrad), so a frequent word does not overshoot. All words of a step share
their draws of noise. Runs repeat exactly as long as the table is split in the same way.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: words on each side, draws of noise a pair, power of a word's count in the noise, as in word2vec; words of a text that are trained together
WINDOW, NOISE, POWER, SENTENCE = 5, 5, 0.75, 1_000
#: words that a copy is trained on, words and draws of noise of a step, size of a first step
WORDS_PER_COPY, STEP, DRAWS, RATE = 8_000_000, 4_096, 32, 0.1
#: words whose pairs are one matrix, words whose vectors travel as one row
TILE, BLOCK = 16, 512


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts in a row, and how many each has."""
    split = [t.split() if t else [] for t in texts.to_pylist()]
    return pa.array(list(chain.from_iterable(split)), pa.string()), np.fromiter(map(len, split), dtype=np.int64, count=len(split))


def _numbers(texts: pa.Array, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the known words of some texts in a row, and where each text's begin and the last one's end."""
    words, lengths = _words(texts)
    found = pc.index_in(words, value_set=vocab)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    numbers = found.fill_null(0).to_numpy().astype(np.int32)[known]
    return numbers, np.r_[0, np.cumsum(known)][np.r_[0, np.cumsum(lengths)]]


def vocabulary(texts: DataFrame, column: str, min_count: int) -> tuple[pa.Array, np.ndarray]:
    """Words that occur ``min_count`` times and more with their counts, the most frequent first."""

    def run(batches):
        for batch in batches:
            counts = _words(batch.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["word", "n"])

    counts = texts.select(column).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    found = counts.toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    if not found.num_rows:
        raise ValueError(f"no word occurs {min_count} times")
    return pa.chunked_array(found["word"].chunks, pa.string()).combine_chunks(), found["n"].to_numpy()


def numbered(texts: DataFrame, column: str, vocab) -> DataFrame:
    """``(ids)``: the known words of texts as numbers, in pieces of at most SENTENCE words."""

    def run(batches):
        for batch in batches:
            numbers, edges = _numbers(batch.column(0), vocab.value)
            found = [numbers[i : min(i + SENTENCE, b)].tobytes() for a, b in zip(edges[:-1], edges[1:]) for i in range(a, b, SENTENCE)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    return texts.select(column).mapInArrow(run, "ids binary")


def sums_of_vectors(texts: DataFrame, key: str, column: str, vocab, vectors, size: int) -> DataFrame:
    """``(key, _n, _v0, _v1, ..)``: how many words of a text are known, and the sums of their vectors; texts without one are left out."""
    names = ["_n", *[f"_v{i}" for i in range(size)]]

    def run(batches):
        for batch in batches:
            numbers, edges = _numbers(batch.column(1), vocab.value)
            have = np.flatnonzero(np.diff(edges))
            sums = np.add.reduceat(vectors.value[numbers].astype(float), edges[have], axis=0) if len(have) else np.zeros((0, size))
            columns = [batch.column(0).take(pa.array(have)), pa.array(np.diff(edges)[have]), *[pa.array(sums[:, i]) for i in range(size)]]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *names])

    schema = T.StructType([texts.schema[key], T.StructField("_n", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names[1:]]])
    return texts.select(key, column).mapInArrow(run, schema)


# ---- a step


def _windows(rows: np.ndarray, blocks: int) -> np.ndarray:
    """The rows of each block of TILE words and of WINDOW words on both sides of it, as a view."""
    down, along = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (blocks, TILE + 2 * WINDOW, rows.shape[1]), (TILE * down, down, along))


#: weight of a pair by the places of its words in a block and in the block's window
_NEAR = np.array([[max(0, WINDOW + 1 - abs(j - WINDOW - i)) / WINDOW * (j != i + WINDOW) for j in range(TILE + 2 * WINDOW)] for i in range(TILE)], dtype=np.float32)


def _pairs(rows: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of all pairs and the weight of each word's pairs; a row is a word's vector, then its vector as context."""
    n, blocks = len(rows), -(-len(rows) // TILE)
    x = np.zeros((blocks * TILE, size), dtype=np.float32)
    x[:n] = rows[:, :size]
    u = np.zeros((blocks * TILE + 2 * WINDOW, size), dtype=np.float32)
    u[WINDOW : WINDOW + n] = rows[:, size:]
    of = np.full((len(u), 1), -1, dtype=np.int32)
    of[WINDOW : WINDOW + n, 0] = text
    x, around, others = x.reshape(blocks, TILE, size), _windows(u, blocks), _windows(of, blocks)
    near = (others[:, WINDOW : WINDOW + TILE] == others.transpose(0, 2, 1)) * _NEAR
    pull = x @ around.transpose(0, 2, 1)
    np.exp(pull, out=pull)
    pull += 1
    np.divide(near, pull, out=pull)
    to_x, to_u = (pull @ around).reshape(-1, size), pull.transpose(0, 2, 1) @ x
    g = np.zeros((blocks + 1, TILE, 2 * size), dtype=np.float32)
    g[:-1, :, size:] = to_u[:, :TILE]
    g[1:, : 2 * WINDOW, size:] += to_u[:, TILE:]  # a window reaches into the next block
    g = g.reshape(-1, 2 * size)
    g[WINDOW : WINDOW + len(to_x), :size] = to_x
    return g[WINDOW : WINDOW + n], near.sum(axis=2).ravel()[:n]


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that start at ``first``."""
    out, last = rows.take(first, axis=0), np.r_[first[1:], len(rows)]
    longer = last - first > 1
    if longer.any():
        edges = np.c_[first, last][longer].ravel()
        out[longer] = np.add.reduceat(rows, edges[:-1] if edges[-1] == len(rows) else edges, axis=0)[::2]
    return out


def step(state: np.ndarray, ids: np.ndarray, text: np.ndarray, drawn: np.ndarray, size: int) -> None:
    """Moves the vectors of some texts' words, and of the noise drawn, in ``state``: vector, vector as context, squared gradients so far of both."""
    rows = state.take(ids, axis=0)[:, : 2 * size]
    g, total = _pairs(rows, text, size)
    drawn, times = np.unique(drawn, return_counts=True)
    x, away = rows[:, :size], state[drawn, size : 2 * size]
    push = x @ away.T
    np.exp(-push, out=push)
    push += 1
    np.divide(total[:, None] * (times * (NOISE / DRAWS)).astype(np.float32), push, out=push)
    g[:, :size] -= push @ away
    back = -(push.T @ x)
    order = np.argsort(ids)
    first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    sums = _sums(g.take(order, axis=0), first)
    _move(state, ids[order][first], sums, size, (0, 1))
    _move(state, drawn, np.hstack([np.zeros_like(back), back]), size, (1,))


def _move(state: np.ndarray, words: np.ndarray, g: np.ndarray, size: int, halves: tuple[int, ...]) -> None:
    """A step along a gradient a word (the words are distinct), scaled by all its gradients so far."""
    rows = state.take(words, axis=0)
    for half in halves:
        mine, far = slice(half * size, (half + 1) * size), 2 * size + half
        rows[:, far] += np.einsum("ij,ij->i", g[:, mine], g[:, mine]) / size
        rows[:, mine] += g[:, mine] * (RATE / np.sqrt(rows[:, far] + 1e-12))[:, None]
    state[words] = rows


# ---- passes over the table


def _trained(sentences: DataFrame, state, noise, size: int, seed: int, turn: int) -> DataFrame:
    """``(block, words, rows)``: the vectors that a task has moved, and whether it has moved either of them."""

    def run(batches):
        texts = [np.frombuffer(ids.as_buffer(), dtype=np.int32) for batch in batches for ids in batch.column(0)]
        if not texts:
            return
        words, text = np.concatenate(texts), np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])
        rng = np.random.default_rng([seed, turn, TaskContext.get().partitionId()])
        drawn = np.searchsorted(noise.value, rng.random((-(-len(words) // STEP), DRAWS)) * noise.value[-1], side="right").astype(np.int32)
        # the task holds only vectors that it moves
        met = np.zeros((len(state.value), 2), dtype=bool)
        met[words] = True
        met[drawn.ravel(), 1] = True
        here = np.flatnonzero(met[:, 1]).astype(np.int32)
        place = np.zeros(len(met), dtype=np.int32)
        place[here] = np.arange(len(here))
        mine, words, drawn = state.value[here], place[words], place[drawn]
        with np.errstate(over="ignore"):
            for i, noise_words in enumerate(drawn):
                part = slice(i * STEP, (i + 1) * STEP)
                step(mine, words[part], text[part], noise_words, size)
        rows = np.hstack([mine, met[here]]).astype(np.float32)
        for part in np.split(np.arange(len(here)), np.flatnonzero(np.diff(here // BLOCK)) + 1):
            start = here[part[0]] // BLOCK * BLOCK
            one = {"block": pa.array([start], pa.int64()), "words": pa.array([(here[part] - start).tobytes()]), "rows": pa.array([rows[part].tobytes()])}
            yield pa.RecordBatch.from_pydict(one)

    return sentences.mapInArrow(run, "block bigint, words binary, rows binary")


def _averaged(copies: DataFrame, size: int) -> DataFrame:
    """The mean of each vector over the copies that moved it, and how many these are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((BLOCK, 2 * size + 4))
        for words, rows in zip(pdf["words"], pdf["rows"]):
            rows = np.frombuffer(rows, dtype=np.float32).reshape(-1, out.shape[1])
            at = np.frombuffer(words, dtype=np.int32)
            one, two = rows[:, -2:-1], rows[:, -1:]
            out[at] += np.hstack([rows[:, :size] * one, rows[:, size : 2 * size] * two, rows[:, 2 * size : 2 * size + 1] * one, rows[:, 2 * size + 1 : 2 * size + 2] * two, one, two])
        for flag, columns in ((-2, [*range(size), 2 * size]), (-1, [*range(size, 2 * size), 2 * size + 1])):
            out[:, columns] /= np.maximum(out[:, flag], 1)[:, None]
        return pd.DataFrame({"block": pdf["block"][:1], "rows": [out.astype(np.float32).tobytes()]})

    # copies come in any order; sums of their order would differ in the last digit
    return copies.groupBy("block").applyInPandas(lambda pdf: run(pdf.sort_values("rows")), "block bigint, rows binary")


def train(texts: DataFrame, column: str, size: int, min_count: int, seed: int, epochs: int) -> DataFrame:
    """``(word, vector)`` of the words, parts between white space, that occur ``min_count`` times and more in a text column."""
    spark = texts.sparkSession
    sc = spark.sparkContext
    vocab, counts = vocabulary(texts, column, min_count)
    known = sc.broadcast(vocab)
    copies = int(counts.sum()) // WORDS_PER_COPY + 1
    sentences = cut_lineage(numbered(texts, column, known).repartition(copies).sortWithinPartitions(F.xxhash64("ids"), "ids"))
    state = np.zeros((len(vocab), 2 * size + 2), dtype=np.float32)
    state[:, :size] = (np.random.default_rng(seed).random((len(vocab), size)) - 0.5) / size
    noise = sc.broadcast(np.cumsum(counts.astype(float) ** POWER))
    for turn in range(epochs):
        now = sc.broadcast(state)
        found = _averaged(_trained(sentences, now, noise, size, seed, turn), size).toArrow()
        state = state.copy()
        for start, rows in zip(found["block"].to_pylist(), found["rows"]):
            new = np.frombuffer(rows.as_buffer(), dtype=np.float32).reshape(BLOCK, -1)[: len(state) - start]
            for flag, columns in ((-2, [*range(size), 2 * size]), (-1, [*range(size, 2 * size), 2 * size + 1])):
                moved = np.flatnonzero(new[:, flag])
                state[np.ix_(start + moved, columns)] = new[np.ix_(moved, columns)]
        now.destroy()
    known.destroy()
    noise.destroy()
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(state[:, :size].astype(float).ravel()), size).cast(pa.list_(pa.float64()))
    return spark.createDataFrame(pa.table({"word": vocab, "vector": vectors}))
