"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text becomes the hashed n-grams (2 to 4 bytes) of its lower-cased UTF-8 bytes, anything between words taken as one blank. Its
vector is the average of their embeddings; a linear softmax gives the languages. Training draws ``per_language`` labelled rows per
language (those with the smallest hash of identifier and text, the documented bound of the sample); executors turn them into bucket
counts, so what reaches the driver is at most ``per_language`` rows of at most ``2 ** bits`` buckets per language. A fifth of the sample is set aside to
calibrate, whole and as small bags of its n-grams, as short texts say less: logits are shrunk by n / (n + n0) for n n-grams and divided
by a temperature, both fitted to it. The rejection threshold is the ``reject`` quantile of the whole texts' confidences, ``most`` at most.

As averaging is linear, prediction needs the product of embeddings and softmax only: a table of 2 ** bits rows, shipped with the tasks
(its size is that bound times the languages). Whole texts are read, long ones in slices that overlap by an n-gram.

Null texts and texts without a letter are ``und`` with score 0 and rejected. Rows that repeat are predicted alike. Without a
labelled row nothing can be learned: all texts are ``und``. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, text_hash

BITS = 15
DIM = 16
PER_LANGUAGE = 600
SLICE = 1 << 20
UNKNOWN = "und"


def _blank() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        if not chr(b).isalpha():
            table[b] = 32
    return table


def buckets(text: str, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, slice by slice."""
    data = _BLANK[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    data = data[np.r_[True, (data[1:] != 32) | (data[:-1] != 32)]] if len(data) else data
    data = np.r_[np.uint8(32), data, np.uint8(32)].astype(np.uint32)
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE + 3]
        h, out = part, []
        for n in (1, 2, 3):
            h = h[:-1] * np.uint32(0x01000193) + part[n:]  # next longer n-gram
            new = h[: SLICE if at + SLICE < len(data) else None]
            out.append(((new ^ (new >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - bits))
        yield np.concatenate(out)


_BLANK = _blank()


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # 2 ** bits x languages: embeddings times softmax
    bias: np.ndarray
    temperature: float = 1.0
    few: float = 0.0
    threshold: float = 0.0

    def chances(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for b in buckets(text, int(len(self.table)).bit_length() - 1):
            total += self.table[b].sum(0, dtype=np.float64)
            n += len(b)
        return softmax((total / max(n, 1) + self.bias) * n / (n + self.few) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` rows of each language, by hash.

    Rows are counted by language first (the languages are the classes of the model, so they are few) and most are dropped by a
    bound on the hash, so no task meets rows from every other task.
    """
    totals = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, (4 * per_language + 100) / n))]) if totals else F.lit(None)
    h = F.xxhash64("doc_id", "text")
    some = labelled.where(h.cast("double") <= (share[F.col("lang")] * 2.0**64 - 2.0**63)) if totals else labelled
    w = Window.partitionBy("lang").orderBy(h, "doc_id", "text")
    return some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_language).drop("_n")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for lang, h, text in zip(b["lang"], b["h"], b["text"]):
            n = sum(np.bincount(x, minlength=1 << BITS) for x in buckets(text))
            ids = np.flatnonzero(n)
            out.append((lang, h, int(n.sum()), ids.astype("<u2").tobytes(), (n[ids] / n.sum()).astype("<f4").tobytes()))
        yield pd.DataFrame(out, columns=["lang", "h", "n", "ids", "shares"])


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = 6, rate: float = 2.0, batch: int = 16, reject: float = 0.001, most: float = 0.35) -> Model:
    """Fits the model to rows (doc_id, text, lang); texts without a letter teach nothing."""
    rows = sample(labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")), per_language)
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").mapInPandas(_counts, "lang string, h long, n long, ids binary, shares binary")
    data = sorted(rows.collect(), key=lambda r: (r["h"], r["lang"]))
    languages = sorted({r["lang"] for r in data})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    y = np.array([languages.index(r["lang"]) for r in data])
    x = [(np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["shares"], "<f4")) for r in data]
    rng = np.random.default_rng(7)
    aside = np.arange(len(data)) % 5 == 4
    use = np.flatnonzero(~aside)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps, step = epochs * (len(use) // batch + 1), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(use), max(1, len(use) // batch)):
            pace = rate * (1 - step / (steps + 1))
            step += 1
            v = np.stack([s @ emb[i] for i, s in (x[k] for k in part)])
            g = softmax(v @ w + bias)
            g[np.arange(len(part)), y[part]] -= 1
            g /= len(part)
            gv = g @ w.T
            w -= pace * v.T @ g
            bias -= pace * g.sum(0) * 0.1
            for k, d in zip(part, gv):
                i, s = x[k]
                emb[i] -= (pace * 200) * s[:, None] * d  # shares are small, so buckets take longer steps
    model = Model(languages, (emb @ w).astype(np.float32), bias.astype(np.float64))
    held = [k for k in np.flatnonzero(aside)] or list(use)
    bags = [(x[k][0], x[k][1], data[k]["n"], y[k]) for k in held]
    for k in held:  # small bags of the same texts
        ids, shares = x[k]
        size = int(np.exp(rng.uniform(1, 5)))
        picked = rng.choice(len(ids), size, p=shares.astype(float) / shares.astype(float).sum())
        bags.append((ids[picked], np.full(size, 1 / size, np.float32), size, y[k]))
    z = np.stack([s @ model.table[i] for i, s, _, _ in bags]) + model.bias
    n, truth = np.array([b[2] for b in bags], float)[:, None], np.array([b[3] for b in bags])

    def loss(t, few):
        return -np.log(softmax(z * n / (n + few) / t)[np.arange(len(z)), truth] + 1e-12).mean()

    model.temperature, model.few = min(((t, few) for t in np.geomspace(0.1, 10, 21) for few in (0, 5, 15, 40, 100, 250, 600)), key=lambda p: loss(*p))
    sure = softmax(z * n / (n + model.few) / model.temperature).max(1)[: len(held)]
    model.threshold = float(min(most, np.quantile(sure, reject)))
    return model


def predict(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """doc_id, raw (hash of the text), ``carried`` columns, lang_pred, score, rejected."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b.pop("text"):
                if text is None or not model.languages or not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                p = model.chances(text)
                best = int(p.argmax())
                out.append((model.languages[best], float(p[best]), bool(p[best] < model.threshold)))
            b[["lang_pred", "score", "rejected"]] = pd.DataFrame(out, columns=["lang_pred", "score", "rejected"], index=b.index)
            yield b

    rows = docs.select("doc_id", *carried, text_hash(F.col("text")).alias("raw"), "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    rows = rows.select("doc_id", *carried, "raw", "text")
    return rows.mapInPandas(run, schema + ", lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """The rows whose label is never learned from; a null identifier counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Trains on the rows that are not held out and predicts every row: doc_id, held_out, raw, lang_pred, score, rejected."""
    rows = only(docs, doc_id="doc_id", text="text", lang="lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(rows.where("NOT held_out"), per_language)
    return predict(rows, model, "held_out")
