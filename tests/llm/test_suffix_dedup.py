import hashlib
from collections import Counter

import numpy as np
import pytest

from tablesmith.llm.queries import ORACLES, QUERIES
from tablesmith.llm.suffix_dedup import anchors, multikey_sort, sliding_min, suffix_dedup
from tests.oracle import connect, difference

SCHEMA = "doc_id long, text string, start string, id int"
SMALL = {"length": 20, "gram": 4, "lead": 6, "rows_per_bucket": 60, "step": 300, "block": 900}


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        edge = np.diff(gone)
        runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        out.append((len(r), runs, bytes(b for b, g in zip(r, gone[1:]) if not g)))
    return out


def check(spark, texts, length=20, **sizes):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in suffix_dedup(df, **{**SMALL, "length": length, **sizes}).collect()}
    assert got == dict(enumerate(brute(texts, length)))


def corpus(rng, n=120):
    words = ["ab", "cde", "f", "ghij", "élan", "日本", "k", "  ", "\n", "zz"]
    say = lambda k: " ".join(rng.choice(words, k))
    shared = [say(12) for _ in range(4)]
    texts = [say(rng.integers(0, 30)) + shared[rng.integers(0, 4)] * rng.integers(0, 2) + say(rng.integers(0, 20)) for _ in range(n)]
    base = say(60)
    texts += [base[:k] + "#" + base[k:] for k in rng.integers(0, len(base), 15)]  # near copies
    texts += [base] * 5 + [f"{i} common line of all documents {i * 7}" for i in range(60)]
    return texts


@pytest.mark.parametrize("sizes", [{}, {"rows_per_bucket": 100_000}, {"rows_per_bucket": 12, "step": 90, "block": 100}, {"length": 21, "gram": 8}])
def test_against_all_windows(spark, sizes):
    check(spark, corpus(np.random.default_rng(7)), **sizes)


def test_random_bytes_and_runs(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 60))) for _ in range(80)]
    texts += ["=" * 300, "=" * 19, "=" * 20, "xy" * 100, "\0" * 50, "a\0" + "\0" * 18, "abc" * 30 + "\0"]
    check(spark, texts, rows_per_bucket=25)


def test_odd_rows(spark):
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(30000))
    check(spark, [None, "", " ", "short", long, long[5000:5100], "é" * 10, "é" * 10, "x" * 19, "once only, and long enough"], rows_per_bucket=2000, step=4000, block=9000)
    rows = [(None, "no identifier, but a text", "x", 1)] * 2 + [(5, "no identifier, but a text", "x", 1), (6, None, None, None)]
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), **SMALL).collect()
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.kept)) for r in got) == [("5", 25, b""), ("6", 0, b""), ("None", 25, b""), ("None", 25, b"")]
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_line(spark):
    """A line in every text is shorter than the length: its suffixes fill many buckets and nothing goes."""
    rng = np.random.default_rng(4)
    texts = [f"{''.join(rng.choice(list('abcdefgh'), 9))}the line that all have{''.join(rng.choice(list('ijklmnop'), 9))}" for _ in range(500)]
    check(spark, texts + texts[:2], length=24, rows_per_bucket=20)


def test_sort_and_anchors():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, (400, 16)).astype(np.uint8)
    order, shared = multikey_sort(rows)
    want = sorted(map(bytes, rows))
    assert [bytes(r) for r in rows[order]] == want
    for a, b, n in zip(want, want[1:], shared[1:]):
        assert a[:n] == b[:n] and (n == 16 or a[n] != b[n])
    v = rng.integers(0, 50, 103).astype(np.uint64)
    assert sliding_min(v, 7).tolist() == [v[i : i + 7].min() for i in range(97)]
    data = bytes(rng.integers(97, 100, 500).astype(np.uint8))
    text, first, n, at = anchors(data, np.array([0, 10, 200]), np.array([10, 200, 500]), 20, 4)
    assert n.sum() == 171 + 281 and set(text) == {1, 2}
    assert all(f + k - 1 <= x <= f + 16 for f, k, x in zip(first, n, at))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_suffix_dedup"](spark, sf)
    assert difference(got, connect(sf), ORACLES["op11_suffix_dedup"]) is None


def test_query_against_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = brute([r.text for r in docs], 200)
    got = {r.doc_id: r for r in QUERIES["op11_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()}
    for r, (n, runs, kept) in zip(docs, want):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
