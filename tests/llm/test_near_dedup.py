import numpy as np
import pytest

import tablesmith.llm.near_dedup as nd
from tablesmith.llm.components import components
from tablesmith.llm.near_dedup import near_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def sets(text):
    words = [w for w in (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 75 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def check(df, rows):
    got = near_dedup(df)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str) == brute(rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, raw int").repartition(4)


def edited(rng, words, n, vocabulary):
    words = list(words)
    for p in rng.integers(0, len(words), n):
        words[p] = str(rng.choice(vocabulary))
    return " ".join(words)


@pytest.mark.parametrize("block,small", [(4, 2), (1024, 0), (1024, 32)])
def test_groups_and_drift(spark, monkeypatch, block, small):
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    texts = [" ".join(rng.choice(vocabulary, rng.integers(5, 80))) for _ in range(60)]
    for size, copies, edits in ((120, 60, 3), (200, 12, 2), (60, 25, 2), (100, 30, 5)):  # groups around the threshold
        base = rng.choice(vocabulary, size)
        texts += [edited(rng, base, rng.integers(0, edits + 1), vocabulary) for _ in range(copies)]
    drift = rng.choice(vocabulary, 100)  # a long chain: neighbours are near, ends are not
    for _ in range(25):
        texts.append(" ".join(drift))
        drift = edited(rng, drift, 2, vocabulary).split(" ")
    texts += [texts[70]] * 20 + [texts[70].upper()]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    monkeypatch.setattr(nd.remaining_pairs, "__defaults__", (block,))
    monkeypatch.setattr(nd, "SMALL", small)
    check(frame(spark, rows), rows)


def test_odd_rows(spark):
    long = " ".join(f"z{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (None, "a b c d e"), (None, "alone here"), (9, "É x"), (10, "é x"), (11, long), (12, long + " more"), (12, "other text"), (12, "other text"), (13, "b a")]
    check(frame(spark, rows), rows)


def test_empty(spark):
    assert near_dedup(frame(spark, [])).collect() == []


def test_pigeonhole():
    """Signatures within the distance share a key."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, nd.CHUNKS * nd.CHUNK)
        b = a.copy()
        b[rng.choice(len(b), nd.DISTANCE, replace=False)] += 1
        assert any((a[k] == b[k]).all() for k in nd.KEYS)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(300, 400)] + [(0, int(i)) for i in range(500, 800)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1300, (150, 2)) if a != b] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {i: i for p in links for i in p}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: r for i, r in root.items() if i != 7}
