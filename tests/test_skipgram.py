import numpy as np
import pytest

from tablesmith.functions import skipgram
from tablesmith.operators import text


def test_pairs_against_each_pair():
    rng, size = np.random.default_rng(3), 4
    rows, of = rng.random((53, 2 * size), dtype=np.float32) - 0.5, np.repeat([0, 1, 2, 3], [20, 1, 30, 2])
    g, total = skipgram._pairs(rows, of, size)
    want, weights = np.zeros(rows.shape), np.zeros(len(rows))
    for i in range(len(rows)):
        for j in range(max(0, i - skipgram.WINDOW), min(len(rows), i + skipgram.WINDOW + 1)):
            if i != j and of[i] == of[j]:
                w = (skipgram.WINDOW + 1 - abs(i - j)) / skipgram.WINDOW
                pull = w / (1 + np.exp(rows[i, :size] @ rows[j, size:]))
                want[i, :size] += pull * rows[j, size:]
                want[j, size:] += pull * rows[i, :size]
                weights[i] += w
    assert np.abs(g - want).max() < 1e-5 and np.abs(total - weights).max() < 1e-5


def test_sums_of_runs():
    rows, first = np.arange(24, dtype=np.float32).reshape(8, 3), np.array([0, 1, 4, 6, 7])
    want = np.stack([x.sum(axis=0) for x in np.split(rows, first[1:])])
    assert (skipgram._sums(rows, first) == want).all()
    assert (skipgram._sums(rows, np.array([0, 3])) == np.stack([rows[:3].sum(axis=0), rows[3:].sum(axis=0)])).all()


@pytest.fixture(scope="module")
def two_topics(spark):
    rng = np.random.default_rng(5)
    kinds = [[f"{k}{i}" for i in range(20)] for k in "ab"]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 30))) for i in range(600)]
    return spark.createDataFrame([*rows, (600, None), (601, ""), (602, "rare words only"), (603, "A1 b1")], "id int, t string").repartition(3).cache()


def test_texts_are_cut_into_copies_by_words(spark, two_topics, monkeypatch):
    """Few long texts made one copy, trained by one task; now the number of words decides."""
    monkeypatch.setattr(skipgram, "WORDS_PER_COPY", 5_000)
    seen = []
    made = skipgram._trained
    monkeypatch.setattr(skipgram, "_trained", lambda sentences, *a: seen.append(sentences.rdd.getNumPartitions()) or made(sentences, *a))
    found = {r["word"]: np.array(r["vector"]) for r in text.word_vectors(two_topics, "t", 8, 5).collect()}
    assert seen == [18_002 // 5_000 + 1] * 5
    assert sorted(found) == sorted(f"{k}{i}" for k in "ab" for i in range(20))
    unit = {w: v / np.linalg.norm(v) for w, v in found.items()}
    near = {w: max((x for x in unit if x != w), key=lambda x: unit[x] @ v) for w, v in unit.items()}
    assert all(w[0] == x[0] for w, x in near.items())
    again = {r["word"]: np.array(r["vector"]) for r in text.word_vectors(two_topics, "t", 8, 5).collect()}
    assert all((found[w] == again[w]).all() for w in found)


def test_words_are_those_of_the_step(spark):
    df = spark.createDataFrame([(1, "Ab aB  c\x1cAB c C"), (2, None)], "id int, t string")
    vocab, counts = skipgram.vocabulary(df.selectExpr("lower(t) AS t"), "t", 1)
    assert dict(zip(vocab.to_pylist(), counts.tolist())) == {"ab": 3, "c": 3}
    with pytest.raises(ValueError, match="occurs 4 times"):
        skipgram.vocabulary(df, "t", 4)


def test_held_and_shuffled_vectors_agree(spark, two_topics, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(f"{k}{i}", rng.random(3).tolist()) for k in "ab" for i in range(15)], "word string, vector array<double>")

    def means():
        out = text.mean_vectors(two_topics, "t", "id", text.vector_tables(two_topics, "t", vectors), 3)
        return out, {r["id"]: r["t_embedding"] for r in out.collect()}

    held, one = means()
    assert "MapInArrow" in held._jdf.queryExecution().toString()
    monkeypatch.setattr(text, "HELD_NUMBERS", 10)
    shuffled, two = means()
    assert "MapInArrow" not in shuffled._jdf.queryExecution().toString()
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-12) for k in one)
    assert one[600] == one[602] == [0.0] * 3
