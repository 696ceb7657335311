import numpy as np
import pytest

from tablesmith.llm.language import BITS, Model, buckets, identify, predict, train

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(spark, docs):
    rows = identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert not [r for r in rows if r.rejected and r.text and len(r.text) > 40]
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, docs):
    model = train(docs, per_language=50)
    long = "Die der nicht ein und. " * 60000
    data = [(1, None, "x"), (2, "", "x"), (3, " 12 :: \n", "x"), (4, "½ ² ①", "x"), (None, "The the of is by", "x"), (5, long, "x"), (5, long, "x"), (7, "日本", "y")]
    rows = predict(spark.createDataFrame(data, "doc_id long, text string, score string"), model).collect()
    got = {r.doc_id: r for r in rows}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and all(got[i].rejected and got[i].score == 0 for i in (1, 2, 3, 4))
    assert got[5].lang_pred == "de" and got[None].lang_pred in model.languages and len(rows) == 8


def test_slices_cover_a_long_text(monkeypatch):
    import tablesmith.llm.language as language

    text = "Ein Wort und noch eins. " * 50
    whole = np.sort(np.concatenate(list(buckets(text))))
    monkeypatch.setattr(language, "SLICE", 37)
    assert (np.sort(np.concatenate(list(buckets(text)))) == whole).all()


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "def", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(df).collect()} == {"und"}
    assert identify(df.where("doc_id < 0")).collect() == []


def test_long_and_short_confidence():
    table = np.zeros((1 << BITS, 2), np.float32)
    table[:, 0] = 1
    m = Model(["a", "b"], table, np.zeros(2), 1.0, 40.0)
    assert m.chances("ab")[0] < m.chances("ab " * 200)[0]
