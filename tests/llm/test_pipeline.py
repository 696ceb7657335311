import re

import pytest

import corpus_pipeline
from tablesmith.llm.mixing import mix
from tests.llm.test_near_dedup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    """Small documents: one hot text, near copies, odd rows, a clashing column."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 4000").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, True) for r in base]
    long = max(rows, key=lambda r: r[4])[1]
    rows += [(5000 + i, rows[3][1] + " " * (i % 2), "en", "hot", 1, None) for i in range(60)]
    rows += [(6000 + i, long + f" tail{i}", "en", "src1", 1, False) for i in range(10)]
    rows += [(7000, None, None, None, None, None), (7001, "", "en", "a", 0, None), (7002, "1234 !!", "en", "a", 7, None), (None, "The by the of " + long, "en", "b", 1, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_stages_one_by_one(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "source_mix", "packing"]
    at = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = at.collect()
        stage(spark, at, "unused").write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        after = at.collect()
        if i < 4:
            assert at.columns == docs.columns and set(after) <= set(before)
        if name == "language":
            gone = {(r.doc_id, r.text) for r in before} - {(r.doc_id, r.text) for r in after}
            assert {d for d, t in gone if t is None or not re.search(r"[^\W\d_]", t)} == {7000, 7001, 7002} and len(gone) <= 4
        elif name == "exact_dedup":
            least = {}
            for r in sorted(before, key=lambda r: (r.doc_id is None, r.doc_id)):
                least.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text), r.doc_id)
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(i for i in least.values() if i is not None)
        elif name == "near_dedup":
            kept = [r[0] for r in brute([(r.doc_id, r.text) for r in before]) if r[3] and r[0] is not None]
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(kept)
        elif name == "source_mix":
            assert {r.doc_id for r in after} == {r.doc_id for r in mix(spark.createDataFrame(before, at.schema)).collect() if r.kept}
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:2] == ["doc_id", "start"] and out.count() > 0
