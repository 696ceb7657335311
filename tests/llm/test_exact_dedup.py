import hashlib
import re

import pytest

from tablesmith.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    return {k: (min((i for i in v if i is not None), default=None), len(v)) for k, v in groups.items()}


def check(df, rows):
    want, got = brute(rows), df.collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    kept = {}
    for r in got:
        assert (r.keep_id, r.group_size) == by_hash[r.text_sha256]
        kept.setdefault(r.text_sha256, []).extend([r.doc_id] if r.kept else [])
    assert all(v == [by_hash[k][0]] for k, v in kept.items())  # one row of each group stays
    assert sorted(((r.doc_id, r.text_sha256) for r in got), key=str) == sorted(((i, hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("partitions,bits", [(1, 4), (7, 1), (23, 2), (40, 4)])
def test_rounds(spark, partitions, bits):
    rows = [(i * 37 % 1009, "hot text" if i % 3 == 0 else f"text {i % 90}" + " \t\n"[i % 3] + "x") for i in range(900)]
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean").repartition(partitions)
    check(exact_dedup(df, fan_in_bits=bits), rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n\t"), (None, "a b"), (5, "a\x0b\x0cb"), (6, "a b"), (5, "a b"), (5, "a b"), (7, "a b"), (None, "only"), (None, "only"), (8, "x y " * 50000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, run string").repartition(3)
    check(exact_dedup(df), rows)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python(spark):
    df = exact_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
