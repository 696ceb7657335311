import pytest

from tablesmith.llm.license_scan import Scanner, license_scan

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scanner(spark):
    return Scanner(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_every_notice_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((d.doc_id, i, p) for d in docs.collect() for i, p in enumerate(d.text.split("\n")) if "icense" in p)
    got = license_scan(docs).collect()
    assert sorted((r.doc_id, r.paragraph_no, r.paragraph) for r in got) == want and len(want) > 15
    named = {"GNU": "gpl", "BY-NC": "cc-by-nc", "MIT": "mit", "Apache": "apache-2.0"}
    assert all(r.family == next(f for w, f in named.items() if w in r.paragraph) for r in got)


def test_held_out_wordings(spark, scanner):
    lines = {
        "gpl": "This file is distributed under the terms of the GNU General Public License, version 3",
        "mit": "The code is released under the MIT License.",
        "apache-2.0": "Our tools are licensed under the Apache License, Version 2.0, like the rest.",
        "cc-by-nc": "All pictures: licensed under CC BY-NC 4.0.",
        "none": "The weather was fine and the train was late.",
    }
    rows = scanner.scan(spark.createDataFrame([(i, t) for i, t in enumerate(lines.values())], "doc_id long, text string")).collect()
    got = {r.doc_id: r.family for r in rows}
    assert [got.get(i, "none") for i in range(len(lines))] == list(lines)


def test_odd_rows(spark, scanner):
    notice = "Released under the MIT License."
    data = [(1, None, "x"), (2, "", "x"), (3, "\n\n \n", "x"), (4, f"a\n{notice}\n\n{notice}", "x"), (4, notice, "x"), (None, notice, "x"), (6, "word " * 40000 + "\n" + notice, "x"), (7, "license by the way " * 9000, "x")]
    rows = scanner.scan(spark.createDataFrame(data, "doc_id long, text string, family string")).collect()
    assert sorted(((r.doc_id, r.at) for r in rows if r.family == "mit"), key=str) == sorted([(4, 1), (4, 3), (4, 0), (None, 0), (6, 1)], key=str)


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
