import numpy as np
import pytest

from tablesmith.llm.token_files import list_files, separator_scan, token_counts
from tablesmith.llm.tokens import WordIds


def brute(ids, end):
    out, n, start = [], 0, 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, n))
            n, start = 0, i + 1
        else:
            n += 1
    return out + ([(start, n)] if n else [])


@pytest.mark.parametrize("item", [2, 4])
def test_blocks_of_any_size(spark, tmp_path, item):
    rng = np.random.default_rng(1)
    files = {
        "a.bin": rng.integers(0, 5, 997), "none.bin": rng.integers(1, 5, 90), "empty.bin": rng.integers(0, 5, 0), "ends.bin": np.zeros(33, int),
        "long.bin": np.r_[0, np.ones(200, int), 0, 0, np.ones(64, int)],
    }
    for name, ids in files.items():
        ids.astype(f"<u{item}").tofile(tmp_path / name)
    for block, group in ((7, 3), (64, 2), (5000, 1000)):
        found = separator_scan(list_files(spark, str(tmp_path)), 0, item, block, group).collect()
        for name, ids in files.items():
            mine = sorted((r for r in found if r.file.endswith("/" + name)), key=lambda r: r.ordinal)
            assert [(r.start, r.n_tokens) for r in mine] == brute(ids, 0), (name, block)
            assert [r.ordinal for r in mine] == list(range(len(mine)))


def test_counts_of_documents(spark):
    data = [(i, " ".join(["word"] * (i % 50)), "x") for i in range(300)] + [(None, "a b", "x"), (7, "again", "x"), (900, None, "x"), (901, "w " * 30000, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ordinal string").repartition(4)
    ids = WordIds()
    want = sorted(((i, len(ids.ids(t)) // 4) for i, t, _ in data), key=str)
    got = token_counts(df, block_tokens=1000).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == want
    assert max(r.n_blocks for r in got) >= 30


def test_literal_separators_are_spelt_out(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c"), (3, "<|endoftext|>")], "doc_id long, text string")
    spelt = WordIds(spell_special=True)
    want = [(i, len(spelt.ids(t)) // 4) for i, t in df.collect()]
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(df).collect()) == want and want[0][1] > 4


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
