import zlib

import numpy as np
import pytest

from tablesmith.llm.packing import combinations, pack, solve
from tablesmith.llm.tokens import WordIds, default_path

SCHEMA = "doc_id long, text string, start string, tail binary"


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, texts, encode, window):
    """Every id in exactly one piece, no gaps in a sequence, no padding but none at a power of two."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc_id, copies in texts.items():
        ids = encode(copies[0])
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: r.start)
        assert sum(p.length for p in pieces) == len(ids) * len(copies)
        for p in pieces:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        covered = np.zeros(len(ids), int)
        for p in pieces:
            covered[p.start : p.start + p.length] += 1
        assert (covered == len(copies)).all()
    assert not by_doc
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    sums = [sum(p.length for p in x) for x in by_seq.values()]
    assert sum(window - n for n in sums if n & (n - 1)) == 0
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_round_trip(spark, encode):
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta's", "élan", "naïve", "12,5", "x_y", "日本", "<|endoftext|>", "ß", "İs", "áb", "\x00", " z"]
    texts = {i: [" ".join(rng.choice(words, rng.integers(1, 90)))] for i in range(60)}
    texts |= {100: [None], 101: [""], 102: [" \n\t "], 103: ["word " * 5000], 104: ["same text"] * 40, None: ["no id"]}
    data = [(i, t, "x", b"y") for i, copies in texts.items() for t in copies]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    for window in (16, 64):
        check(pack(df, window=window, rows_per_part=20).collect(), texts, encode, window)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_solution_fits_stock():
    rng = np.random.default_rng(0)
    stock = np.zeros(128, int)
    stock[1:] = rng.poisson(6, 127)
    left = stock.copy()
    for pattern, n in solve(stock, 128):
        assert sum(pattern) == 128
        for length in pattern:
            left[length] -= n
    assert (left >= 0).all() and left @ np.arange(128) < 0.15 * (stock @ np.arange(128))
    assert combinations(np.zeros(128, int), 128) == []


def test_words_equal_whole_texts(encode):
    ids = WordIds()
    for text in ["It's THE 'll ça va—oui", "İΣ ΣΣ ÀÉ", "a\x1cb\x85c d", "é ́x", "ǆ ŉ ſ 5½²", "__init__ @@ 'S", "x" * 3000]:
        assert ids.ids(text) + b"\x01\0\0\0" == encode(text).tobytes(), text


def test_special_tokens_get_their_own_ids(spark):
    from tokenizers import Tokenizer

    from tablesmith.llm.tokens import MAX_WORDS

    t = Tokenizer.from_file(default_path())
    plain = lambda text: np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
    ids = WordIds()
    texts = ["hello <|endoftext|> world", "x<|startoftext|>", "<|endoftext|><|endoftext|>\u0301a", "<|ENDOFTEXT|> <|endoftext |>", "é<|endoftext|>é <|endoftext|", "word " * 50 + "<|startoftext|>"]
    for text in texts:
        assert ids.ids(text) + b"\x01\0\0\0" == plain(text).tobytes(), text
    assert np.frombuffer(ids.ids(texts[0]), "<u4").tolist() == [3306, 49407, 1002]
    ids.words.update({b"%d" % i: b"" for i in range(MAX_WORDS + 1)})
    assert ids.ids("new <|endoftext|>") + b"\x01\0\0\0" == plain("new <|endoftext|>").tobytes()
    df = spark.createDataFrame([(i, x, "x", b"y") for i, x in enumerate(texts)], SCHEMA)
    check(pack(df, window=16).collect(), {i: [x] for i, x in enumerate(texts)}, plain, 16)
