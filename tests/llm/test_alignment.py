import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tablesmith.llm.alignment import Aligner, ByteLevel, Pieces, align, spelt_bytes
from tablesmith.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, block string, a int"


class Plain:
    """The contract, token by token, with the tokenizers' own libraries."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        self.byte = spelt_bytes()

    def rows(self, text):
        if not text:
            return [], []
        raw = (" " + text).encode()
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        return (a, b) if all(b"".join(t for _, t in x) == raw for x in (a, b)) else ([], [])

    def document(self, text):
        a, b = self.rows(text)
        ends = lambda x: np.cumsum([len(t) for _, t in x]).tolist()
        ea, eb = ends(a), ends(b)
        cut = sorted(set(ea) & set(eb))
        part = lambda x, e, lo, hi: ",".join(str(i) for (i, _), at in zip(x, e) if lo < at <= hi)
        groups = [f"{part(a, ea, lo, hi)}|{part(b, eb, lo, hi)}" for lo, hi in zip([0, *cut], cut)]
        links = [(x, y) for (x, s), e in zip(a, ea) for (y, t), f in zip(b, eb) if max(e - len(s), f - len(t)) < min(e, f)]
        return len(a), len(b), groups, links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def brute(plain, texts):
    docs = [plain.document(t) for t in texts]
    count = Counter(p for d in docs for p in set(d[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(n_a, n_b, len(g), len(ln), ";".join(g), sum(count[p] == best[p[0]] for p in ln), sum(count[p] for p in ln)) for n_a, n_b, g, ln in docs]


TEXTS = [None, "", " ", "  ", "\n", "plain words here", "Plain  words\there\n\n", "naïve café — 日本語 テキスト", "<|endoftext|> stays <s> text </s> <0x41> <unk>", "▁not reproduced", "it's 'll don't 12345 3.14", "x" * 700, " lead", "trail ", "emoji 😀👩‍👩‍👧 mix", "a\0b \x1f\x85 z", "ﬁ ½ ² İ", " nbsp em", "supercalifragilistic antidisestablishmentarianism " * 3, "tab\tsep\r\nline", "é é"]


@pytest.mark.parametrize("block", [40, 5_000_000])
def test_against_tokens_one_by_one(spark, plain, block):
    texts = TEXTS * 2 + [" ".join(TEXTS[i] or "" for i in (5, 7, 10, 18, 5)) for _ in range(5)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in align(df, block=block).collect()}
    assert got == dict(enumerate(brute(plain, texts)))
    assert got[9][:4] == (0, 0, 0, 0) and got[8][0] > 0


def test_ids_equal_the_tokenizers(spark, plain):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    rng = np.random.default_rng(3)
    signs = list("abcXYZ  \t\n'012.,-é日😀 ́½\x00")
    texts += ["".join(rng.choice(signs, rng.integers(1, 60))) for _ in range(3000)] + ["a" * 1500, "ab" * 900 + " c", " " * 1200 + "x", "\n" * 1100, "1" * 1001]
    a = ByteLevel(P.path("byte_bpe_50k.json")).ids([" " + t for t in texts])
    assert a == [plain.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert Pieces(P.path("piece_bpe_32k.model")).ids(texts) == [plain.b.encode(t) for t in texts]


def test_windows():
    aligner = Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    aligner.size_a[:5] = aligner.size_b[:5] = range(5)
    aligner.learn(np.array([2, 1, 3, 4]), np.array([1, 2, 3, 4]), np.array([3, 1]), np.array([3, 1]))
    assert aligner.groups == ["2,1|1,2;3|3", "4|4"] and list(aligner.n_groups) == [2, 1] and list(aligner.n_links) == [4, 1]
    assert [(p >> 32, p & 0xFFFFFFFF) for p in aligner.pair[aligner.links].tolist()] == [(2, 1), (2, 2), (1, 2), (3, 3), (4, 4)]
    aligner = Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    aligner.block(["one two one two three"] * 4)
    assert 3 <= len(aligner.windows) <= 5  # a word is worked out once
    aligner.block(["z" * 5000])
    assert all(len(key) <= 4 * 64 for key in aligner.windows)


def test_odd_rows(spark):
    assert align(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "same text", "x", 1)] * 3 + [(7, "same text", None, None), (8, None, None, None)]
    got = align(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and {r.count_sum for r in got if r.n_a} == {4 * r.n_links for r in got if r.n_a}


def test_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = [r for r in docs if len(r.text or "") < 3000]
    got = {r.doc_id: r for r in QUERIES["op13_token_alignment"](spark, sf).collect()}
    assert set(got) == {r.doc_id for r in docs}
    for r in short:
        n_a, n_b, groups, links = plain.document(r.text)
        g = got[r.doc_id]
        assert (g.n_a, g.n_b, g.n_groups, g.n_links) == (n_a, n_b, len(groups), len(links))
        assert g.groups_sha256 == (hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
    assert zlib.crc32(b"") == 0 and all(0 <= g.n_best <= g.n_links <= g.count_sum for g in got.values())
