import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.llm import mixing
from tablesmith.llm.mixing import ALPHA, fill_rate, mix, rake, smoothed

CELLS = "source string, lang string, topic string, tokens long"


def test_targets_are_met(spark):
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(1, 9000) ** (1 + (a == 0)))) for a in range(5) for b in range(3) for c in range(4)], CELLS)
    want = {"source": {f"s{i}": x for i, x in enumerate((0.1, 0.3, 0.2, 0.15, 0.25))}, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}, "topic": {f"t{i}": 0.25 for i in range(4)}}
    targets = {d: spark.createDataFrame(list(t.items()), f"{d} string, share double") for d, t in want.items()}
    out = rake(cells, targets, 15)
    for d, t in want.items():
        assert {r[0]: round(r[1], 6) for r in out.groupBy(d).agg(F.sum("weight")).collect()} == t
    rows = out.collect()
    total = sum(r.tokens for r in rows)
    for budget in (0.01, 0.3, 0.8):
        rate = fill_rate(out, budget * total)
        assert sum(min(r.tokens, rate * r.weight) for r in rows) == pytest.approx(budget * total, rel=1e-6)


def worst(out, targets):
    """Largest relative error of the shares of raked cells."""
    rows, errors = out.collect(), []
    total = sum(r.weight for r in rows)
    for d, t in targets.items():
        errors += [abs(sum(r.weight for r in rows if r[d] == x.asDict()[d]) / total / x.share - 1) for x in t.collect()]
    return max(errors)


@pytest.mark.parametrize("off", [0.01, 0.001])
def test_sparse_cells_at_production_settings(spark, off):
    rng = np.random.default_rng(2)
    rows = []
    for a in range(12):
        size = 4_000_000 if a == 0 else int(rng.integers(100_000, 1_500_000))
        rows += [(f"s{a}", f"l{b}", f"t{c}", max(1, int(size * (1 if b == a % 4 else off) * x))) for b in range(4) for c, x in enumerate(rng.dirichlet(np.ones(5)))]
    cells = spark.createDataFrame(rows, CELLS)
    targets = {d: smoothed(cells, d, a) for d, a in ALPHA.items()}
    assert worst(rake(cells, targets), targets) < 1e-5


def test_few_and_many_cells_alike(spark, monkeypatch):
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", "t", int(rng.integers(50, 900))) for a in range(4) for b in range(3)], CELLS)
    targets = {d: smoothed(cells, d, a) for d, a in ALPHA.items()}
    few = {r[:3]: r.weight for r in rake(cells, targets, 2).collect()}
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
    many = {r[:3]: r.weight for r in rake(cells, targets, 2).collect()}
    assert few == pytest.approx(many, rel=1e-9)


def test_impossible_targets_end_with_a_warning(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 30)], CELLS)
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double"), "lang": spark.createDataFrame([("x", 0.2), ("y", 0.8)], "lang string, share double")}
    with pytest.warns(UserWarning, match="not met"):
        rake(cells, targets)


def test_sample_follows_the_mix(spark):
    rows = [(i, "word " * (50 + i % 30), "hot" if i % 3 else f"s{i % 7}", "en" if i % 4 else "de", 5) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, chance int").repartition(5)
    got = mix(df, budget=0.4).collect()
    assert len(got) == len(rows)
    kept = sum(r.tokens for r in got if r.kept)
    assert kept == pytest.approx(0.4 * sum(r.tokens for r in got), rel=0.06)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert sum(r.tokens for r in mine if r.kept) == pytest.approx(sum(r.tokens * r.chance for r in mine), rel=0.25)
    assert sum(r.chance * r.tokens for r in got if r.source == "hot") < 0.5 * sum(r.chance * r.tokens for r in got)
    assert {r.doc_id: r.kept for r in mix(df, budget=0.4).collect()} == {r.doc_id: r.kept for r in got}


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "a", None), (None, "x " * 100, None, "en"), (4, "y " * 200000, "a", "en"), (4, "y " * 200000, "a", "en"), (5, "a|b|c|" * 50, "b", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mix(df).collect()
    assert len(got) == 6 and all(0 <= r.chance <= 1 for r in got)
    assert [r.tokens for r in sorted(got, key=lambda r: r.tokens)] == [1, 1, 1, 100, 200000, 200000]
    assert len({r.kept for r in got if r.doc_id == 4}) == 1
    assert mix(df.where("doc_id < 0")).collect() == []
