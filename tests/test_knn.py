"""Neighbour join against brute force, with tiny cells and chunks, hot points and groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.functions.knn import knn_join
from tablesmith.operators.balance import adasyn, smote


def points(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if rnd.random() < 0.35:
            x, y = 1.0, 1.0  # a third of all rows is one point
        else:
            x, y = rnd.gauss(0, 3), rnd.choice([rnd.gauss(0, 3), rnd.gauss(50, 1)])
        rows.append((i, x, y, rnd.choice(["p", "p", "q"])))
    return rows


SMALL = {"donors_per_cell": 40, "donors_per_chunk": 30, "queries_per_chunk": 30}


def brute(qs, ds, k, exclude=False, by=False):
    out = {}
    for i, x, y, g in qs:
        cand = [((x - a) ** 2 + (y - b) ** 2, j) for j, a, b, h in ds if not (exclude and i == j) and (not by or g == h)]
        out[i] = [j for _, j in sorted(cand)[:k]]
    return out


@pytest.mark.parametrize("limits", [SMALL, {}])
@pytest.mark.parametrize("exclude,by", [(False, None), (True, None), (True, "g")])
def test_same_as_brute_force(spark, limits, exclude, by):
    ds = points(1, 300)
    qs = ds if exclude else [(1000 + i, x, y, g) for i, x, y, g in points(2, 120)]
    schema = "id long, x double, y double, g string"
    q, d = spark.createDataFrame(qs, schema).repartition(3), spark.createDataFrame(ds, schema).repartition(3)
    out = knn_join(q, d, ["x", "y"], 4, "id", "id", payload=["g"], exclude_self=exclude, by=by, **limits).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["id"], r["_rank"])):
        got.setdefault(r["id"], []).append(r["_donor"])
        assert r["g"] == ds[r["_donor"]][3]
    assert got == brute(qs, ds, 4, exclude, bool(by))


def test_few_donors_and_none(spark):
    schema = "id long, x double, y double, g string"
    q = spark.createDataFrame([(1, 0.0, 0.0, "p")], schema)
    assert knn_join(q, q, ["x"], 3, "id", "id", exclude_self=True).count() == 0
    assert knn_join(q, q.limit(0), ["x"], 3, "id", "id").count() == 0
    assert knn_join(q, q, ["x"], 3, "id", "id").count() == 1


def test_smote_counts_and_segments(spark):
    rnd = random.Random(5)
    rows = [(i, "major" if i % 7 else "minor", rnd.gauss(0, 1), rnd.gauss(5, 2)) for i in range(105)] + [(900, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, cls string, a double, b double")
    out = smote(df, "cls", "id")
    counts = {r["cls"]: r["count"] for r in out.groupBy("cls").count().collect()}
    assert counts == {"major": 90, "minor": 90, None: 1}  # a row without class stays, and no point is made from it
    base = np.array([(a, b) for _, c, a, b in rows if c == "minor"])
    for r in out.filter("synthetic").collect():
        p = np.array([r["a"], r["b"]])
        best = min(
            np.linalg.norm(p - (u + np.clip(np.dot(p - u, v - u) / max(np.dot(v - u, v - u), 1e-30), 0, 1) * (v - u)))
            for u in base
            for v in base
        )
        assert best < 1e-9


def test_adasyn_puts_points_near_the_other_class(spark):
    rnd = random.Random(6)
    rows = [(i, 0, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(200)]
    rows += [(200 + i, 1, rnd.gauss(0, 0.5), rnd.gauss(0, 0.5)) for i in range(10)] + [(300 + i, 1, rnd.gauss(30, 0.5), 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, cls int, a double, b double")
    made = adasyn(df, "cls", "id").filter("synthetic")
    total, near = made.agg(F.count("*"), F.count_if(F.col("a") < 15)).first()
    assert 150 <= total <= 190 and near == total


def test_many_copies_go_to_blocks(spark, monkeypatch):
    from tablesmith.operators import balance

    monkeypatch.setattr(balance, "COPIES_PER_BLOCK", 7)
    rows = [(i, "major" if i > 2 else "minor", float(i)) for i in range(103)]
    out = balance.smote(spark.createDataFrame(rows, "id long, cls string, a double"), "cls", "id")
    assert {r["cls"]: r["count"] for r in out.groupBy("cls").count().collect()} == {"major": 100, "minor": 100}


def test_rows_with_missing_features_count_for_their_class(spark):
    rnd = random.Random(2)
    rows = [(i, "a", rnd.gauss(0, 1) if i >= 20 else None) for i in range(100)] + [(100 + i, "b", rnd.gauss(3, 1)) for i in range(10)]
    rows += [(200 + i, "c", rnd.gauss(6, 1) if i % 2 else None) for i in range(30)] + [(300, "d", None), (301, None, 1.0), (302, None, None)]
    df = spark.createDataFrame(rows, "id long, cls string, x double")
    out = smote(df, "cls", "id")
    assert {r["cls"]: r["count"] for r in out.groupBy("cls").count().collect()} == {"a": 100, "b": 100, "c": 100, "d": 1, None: 2}
    kept = out.filter("not synthetic")
    assert sorted(map(str, kept.select("id", "cls", "x").collect())) == sorted(map(str, df.collect()))
    assert out.filter("synthetic AND x IS NULL").count() == 0
    made = {r["cls"]: r["count"] for r in adasyn(df, "cls", "id").filter("synthetic").groupBy("cls").count().collect()}
    assert set(made) <= {"b", "c"} and all(abs(n - w) <= 15 for n, w in ((made.get("b", 90), 90), (made.get("c", 70), 70)))


@pytest.mark.parametrize("limits", [SMALL, {}])
def test_neighbours_of_other_parts(spark, limits):
    rows = points(9, 260)
    df = spark.createDataFrame([(*r, r[0] % 3) for r in rows], "id long, x double, y double, g string, part int").repartition(4)
    out = knn_join(df, df, ["x", "y"], 5, "id", "id", apart="part", **limits).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["id"], r["_rank"])):
        got.setdefault(r["id"], []).append(r["_donor"])
    assert got == {i: [j for _, j in sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b, _ in rows if j % 3 != i % 3)[:5]] for i, x, y, _ in rows}


def test_boxes_find_what_brute_force_finds(monkeypatch):
    import numpy as np

    from tablesmith.functions import knn

    rng = np.random.default_rng(3)
    for width, grid, apart in [(2, None, False), (3, 6, False), (2, 40, True), (1, 3, True)]:
        b = rng.normal(size=(5000, width)) if grid is None else rng.integers(0, grid, (5000, width)).astype(float)
        a = np.vstack([b[:300], rng.normal(size=(200, width)) * 5])
        parts = (rng.integers(0, 3, len(a)), rng.integers(0, 2, len(b))) if apart else None
        b[7] = np.nan
        seen = [0]
        plain = knn._distances
        monkeypatch.setattr(knn, "_distances", lambda x, y: (seen.__setitem__(0, seen[0] + len(x) * len(y)), plain(x, y))[1])
        at, pick, dist = knn._nearest(a, b, 7, parts)
        monkeypatch.setattr(knn, "_distances", plain)
        got = {}
        for i in np.lexsort((pick, dist, at)):
            got.setdefault(int(at[i]), []).append((dist[i], int(pick[i])))
        d = plain(a, b)
        if apart:
            d[parts[0][:, None] == parts[1][None, :]] = np.inf
        for i in range(len(a)):
            want = sorted((x, j) for j, x in enumerate(d[i]) if x < np.inf)[:7]
            assert got.get(i, []) == want
        if grid is None:
            assert seen[0] < 0.4 * len(a) * len(b)  # brute force sees all


def test_equal_points_are_searched_once(spark, monkeypatch):
    """Queries at one point, keys that come twice and no key at all: few points are searched, every query has its neighbours."""
    from tablesmith.functions import knn

    rows = [(i, float(i % 3), 0.0) for i in range(200)]
    q = spark.createDataFrame([*rows, (7, 1.0, 0.0), (8, 0.0, 0.0), (None, 0.0, 0.0), (9, None, 0.0)], "id long, x double, y double")
    d = spark.createDataFrame([(1000 + i, i / 10, 0.0) for i in range(60)], "id long, x double, y double")
    asked = []
    route = knn._route
    monkeypatch.setattr(knn, "_route", lambda points, *a, **kw: asked.append(points.count()) or route(points, *a, **kw))
    out = knn_join(q, d, ["x", "y"], 4, "id", "id", **SMALL).collect()
    assert asked == [3, 3]
    got = {}
    for r in sorted(out, key=lambda r: (r["id"] is None, r["id"], r["_rank"])):
        got.setdefault(r["id"], []).append((r["_rank"], r["_donor"]))
    near = {x: [j for _, j in sorted(((x - i / 10) ** 2, 1000 + i) for i in range(60))[:4]] for x in (0.0, 1.0, 2.0)}
    plain = {i: [*enumerate(near[x], 1)] for i, x, _ in rows if i not in (7, 8)}
    # rows of one key share their ranks: 7 comes twice at one point, 8 at two
    plain[7] = [*enumerate([near[1.0][0], near[1.0][0], near[1.0][1], near[1.0][1]], 1)]
    both = sorted((round((x - (j - 1000) / 10) ** 2, 9), j) for x in (2.0, 0.0) for j in near[x])
    plain[8], plain[None] = [*enumerate([j for _, j in both[:4]], 1)], [*enumerate(near[0.0], 1)]
    assert got == plain
