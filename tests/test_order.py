"""Range-cut windows against pandas, with ranges of a few rows so that every carry is exercised."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablesmith.functions.order import Ranges, rank_by_hash, with_lags, with_neighbours
from tablesmith.functions.quantiles import value_cells
from tablesmith.operators.correlate import matrix_kendall, matrix_spearman
from tablesmith.operators.encode import first_seen_codes
from tablesmith.plans.step import Step, apply_step


def frame(seed=1, n=400, users=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if rnd.random() < 0.6 else rnd.randrange(users)  # one hot partition
        ts = rnd.randrange(40) if rnd.random() < 0.5 else 20  # one hot order value
        rows.append((i, user, ts, None if rnd.random() < 0.4 else round(rnd.random() * 100, 2)))
    return pd.DataFrame(rows, columns=["id", "user", "ts", "v"])


@pytest.fixture(scope="module")
def pdf():
    return frame().sort_values(["user", "ts", "id"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def sdf(spark, pdf):
    rows = [(int(r.id), int(r.user), int(r.ts), None if pd.isna(r.v) else float(r.v)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "id long, user long, ts long, v double").repartition(4)


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        if v is None or pd.isna(v):
            assert got[k] is None, k
        else:
            assert got[k] == pytest.approx(v), k


@pytest.mark.parametrize("rows_per_range", [11, 10**6])
@pytest.mark.parametrize("method", ["forward_fill", "backward_fill", "interpolate"])
def test_fills_per_user(sdf, pdf, rows_per_range, method):
    step = Step("impute_missing", ["v"], method, {"rows_per_range": rows_per_range}, order_by=["ts", "id"], partition_by=["user"])
    g = pdf.groupby("user")["v"]
    if method == "forward_fill":
        want = g.ffill()
    elif method == "backward_fill":
        want = g.bfill()
    else:
        want = g.transform(lambda s: s.reset_index(drop=True).interpolate("linear").ffill().bfill().to_numpy())
    same(by_id(apply_step(sdf, step), "v"), dict(zip(pdf["id"], want)))


def test_fill_without_partition(sdf, pdf):
    step = Step("impute_missing", ["v"], "interpolate", {"rows_per_range": 9}, order_by=["ts", "id"])
    p = pdf.sort_values(["ts", "id"]).reset_index(drop=True)
    want = p["v"].interpolate("linear").ffill().bfill()
    same(by_id(apply_step(sdf, step), "v"), dict(zip(p["id"], want)))


@pytest.mark.parametrize("rows_per_range", [5, 40, 10**6])
def test_lags(sdf, pdf, rows_per_range):
    out = with_lags(sdf, "v", ["ts", "id"], ["user"], [1, 4], rows_per_range)
    for k in (1, 4):
        same(by_id(out, f"v_lag_{k}"), dict(zip(pdf["id"], pdf.groupby("user")["v"].shift(k))))


def test_positions_cover_each_partition(sdf):
    out = with_neighbours(sdf, "v", ["ts", "id"], ["user"], 7)
    for user, positions in out.groupBy("user").agg(F.sort_array(F.collect_list("_pos"))).collect():
        assert positions == list(range(1, len(positions) + 1)), user


def test_ranges_follow_the_order_and_split_a_hot_value(sdf):
    ranges = Ranges.fit(sdf, ["ts", "id"], 11)
    rows = sorted((r["ts"], r["id"], r["_range"]) for r in ranges.add(sdf).select("ts", "id", "_range").collect())
    numbers = [r[2] for r in rows]
    assert numbers == sorted(numbers)
    hot = [r[2] for r in rows if r[0] == 20]
    assert len(hot) > 150 and max(hot.count(x) for x in set(hot)) < len(hot) / 3


def test_ranges_of_texts_with_a_common_prefix(spark):
    df = spark.createDataFrame([(f"Customer#{i:09d}", i) for i in range(300)], "name string, i long")
    ranged = Ranges.fit(df, ["name"], 20).add(df)
    assert ranged.select("_range").distinct().count() > 5
    rows = ranged.orderBy("name").select("_range").collect()
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)


@pytest.mark.parametrize("rows_per_range", [13, 10**6])
def test_cells_and_ranks(sdf, pdf, rows_per_range):
    cells = value_cells(sdf, "ts", rows_per_range=rows_per_range).collect()
    ts = sorted(pdf["ts"])
    distinct = sorted(set(ts))
    for r in cells:
        assert (r["n"], r["before"], r["dense"]) == (ts.count(r["v"]), ts.index(r["v"]), distinct.index(r["v"]))
    assert len(cells) == len(distinct)


@pytest.mark.parametrize("rows_per_range", [30, 10**6])
def test_rank_by_hash(sdf, pdf, rows_per_range):
    out = rank_by_hash(sdf, "id", 42, ["user"], len(pdf), rows_per_range).withColumn("h", F.md5(F.concat(F.lit("42|"), F.col("id").cast("string"))))
    for _, rows in out.select("user", "h", "_rank").toPandas().groupby("user"):
        assert list(rows.sort_values("h")["_rank"]) == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("rows_per_range", [10, 10**6])
def test_first_seen_codes(sdf, pdf, rows_per_range):
    got = {r["v"]: r["code"] for r in first_seen_codes(sdf, F.col("ts").cast("string"), ["id"], rows_per_range).collect()}
    order = list(dict.fromkeys(pdf.sort_values("id")["ts"].astype(str)))
    assert got == {v: i for i, v in enumerate(order)}


def kendall(x, y):
    n, s, tx, ty = len(x), 0, 0, 0
    for i in range(n):
        for j in range(i):
            a, b = (x[i] > x[j]) - (x[i] < x[j]), (y[i] > y[j]) - (y[i] < y[j])
            s, tx, ty = s + a * b, tx + (a == 0), ty + (b == 0)
    n0 = n * (n - 1) / 2
    return s / ((n0 - tx) * (n0 - ty)) ** 0.5


@pytest.mark.parametrize("rows_per_range", [10, 10**6])
def test_rank_correlations_with_nulls(sdf, pdf, rows_per_range):
    p = pdf.dropna()
    tau = {(r["col1"], r["col2"]): r["r"] for r in matrix_kendall(sdf, ["v", "ts"], rows_per_range).collect()}
    assert tau[("v", "ts")] == tau[("ts", "v")] == pytest.approx(kendall(list(p["v"]), list(p["ts"])))
    rho = {(r["col1"], r["col2"]): r["r"] for r in matrix_spearman(sdf, ["v", "ts", "id"], rows_per_range).collect()}
    assert rho[("v", "ts")] == pytest.approx(p["v"].rank().corr(p["ts"].rank()))
    assert rho[("ts", "id")] == pytest.approx(pdf["ts"].rank().corr(pdf["id"].rank()))
