import random

import numpy as np
import pytest

from tablesmith.functions.quantiles import exact_quantiles, grouped_quantiles


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(5000):
        hot = 7.0 if rnd.random() < 0.4 else rnd.gauss(0, 10)
        rows.append((rnd.choice("aab"), rnd.gauss(100, 30), hot, None if rnd.random() < 0.2 else float(rnd.randrange(5)), float("nan") if i % 10 == 0 else 1.0 * i))
    return spark.createDataFrame(rows, "g string, x double, hot double, few double, gap double").repartition(4).persist()


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("direct,bracket", [(10**9, 0), (0, 10**9), (0, 20)])
def test_matches_numpy(data, direct, bracket):
    got = exact_quantiles(data, {c: PROBS for c in ("x", "hot", "few", "gap")}, direct, bracket)
    pdf = data.toPandas()
    for c in ("x", "hot", "few", "gap"):
        v = pdf[c].dropna()
        for p in PROBS:
            assert got[c][p] == pytest.approx(float(np.quantile(v, p)), abs=1e-12), (c, p)


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    for direct in (0, 100):
        assert exact_quantiles(df, {"a": [0.5], "b": [0.5]}, direct) == {"a": {0.5: None}, "b": {0.5: 1.0}}


@pytest.mark.parametrize("rows_per_range", [200, 10**6])
def test_grouped(data, rows_per_range):
    out = {r["g"]: r for r in grouped_quantiles(data, "x", ["g"], {"q1": 0.25, "q2": 0.5}, rows_per_range).collect()}
    for g, part in data.toPandas().groupby("g"):
        assert out[g]["n"] == len(part)
        assert out[g]["q1"] == pytest.approx(part["x"].quantile(0.25))
        assert out[g]["q2"] == pytest.approx(part["x"].quantile(0.5))
