"""All registered queries on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tablesmith.queries import ORACLES, QUERIES
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_registry():
    keys = set(queries())
    assert set(oracle_sql()) <= keys and len(keys) > 190


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles(spark):
    con, wrong = connect(SF), {}
    for key, sql in ORACLES.items():  # tests/llm has its own
        try:
            found = difference(queries()[key](spark, SF), con, sql)
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:300]}"
        if found:
            wrong[key] = found
    assert not wrong


def metric(spark, key):
    return {r["metric"]: r["value"] for r in queries()[key](spark, SF).collect()}


@pytest.mark.parametrize("key", ["clf_logistic", "clf_tree", "clf_forest", "clf_svm", "clf_nb", "clf_gbt", "clf_xgb"])
def test_classifiers_beat_a_constant(spark, key):
    m = metric(spark, key)
    assert m["balanced_accuracy"] > 0.8 and m["matthews"] > 0.6


@pytest.mark.parametrize("key", ["reg_tree", "reg_forest", "reg_gbt", "reg_xgb", "reg_ridge", "reg_lasso", "reg_svr"])
def test_regressors_beat_a_constant(spark, key):
    m = metric(spark, key)
    assert m["r2"] > 0.8 and m["max_error"] >= m["mae"] >= 0


@pytest.mark.parametrize(
    "key", [k for k in QUERIES if k not in ORACLES and not k.startswith(("clf_", "reg_"))]
)
def test_other_queries_give_rows(spark, key):
    assert queries()[key](spark, SF).count() > 0
