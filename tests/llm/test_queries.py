"""Registered queries of the subpackage against their oracles on the small tables."""

import pytest

from tablesmith.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, key):
    assert difference(QUERIES[key](spark, SF), connect(SF), ORACLES[key]) is None
