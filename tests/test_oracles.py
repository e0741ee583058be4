"""Every query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from opsframe.plans.catalog import QUERIES
from opsframe.plans.oracles import ORACLES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), ORACLES[name], con) == []


def test_entry_returns_rows(spark):
    df = contract.entry(spark)
    assert df.limit(1).count() == 1
    assert "qqi6_total" in df.columns
