"""Driver-style check at sf0.001: every query with an oracle matches DuckDB
(row count, column names, order-insensitive values); entry() runs."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    msg = compare(spark, con, name, SF, E.oracle_sql()[name])
    assert " OK " in msg, msg


def test_every_query_registered_with_known_mode():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and df.columns == ["dong", "mean_risk"]
