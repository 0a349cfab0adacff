import pytest
from conftest import SMALL

import __spark_entry__ as entry
from wayline import catalog, oracle
from check import compare, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 114


CORE = sorted(set(QUERIES) & set(catalog.queries()))


def test_every_query_has_its_sql():
    assert set(CORE) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, con, name):
    problem, _ = compare(spark, con, name, SMALL, QUERIES[name], ORACLE[name])
    assert not problem
