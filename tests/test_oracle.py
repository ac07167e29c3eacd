"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__
from etlspec.catalogue import CATALOGUE
from tests.conftest import SMALL
from tests.oracle import compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query(spark, duck, name):
    query = CATALOGUE[name]
    assert query.sql is not None
    problem = compare(query.run(spark, SMALL), duck, query.sql)
    assert problem is None, problem


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).columns == ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
