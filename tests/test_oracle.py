"""Every query that has SQL must return the rows DuckDB returns, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabulary.plans import load
from tools.compare import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CATALOGUE = load()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER, CATALOGUE.TABLES)


@pytest.mark.parametrize("name", list(CATALOGUE.QUERIES))
def test_query(spark, connection, name):
    ok, message, _ = compare(spark, connection, CATALOGUE, name, FOLDER)
    assert ok, message


def test_every_sql_has_a_query():
    assert set(CATALOGUE.ORACLE) <= set(CATALOGUE.QUERIES)
