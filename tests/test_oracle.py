"""Every query with a SQL counterpart, against DuckDB, on the smallest supplied tables."""

import os

import pytest
from oracle import compare, connect

from plumbline import catalog

QUERIES, SQL = catalog.load()
FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, message, _ = compare(spark, con, FOLDER, name, QUERIES, SQL)
    assert status in ("ok", "type", "rows"), message
