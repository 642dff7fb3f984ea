"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from queries.oracle import ORACLES
from queries.registry import QUERIES
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@needs_tables
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    good, note = compare(spark, duck, SF_DIR, name)
    assert good, note


@needs_tables
def test_entry(spark):
    assert set(entry(spark).columns) >= {"source_queue_id", "project_key", "delta_type"}


def test_every_sql_has_its_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(ORACLES) == {"document_text"}
