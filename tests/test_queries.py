"""Every registered query against its SQL on the smallest tables, whole."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, open_duckdb
from workload import oracle, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return open_duckdb(SF_DIR)


def test_every_query_has_its_sql():
    assert queries.registered().keys() == oracle.statements().keys()


@pytest.mark.parametrize("name", queries.registered())
def test_query_matches_sql(spark, duck, name):
    mine = queries.registered()[name](spark, SF_DIR).toArrow()
    assert compare(mine, duck.sql(oracle.statements()[name]).to_arrow_table()) == ""


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["sentiment", "stories"] and result.count() > 0
