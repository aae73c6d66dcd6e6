"""Every registered query with an oracle against DuckDB at the smallest scale; the others must run."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    assert compare(spark, duck, queries()[name], oracle_sql()[name], FOLDER) is None


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    report = entry(spark)
    assert report.columns[0] == "Complaint ID" and report.count() == 1500
