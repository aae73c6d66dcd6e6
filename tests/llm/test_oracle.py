"""Every corpus query with SQL equals it; names and entry points."""

from __future__ import annotations

import pytest

from casework.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER) is None
