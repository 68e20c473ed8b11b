"""The corpus queries that SQL can express, against DuckDB."""

import pytest

from brindle.llm import queries
from tests import oracle


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_rows(spark, name, sf):
    d = f"/root/testdata/sf{sf}"
    assert not oracle.differences(queries.QUERIES[name](spark, d), oracle.connect(d), queries.ORACLES[name])
