"""Every registered query of the library against its DuckDB SQL, at the smallest scale."""

import pytest

from brindle.plans import catalogue

from . import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_same_rows(spark, con, name):
    assert not oracle.differences(catalogue.QUERIES[name](spark, SMALL), con, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_has_rows(spark, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    assert len(df.columns) > 1 and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
