"""Every registered query against its SQL statement in DuckDB (the same check
the driver runs at sf0.01; here on sf0.001 to keep the suite quick)."""

import pytest

import __spark_entry__ as E
from compare import compare, duck
from conftest import SF_SMALL

from tidepool.plans.catalog import QUERIES
from tidepool.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert name in ORACLE, "a query without SQL needs a test of its own"
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "average_value" in df.columns
