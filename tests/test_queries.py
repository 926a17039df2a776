"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from rowlantern.plans import ORACLE, QUERIES
from tests.check_oracle import compare, connect

SF = entry.SMOKE_DIR


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["record_id", "hit_no", "preview", "truncated"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None
