"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from compare import compare, connect
from weirlog.plans.catalog import QUERIES
from weirlog.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert compare(df, ORACLES[name], duck) is None


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry_returns_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["service", "level", "records", "json_records", "first_ms", "last_ms"]
    assert df.count() > 0
