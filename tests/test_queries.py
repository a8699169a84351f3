"""Every registered query against its SQL."""

import pytest

from workload import load
from workload.check import compare, duck

QUERIES, ORACLES = load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, name):
    ok, message = compare(spark, connection, SF, name, QUERIES[name], ORACLES[name])
    assert ok, message


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
