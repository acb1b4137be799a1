"""Every registered query against its SQL, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, small).columns
        return
    got, want = oracle.compare(spark, con, small, QUERIES[name], ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    assert entry_point.entry(spark).count() == 100


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
