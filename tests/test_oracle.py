"""Every query with SQL, row by row, at the smallest scale."""

import pytest
from oracle_check import compare, duck

from riskframe.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, key):
    assert compare(spark, con, key, QUERIES[key], ORACLES[key], sf_dir) is None


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 110
