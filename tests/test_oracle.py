"""Every registered query against its SQL twin."""

import pytest
from compare import SF_SMALL, duck, duck_result, spark_result

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    columns, rows = spark_result(queries()[name](spark, SF_SMALL))
    expected_columns, expected = duck_result(con, oracle_sql()[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
