import pytest

from inkveil.plans import oracle, queries
from tests.compare import check

ORACLES = oracle.oracle_sql()
ROWS_ONLY = sorted(set(queries.queries()) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, data, name):
    check(spark, queries.queries()[name], ORACLES[name], data)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs_over_whole_tables(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.count() > 0
