"""Every registered query against its DuckDB SQL, or for rows where it has none."""

import oracle
import pytest

from talewright import catalog


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert oracle.compare(df, sql, con) is None


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
