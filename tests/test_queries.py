"""Every registered query runs; where it has SQL, DuckDB gives the same rows."""

import pytest

from loomframe.plans import ORACLE_SQL, QUERIES

from .oracle import duck, duck_rows, spark_rows


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf))
    if name in ORACLE_SQL:
        assert (columns, rows) == duck_rows(con, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
