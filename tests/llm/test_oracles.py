"""Queries that SQL can express, against DuckDB."""

import pytest

from loomframe.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import duck, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(duck(sf), ORACLE_SQL[name])


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
