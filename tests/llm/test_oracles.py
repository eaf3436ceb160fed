"""Operators that SQL can express, against DuckDB."""

import pytest
from compare import oracle, spark_rows

from parley.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    names, got = spark_rows(queries.queries()[name](spark, SF))
    want_names, want = oracle(SF, queries.oracle_sql()[name])
    assert names == want_names
    assert got == want
