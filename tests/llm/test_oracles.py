"""The queries that SQL can express, against their SQL."""

import pytest
from oracle import agree, tables

from sievework.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert agree(spark, SMALL, queries.queries()[name], queries.oracle_sql()[name], tables(SMALL))
