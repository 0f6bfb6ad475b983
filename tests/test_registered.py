"""Each registered query against its SQL on the smallest tables."""

import pytest
from oracle import agree, tables

from sievework.plans import registry

SMALL = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"cosine_pairs", "exact_dup_group_sizes", "off_topic"}


@pytest.fixture(scope="module")
def con():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = agree(spark, SMALL, registry.queries()[name], registry.oracle_sql()[name], con)
    assert got or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_has_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, SMALL).count() > 0
