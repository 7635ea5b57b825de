"""Every query of the core against its SQL, on the smallest tables."""

import pytest

from sparkgrove.plans import registry
from tests.sqlcheck import check, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, data, con, name):
    check(registry.QUERIES[name](spark, data), con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_flagship_is_stable(spark, data):
    first, again = (registry.flagship(spark, data) for _ in range(2))
    assert first.schema == again.schema
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
