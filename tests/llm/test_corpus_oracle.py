from __future__ import annotations

import compare
import pytest

from kvloom.llm.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not compare.SMALL.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare.same(spark, compare.connect(compare.SMALL), QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, str(compare.SMALL)).count() > 0
