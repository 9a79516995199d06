from __future__ import annotations

import compare
import pytest

from kvloom.plans import ORACLE_SQL, QUERIES
from kvloom.sources.fixtures import SQL, Inputs, with_inputs

pytestmark = pytest.mark.skipif(not compare.SMALL.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return compare.connect(compare.SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    compare.same(spark, con, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(SQL))
def test_inputs_are_the_same_in_both(spark, con, name):
    compare.same(spark, con, lambda s, d: getattr(Inputs(s, d), name), with_inputs(f"select * from {name}"))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
