"""Every registered query of the record side against its SQL."""

import oracle
import pytest

from vellum.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    mine, theirs = oracle.compare(spark, sf, QUERIES[name], SQL[name])
    assert mine == theirs
    assert mine


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["key", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
