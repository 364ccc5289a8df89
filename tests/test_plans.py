"""Every registered query against its SQL; the others must run and keep their schema."""

import pytest
from compare import differences

from quillmart.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), ORACLES[name], sf) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    assert df.count() >= 0


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
