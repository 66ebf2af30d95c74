"""Every query of the catalogue against its DuckDB counterpart, and the driver contract."""

import pytest

from mosaiq import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, sf, same, name):
    same(plans.QUERIES[name](spark, sf), plans.ORACLES[name])


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 25
