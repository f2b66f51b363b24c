"""Every registered query with a SQL twin gives the twin's rows; every other query gives a stable schema."""

import oracle
import pytest
from conftest import SF

from corpusgrid.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert oracle.compare(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"e6_coordinate_search", "g9_repair"}))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.count() > 0 and df.columns


def test_entry_point_without_llm():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
