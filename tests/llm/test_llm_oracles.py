"""Queries with a SQL twin give the twin's rows."""

import oracle
import pytest
from conftest import SF

from corpusgrid.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert oracle.compare(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""
