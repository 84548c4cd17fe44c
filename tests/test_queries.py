"""Every query with SQL against DuckDB on the smallest tables; the others give rows with the same columns each time."""

import oracle
import pytest

from vellumry.plans import registry

SF = f"{oracle.DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert oracle.difference(registry.QUERIES[name], registry.ORACLE_SQL[name], spark, SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() == len(df.collect())
