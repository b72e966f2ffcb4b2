"""Every core query with SQL against DuckDB on whole tables."""

import pytest
from conftest import DATA, canonical

from brindle.plans import queries as core

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours = core.queries()[name](spark, f"{DATA}/sf0.01").toPandas()
    theirs = duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert core.queries()[name](spark, f"{DATA}/sf0.001").count() > 0


def test_sql_has_queries():
    assert set(SQL) <= set(core.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
