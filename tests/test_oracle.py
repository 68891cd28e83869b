"""Every query that has SQL returns the rows that DuckDB does."""

import pytest

import __spark_entry__ as entry
from conftest import DATA, as_rows


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_same_rows(spark, duck, name):
    ours = entry.queries()[name](spark, DATA).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert as_rows(ours) == as_rows(theirs)


def test_every_query_has_sql_or_is_known_not_to():
    """Queries of the record engine all have SQL."""
    assert {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"} == {n for n in entry.oracle_sql() if not n.startswith("op")}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
