"""The registered queries against SQL where there is some, and their shapes on all tables."""

import pytest

import __spark_entry__ as entry
from conftest import DATA, as_rows
from recordloom.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours = entry.queries()[name](spark, DATA).toPandas()
    theirs = duck.execute(oracle.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert as_rows(ours) == as_rows(theirs)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert "pipeline" in entry.queries()
