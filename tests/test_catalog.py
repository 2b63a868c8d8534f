"""Every registered graph query against its SQL."""

import pytest
from compare import rows

from lattica import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    ours = catalog.QUERIES[name](spark, sf_dir).toPandas()
    theirs = duck.execute(catalog.SQL[name]).df()
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "degree"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
