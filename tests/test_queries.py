"""Every query with SQL gives the rows that its SQL gives."""

from __future__ import annotations

import pytest
from oracle import connect, spark_rows, sql_rows

from ledgerlens.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, small, name):
    names, rows = spark_rows(registry.QUERIES[name](spark, small))
    want_names, want = sql_rows(connect(small), registry.SQL[name])
    assert names == want_names
    assert rows == want


def test_queries_without_sql_give_rows(spark, small):
    for name in registry.QUERIES.keys() - registry.SQL.keys():
        assert registry.QUERIES[name](spark, small).count() > 0, name


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
