"""Every query against its SQL twin."""

import pytest

from tributary.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, same):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, SQL[name])
    else:
        assert df.count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
