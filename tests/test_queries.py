"""Every query over the smallest tables, against its SQL where it has one."""

import pytest

from mnemoria.plans import queries
from tests.oracle import connect, rows_of


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    if name in queries.SQL:
        want = con.execute(queries.SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "name", "entity_type", "hop", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
