"""Every query against its SQL, on the smallest tables."""

import math

import pytest

from conftest import DATA
from fitgrid import catalog


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in at] for r in done.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    if name in catalog.ORACLES:
        assert_same(df, duck, catalog.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
