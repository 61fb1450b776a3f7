"""Every query that has SQL gives the rows of that SQL."""

import pytest

from quillon import catalog


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got and got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["n", "k", "o"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
