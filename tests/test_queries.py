"""Each registered query of the engine against its DuckDB equivalent, on the smallest tables."""

import duckdb
import pytest

from lakeloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    r = duck.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted("|".join(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())
