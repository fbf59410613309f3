import datetime
import math

import duckdb
import pytest

from quarry.plans import catalog

#: Empty on the smallest tables.
SPARSE = {"crossing_edges", "unique_name_edges"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(i) for i in v)
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    sql = catalog.ORACLES.get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    expected = want.fetchall()
    assert sorted(names) == sorted(got.columns)
    a = sorted((tuple(plain(r[n]) for n in names) for r in rows), key=str)
    b = sorted((tuple(plain(v) for v in r) for r in expected), key=str)
    assert a == b
    assert a or name in SPARSE
