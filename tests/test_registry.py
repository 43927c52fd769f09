"""Every registered query against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from colloquy import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) or "" for c in cols] for r in df.collect())
    if name in registry.oracle_sql():
        r = db.execute(registry.oracle_sql()[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == sorted([plain(x[names.index(c)]) or "" for c in cols] for x in r.fetchall())
