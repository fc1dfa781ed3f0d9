"""Every query with SQL against DuckDB on the smallest tables; the others give rows of a stable schema."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    rel = db.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got = sorted((tuple(str(plain(r[c])) for c in names) for r in df.collect()))
    at = [rel.columns.index(c) for c in names]
    want = sorted(tuple(str(plain(r[k])) for k in at) for r in rel.fetchall())
    assert got == want


def test_flagship(spark):
    assert entry.entry(spark).columns == ["id", "score"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
