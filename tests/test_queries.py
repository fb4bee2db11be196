"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import datetime

import duckdb
import pytest
from lodestone.plans import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v) if not isinstance(v, datetime.datetime) else v.isoformat()


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, tables, name):
    df = engine.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = engine.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = tables.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
