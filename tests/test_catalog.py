"""Every conformance query against its SQL in DuckDB, on the small tables."""

import glob
import os

import duckdb
import pytest

from fitgate import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([d[k] for k in order]) for d in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    out = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in out.collect()]
    if name not in catalog.SQL:
        assert got
        return
    cur = db.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(out.columns)
    assert rows(out.columns, got) == rows(names, want)
    assert got or name.startswith("no_")
