"""Every query of the catalogue runs, and those with SQL agree with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tarnspark.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got
    if name in catalogue.ORACLE:
        cur = db.execute(catalogue.ORACLE[name])
        at = {d[0]: k for k, d in enumerate(cur.description)}
        assert sorted(at) == columns
        assert got == sorted(repr(tuple(r[at[c]] for c in columns)) for r in cur.fetchall())
