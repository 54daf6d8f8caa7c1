"""Every registered query of the library's own operators against its SQL in DuckDB."""

import decimal
import glob
import os

import duckdb
import pytest

from strandlake import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 8)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 8)
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, db, name):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = db.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(row[i]) for i in at) for row in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
