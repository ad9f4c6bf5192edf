"""Every catalogued query against its SQL, over whole small tables."""

import datetime
import glob
import os

import pytest

from wicker import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    expected = duck.sql(catalog.oracle_sql()[name])
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)
