"""Every engine query against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from orbweave.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def key(row):
    return tuple((v is None, str(type(v)), v) for v in row)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_same_rows(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = con.sql(catalog.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    assert {c: kinds[str(t)] for c, t in zip(want.columns, want.types, strict=True)} == dict(got.dtypes)
    a = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    b = sorted(want.select(*columns).fetchall(), key=key)
    assert a == b
