"""Every registered query of the library against its DuckDB twin."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from tessera.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    found = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
