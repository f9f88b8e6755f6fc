"""Every query with SQL gives the SQL's rows. Validated drafts are made once for all queries over them."""

import datetime
import decimal
import functools
import glob
import os

import duckdb
import pytest

from quayside import catalogue
from quayside.catalogue import records

SF = "/root/testdata/sf0.001"
Q, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.fixture(autouse=True, scope="module")
def made_once():
    kept = {n: getattr(records, n) for n in ("ruled", "validated")}
    for n, f in kept.items():
        setattr(records, n, functools.cache(f))
    yield
    for n, f in kept.items():
        setattr(records, n, f)


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = Q[name](spark, SF)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(n) for n in sorted(names)]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_rows_without_sql(spark, name):
    assert Q[name](spark, SF).count() > 0
