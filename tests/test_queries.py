"""Every registered query of the engine against DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from quillspark.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert rows
    if name in SQL:
        found = duck.execute(SQL[name])
        have = [d[0] for d in found.description]
        assert sorted(have) == names
        assert rows == sorted((tuple(plain(r[have.index(c)]) for c in names) for r in found.fetchall()), key=repr)


def test_column_sets_of_all_pairs_of_tables(spark):
    got = {(r["a"], r["b"]): r["score"] for r in QUERIES["jaccard_column_sets"](spark, FOLDER).collect()}
    assert len(got) == 36 and got["customer", "customer"] == 1 and got["customer", "orders"] == 0 and 0 < got["part", "part"] < 1
