"""Every corpus query against its SQL, on given tables and on a table of odd rows; all of them on empty tables."""

import os

import duckdb
import pytest

from tabflow.llm.queries import ORACLES, QUERIES


def plain(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else "NULL" if value is None else str(value)


def same(spark, name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in result.fetchall())


@pytest.mark.parametrize("name", ORACLES)
def test_given_tables(spark, small, name):
    same(spark, name, small)


@pytest.mark.parametrize("name", ORACLES)
def test_odd_rows(spark, odd, name):
    same(spark, name, odd)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
