"""Every query against its DuckDB SQL at the smallest size."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from episodic.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    cursor = duck.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    order = sorted(df.columns)
    assert order == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(oracle_sql()) <= set(entry.queries())
