import os

import duckdb
import pytest

from geoweft.queries import ORACLE, QUERIES

from .conftest import SMALL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    want = db.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
