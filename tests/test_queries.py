"""Every engine query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from framewright import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cells(frame):
    columns = sorted(frame.columns)
    return sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        want = db.execute(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert cells(got) == cells(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
