"""Every table query against its SQL, and the entry points."""

import os

import duckdb
import pytest

import __spark_entry__
from sievegrid.plans import cards, notices, oracle, records, tables

ORACLE_SQL, QUERIES = {**oracle.ORACLE_SQL, **cards.ORACLE_SQL, **notices.ORACLE_SQL, **records.ORACLE_SQL}, {**tables.QUERIES, **cards.QUERIES, **notices.QUERIES, **records.QUERIES}

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted([shown(v) for v in r] for r in got.fetchall()) == sorted([shown(r[c]) for c in columns] for r in df.collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
