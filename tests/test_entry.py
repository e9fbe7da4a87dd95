"""The driver's contract: names, and Spark against DuckDB on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.jobs import queries as jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(jobs.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = jobs.QUERIES[name](spark, sf_dir)
    wanted = duck.sql(jobs.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    order = sorted(df.columns)
    spark_rows = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    duck_rows = sorted((tuple(plain(v) for v in r) for r in wanted.select(*(f'"{c}"' for c in order)).fetchall()), key=str)
    assert spark_rows == duck_rows


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(jobs.QUERIES) <= set(entry.queries())
