import math

import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def ordered_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted((tuple(plain(r[n]) for n in order) for r in rows), key=str)


def test_entry_runs(spark):
    assert driver.entry(spark).columns == ["o_orderkey", "split", "noisy"]


def test_every_check_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    got = ordered_rows(df.columns, df.collect())
    if name not in driver.oracle_sql():
        assert got
        return
    cur = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = ordered_rows(columns, cur.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want
