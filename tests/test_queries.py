"""Every query with SQL gives DuckDB's rows, whatever the number of partitions."""

import os

import duckdb
import pytest

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES, SQL = registered.queries(), registered.oracle_sql()
OWN = sorted(n for n in SQL if not n.startswith("op"))


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: "null" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", ["pack_windows", "line_dedup_threshold", "near_dedup", "shard_assign"])
def test_partitions_do_not_matter(spark, duck, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(SQL[name]).df())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
