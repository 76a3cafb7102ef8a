"""Reaping without a limit: every expired lease, however many there are."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__

NAME = "snk1_reap"


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Tables of a folder with more expired leases than one batch of the query once took."""
    folder = str(tmp_path_factory.mktemp("many"))
    n = F.col("id")
    when = F.lit("2024-01-01").cast("timestamp_ntz")
    tables = {
        "orders": spark.range(0, 300_000, 2).select(n.alias("o_orderkey"), n.alias("o_custkey"), F.lit("P").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), when.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")),
        "lineitem": spark.range(0, 300, 2).select(
            n.alias("l_orderkey"), n.alias("l_partkey"), n.alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"), F.lit(1.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"),
            F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), when.alias("l_shipdate")),
        "events": spark.range(50).select(n.alias("event_id"), when.alias("ts"), n.alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_query_reaps_more_than_a_batch(spark, many):
    import duckdb

    out = f"{many}/found"
    __spark_entry__.queries()[NAME](spark, many).write.parquet(out)
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{many}/{name}.parquet/*.parquet'")
    con.execute(f"CREATE TABLE own AS {__spark_entry__.oracle_sql()[NAME]}")
    con.execute(f"CREATE TABLE found AS SELECT * FROM '{out}/*.parquet'")
    assert con.execute("SELECT CAST(v AS BIGINT) FROM own WHERE k = 'LEASE_EXPIRED'").fetchone()[0] > 100_000
    for a, b in (("own", "found"), ("found", "own")):
        assert con.execute(f"SELECT * FROM (SELECT tbl, k, v FROM {a} EXCEPT ALL SELECT tbl, k, v FROM {b}) LIMIT 3").fetchall() == []
