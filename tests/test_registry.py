"""Every ledger query with an oracle gives the oracle's rows on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from jobloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return float(value) if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    expected = duck.sql(registry.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(expected.columns)
    assert rows(frame.columns, frame.collect()) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(registry.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_is_pruned(spark):
    from jobloom.operators import reads
    from jobloom.sources.adapter import from_star

    found = reads.list_job_summaries(from_star(spark, SF)["job_queue"], job_type="jobs.p2")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1]
