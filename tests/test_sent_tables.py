"""What queries send to all tasks: tables that grow with the ledger never pass through the driver."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from jobloom.operators import lifecycle
from jobloom.operators.changes import Change
from jobloom.sources import storage
from jobloom.sources.adapter import AS_OF, from_star
from jobloom.sources.store import LedgerStore

SF = "/root/testdata/sf0.001"


def sent_by(spark, run):
    """The left keys of every join by broadcast of the plans that ``run`` executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = store.executionsList()
    found = {plans.apply(i).executionId(): plans.apply(i).physicalPlanDescription() for i in range(before, plans.size())}
    assert found
    return {re.sub(r"#\d+L?", "", keys) for text in found.values() for keys in re.findall(r"BroadcastHashJoin[^\n]*\nLeft keys \[\d+\]: \[([^\]]*)\]", text)}


def test_recovery_sends_definitions_alone(spark, tmp_path):
    query = __spark_entry__.queries()["d15_recover"]
    assert sent_by(spark, lambda: query(spark, SF).write.parquet(f"{tmp_path}/out")) <= {"job_type"}


@pytest.fixture
def only_by_hint(spark):
    """Spark sends no table by its own estimate."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")
    yield
    spark.conf.unset(name)


def test_many_expired_leases_are_not_sent(spark, only_by_hint):
    l = from_star(spark, SF)
    for limit, keys in ((2**31 - 1, set()), (None, set()), (5, {"job_id"})):
        rows = lambda limit=limit: lifecycle.reap_decisions(l["job_queue"], l["job_attempts"], l["job_events"], AS_OF, limit).write.format("noop").mode("overwrite").save()
        assert sent_by(spark, rows) == keys


def test_large_batches_meet_the_ledger_by_key(spark, monkeypatch, tmp_path):
    queue = spark.createDataFrame([(i, "PENDING", None) for i in range(20)], "id long, status string, note string")
    claims = spark.createDataFrame([(f"r{i}", i) for i in range(20)], "resource_key string, job_id long")
    for few, sent in ((storage.FEW, True), (1, False)):
        monkeypatch.setattr(storage, "FEW", few)
        store = LedgerStore(spark, f"{tmp_path}/{few}")
        store.create({"job_queue": queue, "job_execution_resource_claims": claims}, buckets=2)
        change = Change({"job_queue": queue.where("id < 5").withColumn("status", F.lit("LEASED"))}, {}, {"job_execution_resource_claims": claims.where("job_id < 5")}, updates={"job_queue": queue.where("id > 7").select("id", F.lit("x").alias("note"))})
        assert bool(sent_by(spark, lambda store=store, change=change: store.apply(1, change))) == sent
        after = store.read()
        assert sorted((r["id"], r["status"], r["note"]) for r in after["job_queue"].collect()) == [(i, "LEASED" if i < 5 else "PENDING", "x" if i > 7 else None) for i in range(20)]
        assert sorted(r["job_id"] for r in after["job_execution_resource_claims"].collect()) == list(range(5, 20))
