"""Incremental propagation against propagation from scratch, and recovery of runs that are over."""

import random

import pytest
from pyspark.sql import functions as F

from jobloom.operators import changes, recovery, workflow, workflow_writes
from jobloom.sources.store import LedgerStore

NOW = "2024-01-02 00:00:00"
STEPS = "id long, workflow_run_id long, step_key string, execution_kind string, status string, job_id long, job_type string, payload string, pending long, unsatisfied long"
EDGES = "workflow_run_id long, prerequisite_step_id long, dependent_step_id long, release_mode string"


def graphs(spark, rng, runs=8, places=7):
    steps, edges = [], []
    for run in range(runs):
        for n in range(places):
            before = [k for k in range(n) if rng.random() < 0.35]
            edges += [(run, run * 100 + k, run * 100 + n, rng.choice(["ON_SUCCESS", "ON_TERMINAL"])) for k in before]
            kind = "EXTERNAL" if rng.random() < 0.2 else "JOB"
            status = "BLOCKED" if before else "WAITING_FOR_EXTERNAL" if kind == "EXTERNAL" else "ENQUEUED"
            steps.append((run * 100 + n, run, f"s{n}", kind, status, None, "t" if kind == "JOB" else None, "{}", len(before), 0))
    return spark.createDataFrame(steps, STEPS), spark.createDataFrame(edges, EDGES)


def state(frame):
    return {r["id"]: (r["status"], r["pending"], r["unsatisfied"]) for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_advance_equals_propagate_after_each_batch(spark, seed):
    rng = random.Random(seed)
    steps, edges = graphs(spark, rng)
    for _ in range(3):
        now = steps.collect()
        ready = [r["id"] for r in now if r["status"] in ("ENQUEUED", "WAITING_FOR_EXTERNAL")]
        blocked = [r["id"] for r in now if r["status"] in ("BLOCKED", "CANCELED", "SUCCEEDED", "FAILED")]
        ends = [(i, rng.choice(["SUCCEEDED", "FAILED", "CANCELED"])) for i in rng.sample(ready, min(6, len(ready)))]
        asked = ends + ends[:2] + [(i, "SUCCEEDED") for i in rng.sample(blocked, min(4, len(blocked)))] + [(-1, "SUCCEEDED")]
        changed = workflow.advance(steps, edges, spark.createDataFrame(asked, "id long, status string"))
        touched = {r["id"] // 100 for r in changed.select("id").collect()}
        assert touched <= {i // 100 for i, _ in ends}
        finished = changes.set_columns(steps.drop("pending", "unsatisfied"), spark.createDataFrame(ends, "id long, status string"), ["id"])
        expected = state(workflow.propagate(finished, edges))
        steps = spark.createDataFrame(changes.set_columns(steps, changed.drop("workflow_run_id"), ["id"]).collect(), STEPS)
        assert state(steps) == expected


def test_only_touched_runs_are_read(spark, tmp_path):
    rng = random.Random(5)
    steps, edges = graphs(spark, rng, runs=40)
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    store.create({"workflow_steps": steps, "workflow_step_dependencies": edges}, buckets=16)
    ready = steps.where("workflow_run_id = 3 AND status = 'ENQUEUED'").select("id", F.lit("FAILED").alias("status"), "workflow_run_id")
    near = {name: store.read_with(name, ready) for name in ("workflow_steps", "workflow_step_dependencies")}
    assert len({f.split("bucket=")[1].split("/")[0] for f in near["workflow_steps"].inputFiles()}) == 1
    some = workflow.advance(near["workflow_steps"], near["workflow_step_dependencies"], ready)
    assert state(some) == state(workflow.advance(steps, edges, ready)) and some.count() > 0


DEFINITIONS = "job_type string, default_priority int, max_attempts int, default_timeout_seconds int, is_enabled boolean"
RUNS = "id long, workflow_type string, organization_id long, status string, idempotency_key string, enqueue_request string, result_step_key string, active_key string"


def finished_ledger(spark):
    new = "ordinal long, step_ordinal long, step_key string, execution_kind string, job_type string, payload string, priority int, max_attempts int, timeout_seconds int, stage string"
    first = spark.createDataFrame([(1, 0, "a", "JOB", "t", '{"old":1}', None, None, None, None), (1, 1, "b", "JOB", "t", "{}", 9, None, None, "late"), (1, 2, "w", "EXTERNAL", None, None, None, None, None, None)], new)
    edges = spark.createDataFrame([(1, "a", "b", "ON_SUCCESS")], "ordinal long, prerequisite_key string, dependent_key string, release_mode string")
    more = spark.createDataFrame([(1, 3, "c", "JOB", "t", "{}", None, None, None, None)], new)
    link = spark.createDataFrame([(1, "b", "c", "ON_TERMINAL"), (1, "w", "c", "ON_SUCCESS")], edges.schema)
    request = workflow_writes.declared(first, edges).first()["request"]
    runs = [
        (1, "f", 7, "SUCCEEDED", "k", request, "c", None), (2, "f", 7, "RUNNING", None, request, None, "held"), (3, "f", 7, "CANCELED", None, None, None, None), (4, "f", 7, "CANCELED", None, "not json", None, None),
        (5, "f", 7, "CANCELED", None, request[:-1] + ',"x":1}', None, None), (6, "f", 7, "CANCELED", None, request, None, "held"), (7, "f", None, "CANCELED", None, request, None, "free"), (8, "f", None, "CANCELED", None, request, None, "free"),
        (9, "f", 7, "SUCCEEDED", None, request, None, None), (10, "f", 7, "SUCCEEDED", None, request, None, None), (11, "f", 7, "SUCCEEDED", None, request, None, None),
    ]
    own = [(100 * r[0] + n, r[0], k, "EXTERNAL" if k == "w" else "JOB", "SUCCEEDED", None, None if k == "w" else "t", '{"new":2}' if k == "a" else "{}" if k != "w" else None, 0, 0) for r in runs for n, k in enumerate("abwc" if r[0] == 1 else "abwd" if r[0] == 10 else "abw")]
    mutations = [(1, 5, "APPEND_STEPS", workflow_writes.declared(more, link).first()["request"]), (9, 6, "DROP_STEPS", "{}"), (11, 7, "APPEND_STEPS", request)]
    return {
        "workflow_runs": spark.createDataFrame(runs, RUNS), "workflow_steps": spark.createDataFrame(own, STEPS), "job_definitions": spark.createDataFrame([("t", 5, 3, 60, True)], DEFINITIONS),
        "workflow_run_mutations": spark.createDataFrame(mutations, "workflow_run_id long, id long, mutation_kind string, request string"),
        "workflow_recoveries": spark.createDataFrame([(77, 1, None, "before", "FULL", "why")], "recovery_run_id long, source_run_id long, source_step_id long, request_key string, mode string, reason string"),
    }


def test_recovery(spark):
    ledger = finished_ledger(spark)
    ask = lambda n, run, key="k", org=7, step=None, reason="why": (n, run, org, step, key, "FULL", reason)
    asked = [
        ask(1, 1), ask(2, 1), ask(3, 1, reason="other"), ask(4, 1, org=8), ask(5, 1, org=None), ask(6, 99), ask(7, 1, "before"), ask(8, 1, "before", reason="other"), ask(9, 2), ask(10, 1, "step", step=201), ask(11, 1, "own", step=101),
        ask(12, 3), ask(13, 4), ask(14, 5), ask(15, 6), ask(16, 7, org=None), ask(17, 8, org=None), ask(18, 9), ask(19, 10), ask(20, 11), ask(21, 3),
    ]
    commands = spark.createDataFrame(asked, "ordinal long, source_run_id long, organization_id long, source_step_id long, request_key string, mode string, reason string")
    change = recovery.recover(ledger, commands, NOW, 1000, 10_000_000, 90_000_000)
    got = {r["ordinal"]: (r["outcome"], r["run_id"]) for r in change.outcomes.collect()}
    assert got == {
        1: ("INSERTED", 1001), 2: ("EXISTING", 1001), 3: ("CONFLICT", None), 4: ("NOT_FOUND", None), 5: ("NOT_FOUND", None), 6: ("NOT_FOUND", None), 7: ("EXISTING", 77), 8: ("CONFLICT", None), 9: ("NOT_TERMINAL", None),
        10: ("STEP_NOT_FOUND", None), 11: ("INSERTED", 1011), 12: ("SNAPSHOT_MISSING", None), 13: ("UNSAFE_SNAPSHOT", None), 14: ("UNSAFE_SNAPSHOT", None), 15: ("ACTIVE_KEY_HELD", None), 16: ("INSERTED", 1016), 17: ("ACTIVE_KEY_HELD", None),
        18: ("UNSAFE_SNAPSHOT", None), 19: ("UNSAFE_SNAPSHOT", None), 20: ("UNSAFE_SNAPSHOT", None), 21: ("SNAPSHOT_MISSING", None),
    }
    steps = {r["step_key"]: r for r in change.upserts["workflow_steps"].where("workflow_run_id = 1001").collect()}
    assert {k: (r["status"], r["total"], r["payload"]) for k, r in steps.items()} == {"a": ("ENQUEUED", 0, '{"new":2}'), "b": ("BLOCKED", 1, "{}"), "w": ("WAITING_FOR_EXTERNAL", 0, None), "c": ("BLOCKED", 2, "{}")}
    names = {r["id"]: k for k, r in steps.items()}
    edges = change.upserts["workflow_step_dependencies"].where("workflow_run_id = 1001").collect()
    assert sorted((names[r["prerequisite_step_id"]], names[r["dependent_step_id"]], r["release_mode"]) for r in edges) == [("a", "b", "ON_SUCCESS"), ("b", "c", "ON_TERMINAL"), ("w", "c", "ON_SUCCESS")]
    runs = {r["id"]: r for r in change.upserts["workflow_runs"].collect()}
    assert (runs[1001]["idempotency_key"], runs[1001]["result_step_key"], runs[1016]["active_key"]) == (None, "c", "free")
    assert {(r["recovery_run_id"], r["source_run_id"], r["source_step_id"]) for r in change.appends["workflow_recoveries"].collect()} == {(1001, 1, None), (1011, 1, 101), (1016, 7, None)}
    assert {(r["job_type"], r["priority"], r["payload"]) for r in change.upserts["job_queue"].where("id >= 90000000").collect()} >= {("t", 5, '{"new":2}')}


def test_a_recovered_run_can_be_recovered(spark):
    ledger = finished_ledger(spark)
    asked = spark.createDataFrame([(1, 1, 7, None, "k", "FULL", "why")], "ordinal long, source_run_id long, organization_id long, source_step_id long, request_key string, mode string, reason string")
    change = recovery.recover(ledger, asked, NOW, 1000, 10_000_000, 90_000_000)
    ended = {"workflow_runs": change.upserts["workflow_runs"].withColumn("status", F.lit("SUCCEEDED")), "workflow_steps": change.upserts["workflow_steps"], "job_definitions": ledger["job_definitions"], "workflow_run_mutations": ledger["workflow_run_mutations"].where("false"), "workflow_recoveries": ledger["workflow_recoveries"].where("false")}
    again = recovery.recover(ended, asked.withColumn("source_run_id", F.lit(1001).cast("long")), NOW, 2000, 20_000_000, 90_000_000)
    assert again.outcomes.first()["outcome"] == "INSERTED"
    assert again.upserts["workflow_steps"].count() == 4 and again.upserts["workflow_step_dependencies"].count() == 3
