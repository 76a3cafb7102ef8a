"""Workflow writes, resource keys and resource claims on small ledgers."""

import pytest
from pyspark.sql import functions as F

from jobloom.operators import changes, claims, lifecycle, workflow, workflow_writes

NOW = "2024-01-02 00:00:00"
STEPS = "ordinal long, step_ordinal long, step_key string, execution_kind string, job_type string, payload string, priority int, max_attempts int, timeout_seconds int, stage string"
EDGES = "ordinal long, prerequisite_key string, dependent_key string, release_mode string"
RUNS = "ordinal long, workflow_type string, organization_id long, idempotency_key string, result_step_key string"


def definitions(spark):
    return spark.createDataFrame([("t", 5, 3, 60, True), ("off", 5, 3, 60, False)], "job_type string, default_priority int, max_attempts int, default_timeout_seconds int, is_enabled boolean")


def step(ordinal, number, key, kind="JOB", job_type="t", priority=None):
    return (ordinal, number, key, kind, job_type if kind == "JOB" else None, "{}", priority, None, None, None)


def no_runs(spark):
    return spark.createDataFrame([], "id long, workflow_type string, organization_id long, status string, idempotency_key string, enqueue_request string")


@pytest.fixture(scope="module")
def enqueued(spark):
    runs = [(1, "w", None, "k", "b"), (2, "w", None, "k", "b"), (3, "w", None, "k", "b"), (4, "w", 7, "k", None), (5, "w", None, None, None), (6, "w", None, None, None), (7, "w", None, None, None)]
    steps = [step(r, 10 * r + n, k) for r in (1, 2, 3) for n, k in enumerate("ab")] + [step(4, 40, "x", "EXTERNAL"), step(5, 50, "a"), step(5, 51, "a"), step(6, 60, "a", job_type="off"), step(7, 70, "a"), step(7, 71, "b")]
    edges = [(1, "a", "b", None), (2, "a", "b", "ON_TERMINAL"), (3, "a", "b", "ON_SUCCESS"), (7, "a", "b", None), (7, "b", "a", None)]
    ledger = {"job_definitions": definitions(spark), "workflow_runs": no_runs(spark)}
    return workflow_writes.enqueue_runs(ledger, spark.createDataFrame(runs, RUNS), spark.createDataFrame(steps, STEPS), spark.createDataFrame(edges, EDGES), NOW, 100, 1000, 5000)


def test_enqueue_decides_and_releases_roots(enqueued):
    assert {r["ordinal"]: (r["outcome"], r["run_id"]) for r in enqueued.outcomes.collect()} == {
        1: ("INSERTED", 101), 2: ("EXISTING", 101), 3: ("CONFLICT", None), 4: ("INSERTED", 104), 5: ("INVALID", None), 6: ("NO_ENABLED_DEFINITION", None), 7: ("INVALID", None),
    }
    assert {(r["id"], r["status"], r["pending"], r["job_id"]) for r in enqueued.upserts["workflow_steps"].collect()} == {(1010, "ENQUEUED", 0, 6010), (1011, "BLOCKED", 1, None), (1040, "WAITING_FOR_EXTERNAL", 0, None)}
    assert {(r["id"], r["job_type"], r["priority"], r["max_attempts"], r["status"]) for r in enqueued.upserts["job_queue"].collect()} == {(6010, "t", 5, 3, "PENDING")}
    assert {(r["id"], r["status"]) for r in enqueued.upserts["workflow_runs"].collect()} == {(101, "RUNNING"), (104, "WAITING_FOR_EXTERNAL")}
    assert [(r["prerequisite_step_id"], r["dependent_step_id"], r["release_mode"]) for r in enqueued.upserts["workflow_step_dependencies"].collect()] == [(1010, 1011, "ON_TERMINAL")]


def test_the_same_request_again(spark, enqueued):
    ledger = {"job_definitions": definitions(spark), "workflow_runs": changes.upsert(no_runs(spark), enqueued.upserts["workflow_runs"], ["id"])}
    runs = spark.createDataFrame([(1, "w", None, "k", "b"), (2, "w", 7, "k", None)], RUNS)
    steps = spark.createDataFrame([step(1, 2, "b"), step(1, 1, "a"), step(2, 3, "y", "EXTERNAL")], STEPS)
    again = workflow_writes.enqueue_runs(ledger, runs, steps, spark.createDataFrame([(1, "a", "b", None)], EDGES), NOW, 200, 2000, 5000)
    assert {r["ordinal"]: (r["outcome"], r["run_id"]) for r in again.outcomes.collect()} == {1: ("EXISTING", 101), 2: ("CONFLICT", 104)}
    assert again.upserts["workflow_steps"].count() == 0


LEDGER = "id long, workflow_run_id long, step_key string, execution_kind string, status string, job_id long, job_type string, payload string"


def small(spark):
    steps = [(1, 1, "a", "JOB", "SUCCEEDED", 11, "t", "{}"), (2, 1, "b", "JOB", "BLOCKED", None, "t", '{"x":1}'), (3, 1, "w", "EXTERNAL", "WAITING_FOR_EXTERNAL", None, None, None), (4, 1, "f", "JOB", "FAILED", 14, "t", "{}"), (5, 1, "g", "JOB", "BLOCKED", None, "t", "{}"), (6, 2, "a", "JOB", "BLOCKED", None, "t", "{}")]
    edges = [(1, 1, 2, "ON_SUCCESS"), (1, 4, 5, "ON_SUCCESS")]
    return {
        "workflow_steps": spark.createDataFrame(steps, LEDGER), "workflow_step_dependencies": spark.createDataFrame(edges, "workflow_run_id long, prerequisite_step_id long, dependent_step_id long, release_mode string"),
        "workflow_runs": spark.createDataFrame([(1, 7, "RUNNING"), (2, None, "CANCELED")], "id long, organization_id long, status string"), "job_definitions": definitions(spark),
        "job_queue": spark.createDataFrame([(11, "SUCCEEDED")], "id long, status string"), "job_events": spark.createDataFrame([], "job_id long, event_type string"),
    }


def test_release_makes_jobs_and_cancels(spark):
    ledger = small(spark)
    change = workflow_writes.release(ledger, NOW, 500)
    after = change.apply(ledger)
    assert {(r["id"], r["status"], r["job_id"]) for r in after["workflow_steps"].collect()} == {(1, "SUCCEEDED", 11), (2, "ENQUEUED", 502), (3, "WAITING_FOR_EXTERNAL", None), (4, "FAILED", 14), (5, "CANCELED", None), (6, "BLOCKED", None)}
    job = change.upserts["job_queue"].first()
    assert (job["id"], job["organization_id"], job["job_type"], job["payload"], job["priority"]) == (502, 7, "t", '{"x":1}', 5)
    assert after["job_queue"].count() == 2 and after["job_events"].count() == 1
    assert {(r["id"], r["status"]) for r in after["workflow_runs"].collect()} == {(1, "RUNNING"), (2, "CANCELED")}


def test_append_through_a_window(spark):
    ledger = small(spark)
    commands = spark.createDataFrame([(1, 3), (2, 1), (3, 99), (4, 3), (5, 3)], "ordinal long, window_step_id long")
    steps = [step(1, 1, "n1"), step(1, 2, "n2"), step(1, 3, "n3"), step(1, 4, "n4", "EXTERNAL"), step(2, 5, "m"), step(3, 6, "m"), step(4, 7, "a"), step(5, 8, "m")]
    edges = [(1, "a", "n1", "ON_SUCCESS"), (1, "n1", "n2", None), (1, "f", "n3", "ON_SUCCESS"), (5, "nowhere", "m", None)]
    change = workflow_writes.append_steps(ledger, commands, spark.createDataFrame(steps, STEPS), spark.createDataFrame(edges, EDGES), NOW, 100, 500)
    assert {r["ordinal"]: r["outcome"] for r in change.outcomes.collect()} == {1: "APPENDED", 2: "WINDOW_CLOSED", 3: "NOT_FOUND", 4: "INVALID", 5: "INVALID"}
    assert {(r["step_key"], r["status"], r["total"], r["pending"]) for r in change.upserts["workflow_steps"].collect()} == {("n1", "ENQUEUED", 1, 0), ("n2", "BLOCKED", 1, 1), ("n3", "CANCELED", 1, 0), ("n4", "WAITING_FOR_EXTERNAL", 0, 0)}
    assert [r["id"] for r in change.upserts["job_queue"].collect()] == [601]
    assert change.upserts["workflow_step_dependencies"].count() == 3


def test_same_append(spark):
    steps, edges = spark.createDataFrame([step(1, 1, "a"), step(1, 2, "b")], STEPS), spark.createDataFrame([(1, "a", "b", None)], EDGES)
    request = workflow_writes.declared(steps, edges)
    turned = spark.createDataFrame([step(1, 9, "b"), step(1, 8, "a")], STEPS)
    assert [r["same"] for r in workflow_writes.same_append(request, turned, edges).collect()] == [True]
    assert [r["same"] for r in workflow_writes.same_append(request, turned, edges.where("false")).collect()] == [False]


def test_steps_follow_jobs_and_keep_their_start(spark):
    steps = spark.createDataFrame([(1, 11, "ENQUEUED", None), (2, 12, "ENQUEUED", "2024-01-01 00:00:00"), (3, 13, "RUNNING", None), (4, 14, "SUCCEEDED", None)], "id long, job_id long, status string, started string").withColumn("started_at", F.col("started").cast("timestamp_ntz")).drop("started")
    jobs = spark.createDataFrame([(11, "LEASED"), (12, "LEASED"), (13, "DEAD_LETTERED"), (14, "LEASED")], "id long, status string")
    after = {r["id"]: (r["status"], str(r["started_at"])) for r in workflow_writes.follow_jobs(steps, jobs, NOW).apply({"workflow_steps": steps})["workflow_steps"].collect()}
    assert after == {1: ("RUNNING", NOW), 2: ("RUNNING", "2024-01-01 00:00:00"), 3: ("FAILED", "None"), 4: ("SUCCEEDED", "None")}


def test_enqueue_with_a_resource(spark):
    jobs = spark.createDataFrame([], "id long, job_type string, organization_id long, idempotency_key string, enqueue_request string")
    asked = [(n, "t", None, "{}", None, None, None, k, None, r) for n, k, r in ((1, None, "db"), (2, None, "  "), (3, None, "x" * 513), (4, "k", None), (5, "k", "db"), (6, None, None))]
    commands = spark.createDataFrame(asked, "ordinal long, job_type string, organization_id long, payload string, priority int, max_attempts int, next_run_at timestamp_ntz, idempotency_key string, stage string, execution_resource_key string")
    change = lifecycle.enqueue(jobs, definitions(spark), commands, NOW, 100)
    assert {r["ordinal"]: r["outcome"] for r in change.outcomes.collect()} == {1: "INSERTED", 2: "INVALID_RESOURCE", 3: "INVALID_RESOURCE", 4: "INSERTED", 5: "CONFLICT", 6: "INSERTED"}
    assert {(r["id"], r["execution_resource_key"]) for r in change.upserts["job_queue"].collect()} == {(101, "db"), (104, None), (106, None)}


def test_active_keys_are_an_organizations_own(spark):
    runs = spark.createDataFrame([(1, "w", 7, "RUNNING", "k"), (2, "w", 8, "SUCCEEDED", "k")], "id long, workflow_type string, organization_id long, status string, active_key string")
    commands = spark.createDataFrame([(1, "other", 7, "k"), (2, "w", 8, "k"), (3, "v", 8, "k"), (4, "w", None, "k"), (5, "w", 7, None), (6, "w", 7, None)], "ordinal long, workflow_type string, organization_id long, active_key string")
    got = {r["ordinal"]: (r["outcome"], r["run_id"], r["enqueued_by"]) for r in workflow.active_key(runs, commands).collect()}
    assert got == {1: ("EXISTING", 1, None), 2: ("ENQUEUED", None, 2), 3: ("EXISTING", None, 2), 4: ("ENQUEUED", None, 4), 5: ("ENQUEUED", None, 5), 6: ("ENQUEUED", None, 6)}


def test_held_resources_and_quiet_leases(spark):
    jobs = spark.createDataFrame([(1, "PENDING", "r", None), (2, "CANCELED", "s", "2024-01-03 00:00:00"), (3, "CANCELED", "s", "2024-01-01 00:00:00"), (4, "CANCELED", None, None)], "id long, status string, execution_resource_key string, until string").withColumn("lease_expires_at", F.col("until").cast("timestamp_ntz"))
    assert sorted(r["id"] for r in claims.quiesced(jobs, NOW).collect()) == [3, 4]
    taken = spark.createDataFrame([("r", 9), ("s", 2)], "resource_key string, job_id long")
    assert sorted((r["id"], r["holder"]) for r in claims.not_acquired(jobs, taken).collect()) == [(1, 9), (3, 2)]


def test_set_columns_writes_nulls_and_adds_nothing(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, v string, w string")
    rows = spark.createDataFrame([(1, None), (3, "c")], "id long, v string").withColumn("unknown", F.lit(1))
    assert sorted(map(tuple, changes.set_columns(base, rows, ["id"]).collect())) == [(1, None, "x"), (2, "b", "y")]


def test_a_stream_without_repeats(spark, tmp_path):
    from jobloom.streaming.job_states import without_repeats

    rows = [("t", 1, "k", "2024-01-01 00:00:00"), ("t", 1, "k", "2024-01-01 00:10:00"), ("t", 2, "k", "2024-01-01 00:10:00"), ("t", 1, "l", "2024-01-01 00:20:00")]
    table = spark.createDataFrame(rows, "job_type string, organization_id long, idempotency_key string, t string").select("job_type", "organization_id", "idempotency_key", F.col("t").cast("timestamp").alias("at"))
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    query = without_repeats(stream).writeStream.format("memory").queryName("commands_once").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["organization_id"], r["idempotency_key"]) for r in spark.table("commands_once").collect())
    assert got == [(1, "k"), (1, "l"), (2, "k")]


def test_a_required_configuration(spark):
    from jobloom.operators import reads

    configs = spark.createDataFrame([("a", 1)], "job_type string, schema_version int")
    assert reads.required_runtime_config(configs, "a").count() == 1
    with pytest.raises(LookupError, match="b"):
        reads.required_runtime_config(configs, "b")


@pytest.mark.parametrize("limit, offset", [(0, 0), (1001, 0), (1, -1)])
def test_pages_have_bounds(spark, limit, offset):
    from jobloom.operators import reads

    rows = spark.createDataFrame([], "id long, workflow_run_id long, created_at timestamp_ntz, organization_id long")
    with pytest.raises(ValueError):
        reads.page_of_steps(rows, rows, 1, limit=limit, offset=offset)
