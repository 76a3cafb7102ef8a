"""Transitions, graphs, JSON and schedules on small ledgers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobloom.functions.json_text import canonical, set_field
from jobloom.functions.predicates import Scope, before_cursor, check_page, continuation_is_valid
from jobloom.functions.timing import hint_after, retry_at
from jobloom.operators import changes, claims, intents, lifecycle, schedules, workflow

NOW = "2024-01-02 00:00:00"
JOB = (
    "id long, job_type string, organization_id long, payload string, status string, priority int, run_number int, attempt int, max_attempts int, next_run_at timestamp_ntz, lease_expires_at timestamp_ntz, "
    "worker_id string, stage string, progress_done long, progress_total long, idempotency_key string, enqueue_request string, execution_resource_key string, created_at timestamp_ntz"
)


def at(text):
    return datetime.fromisoformat(text)


def jobs(spark, *rows):
    base = {"job_type": "a", "organization_id": None, "payload": "{}", "status": "PENDING", "priority": 1, "run_number": 1, "attempt": 0, "max_attempts": 3, "next_run_at": at("2024-01-01"), "stage": "queued", "created_at": at("2024-01-01")}
    names = [x.split()[0] for x in JOB.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], JOB)


def leased(i, **more):
    return {"id": i, "status": "LEASED", "attempt": 1, "worker_id": "w", "lease_expires_at": at("2024-01-03")} | more


def ids(frame, column="id"):
    return sorted(r[column] for r in frame.collect())


def fence(spark, *rows, more=""):
    return spark.createDataFrame(list(rows), "id long, run_number int, attempt int, worker_id string" + more)


def test_scopes():
    assert Scope.from_legacy(None) == Scope.admin() != Scope.tenantless()
    with pytest.raises(ValueError):
        Scope.admin().exactly()
    for bad in ((0, 0), (1001, 0), (1, -1)):
        with pytest.raises(ValueError):
            check_page(*bad)


def test_cursor_breaks_ties_by_id(spark):
    rows = jobs(spark, {"id": 1}, {"id": 2}, {"id": 3})
    assert ids(rows.where(before_cursor("2024-01-01 00:00:00", 3))) == [1, 2]


@pytest.mark.parametrize(
    ("payload", "good"),
    [
        ('{"reason":"HANDLER_CONTINUATION","next_run_number":2,"next_run_at":"2024-02-01T00:00:00Z","delay_microseconds":0}', True),
        ('{"reason":"HANDLER_CONTINUATION","requeue_kind":null,"next_run_number":2,"next_run_at":"2024-02-01T00:00:00Z","delay_microseconds":0}', False),
        ('{"reason":"HANDLER_CONTINUATION","next_run_number":3,"next_run_at":"2024-02-01T00:00:00Z","delay_microseconds":0}', False),
        ('{"reason":"HANDLER_CONTINUATION","next_run_number":"2","next_run_at":"2024-02-01T00:00:00Z","delay_microseconds":0}', False),
        ('{"reason":"HANDLER_CONTINUATION","next_run_number":2,"next_run_at":"2024-13-01T00:00:00Z","delay_microseconds":0}', False),
        ("[]", False), ("no json", False), (None, False),
    ],
)
def test_continuation_payloads(spark, payload, good):
    row = spark.createDataFrame([(payload, 1)], "payload string, run_number int")
    assert row.select(continuation_is_valid()).first()[0] is good


def test_canonical_json():
    assert canonical('{"b":1.0,"a":[1e1,null]}') == canonical(' {"a":[10,null],"b":1}') == '{"a":[10,null],"b":1}'
    assert canonical('{"a":1,"a":2}') == '{"a":2}' and canonical("{") is None and canonical(None) is None
    assert set_field('{"a":1}', "b", "[2]") == '{"a":1,"b":[2]}' and set_field("[]", "b", "1") is None


def test_one_claim_per_resource(spark):
    rows = jobs(spark, {"id": 1, "execution_resource_key": "r"}, {"id": 2, "execution_resource_key": "r", "priority": 9}, {"id": 3, "execution_resource_key": "taken"}, {"id": 4}, {"id": 5, "next_run_at": at("2024-02-01")})
    taken = spark.createDataFrame([("taken", 99, at("2024-01-05"))], "resource_key string, job_id long, lease_expires_at timestamp_ntz")
    change = claims.claim(rows, taken, "w", 60, NOW, 10)
    assert ids(change.upserts["job_queue"]) == [2, 4]
    assert ids(change.appends["job_execution_resource_claims"], "job_id") == [2]
    assert claims.candidates(rows, taken, NOW, 10, []).count() == 0
    assert [claims.resource_window(x) for x in (1, 16, 100, 10_000)] == [1024, 1024, 6400, 16384]
    after = change.apply({"job_queue": rows, "job_attempts": spark.createDataFrame([], "job_id long, run_number int, attempt int"), "job_events": spark.createDataFrame([], "job_id long, event_type string"), "job_execution_resource_claims": taken})
    assert ids(after["job_queue"].where("status = 'LEASED'")) == [2, 4] and after["job_queue"].count() == 5


def test_fence_and_failures(spark):
    rows = jobs(spark, leased(1), leased(2, attempt=3), leased(3), leased(4, lease_expires_at=at("2024-01-01")))
    commands = fence(spark, (1, 1, 1, "w", "RETRYABLE", "e", None), (2, 1, 3, "w", "TIMEOUT", "e", None), (3, 1, 2, "w", "RETRYABLE", "e", None), (4, 1, 1, "w", "RETRYABLE", "e", None), more=", kind string, error_code string, not_before timestamp_ntz")
    change = lifecycle.fail(rows, commands, NOW)
    after = {r["id"]: r for r in change.upserts["job_queue"].collect()}
    assert {k: r["status"] for k, r in after.items()} == {1: "PENDING", 2: "DEAD_LETTERED"}
    assert after[1]["next_run_at"] == datetime(2024, 1, 2, 0, 0, 9, 501000)
    assert sorted((r["job_id"], r["event_type"]) for r in change.appends["job_events"].collect()) == [(1, "FAILED"), (1, "RETRY_SCHEDULED"), (2, "DEAD_LETTERED"), (2, "FAILED")]


def test_retry_hints(spark):
    rows = [(at("2024-01-01"), None, 1_000_001), (at("2024-01-01"), None, 1_000_000), (at("2024-01-01"), at("2024-01-01T00:00:01.000001"), 0), (at("2024-01-01"), None, None)]
    row = spark.createDataFrame(rows, "a timestamp_ntz, h timestamp_ntz, d long")
    when, whose = retry_at(F.col("a"), F.lit(1000), F.coalesce("h", hint_after(F.col("a"), F.col("d"))))
    second = at("2024-01-01T00:00:01")
    assert [tuple(r) for r in row.select(when, whose).collect()] == [(at("2024-01-01T00:00:01.001000"), "HANDLER"), (second, "POLICY"), (at("2024-01-01T00:00:01.000001"), "HANDLER"), (second, "POLICY")]


def test_other_transitions(spark):
    rows = jobs(spark, leased(1, execution_resource_key="r"), leased(2), {"id": 3, "status": "SUCCEEDED"})
    own = fence(spark, (1, 1, 1, "w"))
    assert lifecycle.succeed(rows, own, NOW).upserts["job_queue"].first()["status"] == "SUCCEEDED"
    assert lifecycle.heartbeat(rows, own, 60, NOW).upserts["job_queue"].first()["lease_expires_at"] == at("2024-01-02T00:01:00")
    assert lifecycle.mark_running(rows, own, NOW).upserts["job_queue"].first()["stage"] == "running"
    went_on = lifecycle.continue_after(rows, fence(spark, (1, 1, 1, "w", 1_500_001), more=", delay_us long"), NOW).upserts["job_queue"].first()
    assert (went_on["run_number"], went_on["attempt"], went_on["next_run_at"]) == (2, 0, at("2024-01-02T00:00:01.500001"))
    part = lifecycle.progress(rows, fence(spark, (1, 1, 1, "w", 5, None, None), (2, 1, 1, "w", 5, 3, None), more=", new_done long, new_total long, new_stage string"), NOW)
    assert {tuple(r) for r in part.outcomes.collect()} == {(1, "UPDATED"), (2, "INVALID")}
    back = claims.release_unstarted(rows, own, NOW).upserts["job_queue"].first()
    assert (back["status"], back["attempt"]) == ("PENDING", 0)
    again = lifecycle.replay(rows, spark.createDataFrame([], "source_job_id long, source_run_number int, replay_request_key string, reason string, replay_job_id long"), spark.createDataFrame([(0, 3, 1, "k", "x"), (1, 3, 1, "k", "x"), (2, 2, 1, "k", "x")], "ordinal long, source_job_id long, source_run_number int, replay_request_key string, reason string"), NOW, 100)
    assert {tuple(r) for r in again.outcomes.collect()} == {(0, "REPLAYED"), (1, "EXISTING"), (2, "EXPECTATION_MISMATCH")}
    reaped = lifecycle.reap(jobs(spark, leased(1, lease_expires_at=at("2024-01-01")), leased(2, attempt=3, lease_expires_at=at("2024-01-01"))), spark.createDataFrame([(1, 1, 1, "PRESTART", None)], "job_id long, run_number int, attempt int, claim_origin string, execution_started_persisted_at timestamp_ntz"), spark.createDataFrame([], "id long, job_id long, run_number int, attempt int, event_type string, stage string, occurred_at timestamp_ntz"), NOW, 10)
    assert {(r["id"], r["status"], r["attempt"]) for r in reaped.upserts["job_queue"].collect()} == {(1, "PENDING", 0), (2, "DEAD_LETTERED", 3)}


def test_idempotent_enqueue(spark):
    definitions = spark.createDataFrame([("a", 5, 7, True), ("off", 5, 7, False)], "job_type string, default_priority int, max_attempts int, is_enabled boolean")
    command = "ordinal long, job_type string, organization_id long, payload string, priority int, max_attempts int, next_run_at timestamp_ntz, idempotency_key string, stage string"
    asked = spark.createDataFrame([(0, "a", None, "{}", None, None, None, "k", None), (1, "a", None, "{}", None, None, None, "k", None), (2, "a", None, '{"x":1}', None, None, None, "k", None), (3, "off", None, "{}", None, None, None, None, None), (4, "a", 1, "{}", 2, None, None, "k", None)], command)
    change = lifecycle.enqueue(jobs(spark, {"id": 50}), definitions, asked, NOW, 100)
    assert {tuple(r) for r in change.outcomes.collect()} == {(0, "INSERTED", 100), (1, "EXISTING", 100), (2, "CONFLICT", None), (3, "NO_ENABLED_DEFINITION", None), (4, "INSERTED", 104)}
    new = change.upserts["job_queue"]
    assert {(r["id"], r["priority"], r["max_attempts"]) for r in new.collect()} == {(100, 5, 7), (104, 2, 7)}
    once_more = lifecycle.enqueue(changes.upsert(jobs(spark, {"id": 50}), new, ["id"]), definitions, asked.where("ordinal in (1, 2)"), NOW, 200)
    assert {tuple(r) for r in once_more.outcomes.collect()} == {(1, "EXISTING", 100), (2, "CONFLICT", 100)}


def test_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, changes.upsert(base, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, changes.insert_missing(base, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, changes.update_from(base, new, ["id"], ["v"]).collect())) == [(1, "a"), (2, "c")]
    rest, gone = changes.delete_oldest(base, F.lit(True), [F.asc("id")], 1)
    assert ids(rest) == [2] and ids(gone) == [1]
    stamped = changes.upsert_if_changed(base.withColumn("s", F.lit(0)), spark.createDataFrame([(1, "a"), (2, "z")], "id long, v string"), ["id"], ["v"], ("s", F.lit(9)))
    assert sorted(map(tuple, stamped.collect())) == [(1, "a", 0), (2, "z", 9)]
    assert spark.createDataFrame([('[{"k":"x","n":null}]',)], "j string").select(F.inline(changes.rows_from_json("j", "k:string,n:int"))).collect()[0] == ("x", None)


STEP = "id long, workflow_run_id long, step_key string, execution_kind string, status string"


def test_propagation_cascades(spark):
    steps = spark.createDataFrame([(1, 1, "a", "JOB", "FAILED"), (2, 1, "b", "JOB", "BLOCKED"), (3, 1, "c", "JOB", "BLOCKED"), (4, 1, "d", "EXTERNAL", "BLOCKED"), (5, 1, "e", "JOB", "BLOCKED")], STEP)
    edges = spark.createDataFrame([(1, 1, 2, "ON_SUCCESS"), (1, 2, 3, "ON_SUCCESS"), (1, 3, 4, "ON_TERMINAL"), (1, 4, 5, "ON_TERMINAL")], "workflow_run_id long, prerequisite_step_id long, dependent_step_id long, release_mode string")
    after = {r["id"]: r["status"] for r in workflow.propagate(steps, edges).collect()}
    assert after == {1: "FAILED", 2: "CANCELED", 3: "CANCELED", 4: "WAITING_FOR_EXTERNAL", 5: "BLOCKED"}
    assert sorted(r["id"] for r in workflow.downstream(edges, steps.where("id = 2")).collect()) == [3, 4, 5]


def test_graph_errors(spark):
    steps = spark.createDataFrame([(1, "a"), (1, "a"), (1, " "), (1, "b")], "workflow_run_id long, step_key string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "x", "b"), (1, "b", "b"), (1, "a", "b")], "workflow_run_id long, prerequisite_key string, dependent_key string")
    assert {(r["error"], r["step_key"]) for r in workflow.structure_errors(steps, edges).collect()} == {("BLANK_KEY", " "), ("DUPLICATE_KEY", "a"), ("MISSING_PREREQUISITE", "b"), ("SELF_DEPENDENCY", "b"), ("DUPLICATE_DEPENDENCY", "b")}
    assert sorted(r["step_key"] for r in workflow.cycles(edges).collect()) == ["a", "b"]


def test_external_completion(spark):
    steps = spark.createDataFrame([(1, 1, "a", "EXTERNAL", "WAITING_FOR_EXTERNAL", None), (2, 1, "b", "EXTERNAL", "SUCCEEDED", '{"v": 1.0}'), (3, 1, "c", "JOB", "RUNNING", None)], STEP + ", output string")
    commands = spark.createDataFrame([(1, "SUCCEEDED", "{}"), (2, "SUCCEEDED", '{"v":1}'), (3, "SUCCEEDED", "{}"), (9, "SUCCEEDED", "{}")], "id long, new_status string, new_output string")
    assert {(r["id"], r["outcome"]) for r in workflow.complete_external(steps, commands, NOW).collect()} == {(1, "COMPLETED"), (2, "ALREADY_COMPLETED"), (3, "NOT_EXTERNAL"), (9, "NOT_FOUND")}


def test_outbox(spark):
    table = spark.createDataFrame([], "id long, job_type string, organization_id long, idempotency_key string, enqueue_request string, status string, promotion_attempts int, next_promotion_at timestamp_ntz, promoted_job_id long, promoted_at timestamp_ntz, conflicted_at timestamp_ntz, created_at timestamp_ntz")
    asked = spark.createDataFrame([(0, "a", None, "k", '{"n":1}'), (1, "a", None, "k", '{"n":1.0}'), (2, "a", None, "k", '{"n":2}'), (3, "a", 1, "k", "{}")], "ordinal long, job_type string, organization_id long, idempotency_key string, enqueue_request string")
    change = intents.record(table, asked, NOW, 10)
    assert {tuple(r) for r in change.outcomes.collect()} == {(0, "INSERTED"), (1, "EXISTING"), (2, "CONFLICT"), (3, "INSERTED")}
    after = change.apply({"job_enqueue_intents": table})["job_enqueue_intents"]
    definitions = spark.createDataFrame([("a", 5, 7, True)], "job_type string, default_priority int, max_attempts int, is_enabled boolean")
    there = jobs(spark, {"id": 7, "idempotency_key": "k", "organization_id": 1, "enqueue_request": '{"other":1}'})
    promoted = intents.promote(after, there, definitions, ["a"], NOW, 100)
    assert {(r["id"], r["status"]) for r in promoted.upserts["job_enqueue_intents"].collect()} == {(10, "PROMOTED"), (13, "PENDING")}
    assert ids(promoted.upserts["job_queue"]) == [110]
    assert intents.has_eligible(after, definitions, ["a"], NOW) and not intents.has_eligible(after, definitions, ["b"], NOW)


def test_cron():
    after = datetime(2024, 1, 31, 23, 59, 30)
    fire = lambda text: schedules.next_fire(schedules.parse_cron(text), after)
    assert fire("0 * * * * *") == datetime(2024, 2, 1)
    assert fire("0 30 2 * * Mon-Fri") == datetime(2024, 2, 1, 2, 30)
    assert fire("15/20 0 0 29 2 *") == datetime(2024, 2, 29, 0, 0, 15)
    assert fire("0 0 0 30 2 *") is None
    for bad in ("* * * * *", "61 * * * * *"):
        with pytest.raises(ValueError):
            schedules.parse_cron(bad)
    late = schedules.next_fire_coalesced("0 * * * * *", datetime(2024, 1, 1), datetime(2024, 1, 5, 0, 0, 30), 77, 0)
    assert late == datetime(2024, 1, 5, 0, 1)
    # of fires a minute apart, spread over up to two minutes, the earliest one after now
    cron, now = schedules.parse_cron("0 * * * * *"), datetime(2024, 1, 5, 0, 0, 30)
    bases = [now.replace(second=0) + k * (datetime(1, 1, 1, 0, 1) - datetime(1, 1, 1)) for k in range(-3, 6)]
    fires = [b + (datetime(1, 1, 1) + (schedules.jitter_seconds(77, b, 120) * (datetime(1, 1, 1, 0, 0, 1) - datetime(1, 1, 1))) - datetime(1, 1, 1)) for b in bases]
    assert schedules.next_fire(cron, now) == datetime(2024, 1, 5, 0, 1)
    assert schedules.next_fire_coalesced("0 * * * * *", datetime(2024, 1, 1), now, 77, 120) == min(f for f in fires if f > now)


def test_stream_equals_batch(spark):
    from jobloom.streaming import job_states

    rows = [(i, i % 5, 1 + (i * 7) % 3, "KIND", datetime(2024, 1, 1, 0, i // 60, i % 60)) for i in range(200)]
    events = spark.createDataFrame(rows, "id long, job_id long, run_number int, event_type string, occurred_at timestamp_ntz")
    got = {r["job_id"]: (r["run_number"], r["events"], r["stale_events"]) for r in job_states.drain(events).collect()}
    expected = {}
    for job in range(5):
        own = [r for r in rows if r[1] == job]
        expected[job] = job_states.advance(None, [r[2] for r in own], [r[3] for r in own])[:3]
    assert got == expected
