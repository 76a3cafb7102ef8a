"""The lasting ledger: batches against a ledger of plain dicts, killed writers, repeated batches and commands."""

import random

import pytest
from pyspark.sql import functions as F

from jobloom.operators import lifecycle
from jobloom.operators.changes import Change
from jobloom.sources.store import LedgerStore, OtherWriter

QUEUE = "id long, status string, attempt int, note string"
CLAIMS = "resource_key string, job_id long"
EVENTS = "id long, job_id long, event_type string"


class Killed(Exception):
    pass


def begin(spark, path, n=40):
    store = LedgerStore(spark, str(path))
    queue = [(i, "PENDING", 0, None) for i in range(n)]
    claims = [(f"r{i}", i) for i in range(0, n, 4)]
    store.create({"job_queue": spark.createDataFrame(queue, QUEUE), "job_execution_resource_claims": spark.createDataFrame(claims, CLAIMS), "job_events": spark.createDataFrame([(1, 1, "FIRST")], EVENTS)}, buckets=5)
    return store, {"queue": {r[0]: r for r in queue}, "claims": dict(claims), "events": [(1, "FIRST")]}


def random_batch(spark, rng, plain, number):
    """A change, and what it does to the plain ledger."""
    ids = sorted(plain["queue"])
    new = [(1000 * number + k, "PENDING", 0, f"new {number}") for k in range(rng.randrange(3))] + [(i, "LEASED", number, None) for i in rng.sample(ids, 3)]
    changed = {r[0] for r in new}
    noted = [(i, f"note {number}" if i % 2 else None) for i in rng.sample([i for i in ids if i not in changed], 4)] + [(-5, "nobody")]
    dropped = rng.sample([i for i in ids if i not in changed and i not in {n[0] for n in noted}], 2)
    freed = [(v,) for v in rng.sample(sorted(plain["claims"].values()), min(2, len(plain["claims"])))]
    log = [(i, f"BATCH {number}") for i in dropped]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    change = Change(
        {"job_queue": frame(new, QUEUE)}, {"job_events": frame(log, "job_id long, event_type string"), "job_execution_resource_claims": frame([(f"n{number}", number)], CLAIMS)},
        {"job_queue": frame([(i,) for i in dropped], "id long"), "job_execution_resource_claims": frame(freed, "job_id long")}, updates={"job_queue": frame(noted, "id long, note string")},
    )

    def do():
        for i in dropped:
            del plain["queue"][i]
        for i, note in noted:
            if i in plain["queue"]:
                plain["queue"][i] = (*plain["queue"][i][:3], note)
        plain["queue"].update({r[0]: r for r in new})
        plain["claims"] = {k: v for k, v in plain["claims"].items() if (v,) not in freed} | {f"n{number}": number}
        plain["events"] += log

    return change, do


def same(store, plain):
    now = store.read()
    assert sorted(tuple(r) for r in now["job_queue"].collect()) == sorted(plain["queue"].values(), key=lambda r: r[0])
    assert {r["resource_key"]: r["job_id"] for r in now["job_execution_resource_claims"].collect()} == plain["claims"]
    assert sorted((r["job_id"], r["event_type"]) for r in now["job_events"].collect()) == sorted(plain["events"])


def test_twenty_batches_some_of_them_killed(spark, tmp_path, monkeypatch):
    store, plain = begin(spark, tmp_path / "ledger")
    rng = random.Random(2)
    for number in range(1, 21):
        change, do = random_batch(spark, rng, plain, number)
        if number % 4 == 0:  # killed after some tables were written, or just before the manifest
            place, left = ("_put", 0) if number % 8 == 0 else ("_write_buckets", 1)
            real, calls = getattr(LedgerStore, place), []

            def killed(self, *args, real=real, calls=calls, left=left):
                calls.append(1)
                if len(calls) > left:
                    raise Killed
                return real(self, *args)

            with monkeypatch.context() as patch:
                patch.setattr(LedgerStore, place, killed)
                with pytest.raises(Killed):
                    store.apply(number, change)
            same(store, plain)
        assert store.apply(number, change)
        do()
        assert not store.apply(number, change)  # the same batch again
        if number % 5 == 0:
            same(store, plain)
    assert store.versions() == list(range(21))
    store.join_parts("job_events")
    assert len(store.manifest()["logs"]["job_events"]["parts"]) == 1
    assert store.forget(keep=2) > 0 and store.versions() == [20, 21]
    same(store, plain)
    assert store.read(20)["job_queue"].count() == len(plain["queue"])
    assert store.forget(keep=2) == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    store, _ = begin(spark, tmp_path / "ledger", n=200)
    before = store.manifest()["tables"]["job_queue"]["buckets"]
    store.apply(7, Change(updates={"job_queue": spark.createDataFrame([(3, "DONE")], "id long, status string")}))
    after = store.manifest()["tables"]["job_queue"]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    assert store.read(0)["job_queue"].where("status = 'DONE'").count() == 0 and store.read()["job_queue"].where("status = 'DONE'").count() == 1


def test_two_writers(spark, tmp_path):
    store, _ = begin(spark, tmp_path / "ledger")
    stale = store.manifest()
    assert store.apply(1, Change(updates={"job_queue": spark.createDataFrame([(3, "A")], "id long, status string")}))
    with pytest.raises(OtherWriter):
        store._put(stale | {"version": 1})
    assert store.read()["job_queue"].where("status = 'A'").count() == 1


def test_emptied_bucket_and_table(spark, tmp_path):
    store, _ = begin(spark, tmp_path / "ledger", n=4)
    store.apply(1, Change(deletes={"job_queue": spark.range(10)}))
    assert store.read()["job_queue"].count() == 0
    store.apply(2, Change({"job_queue": spark.createDataFrame([(9, "PENDING", 0, None)], QUEUE)}))
    assert [r["id"] for r in store.read()["job_queue"].collect()] == [9]


# ------------------------------------------------------------------ repeated commands

NOW = "2024-01-02 00:00:00"
JOB = "id long, job_type string, organization_id long, payload string, status string, run_number int, attempt int, max_attempts int, worker_id string, lease_expires_at timestamp_ntz, next_run_at timestamp_ntz, stage string, execution_resource_key string, idempotency_key string, progress_done long, progress_total long"


def job(spark, n, status):
    held = status == "LEASED"
    rows = [(i, "t", None, "{}", status, 1, 1, 3, "w" if held else None, None, None, "running", f"r{i}", None, None, None) for i in range(n)]
    until = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz") if held else F.lit(None).cast("timestamp_ntz")
    return spark.createDataFrame(rows, JOB).withColumn("lease_expires_at", until)


def twice(frame):
    return frame.unionByName(frame)


@pytest.mark.parametrize("name", ["succeed", "fail", "continue_after", "heartbeat", "mark_running", "progress"])
def test_repeated_fences_change_a_job_once(spark, name):
    jobs = job(spark, 6, "LEASED")
    attempts = jobs.select(F.col("id").alias("job_id"), "run_number", "attempt", F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("string").alias("outcome"))
    claims = jobs.select(F.col("execution_resource_key").alias("resource_key"), F.col("id").alias("job_id"), "lease_expires_at")
    fence = jobs.where("id < 3").select("id", "run_number", "attempt", "worker_id")
    extra = {
        "fail": {"kind": F.lit("TERMINAL"), "error_code": F.lit("e"), "not_before": F.lit(None).cast("timestamp_ntz")}, "continue_after": {"delay_us": F.lit(5)},
        "progress": {"new_done": F.lit(1).cast("long"), "new_total": F.lit(2).cast("long"), "new_stage": F.lit("s")},
    }.get(name, {})
    commands = twice(fence.withColumns(extra)) if extra else twice(fence)
    args = (90, NOW) if name == "heartbeat" else (NOW,)
    change = getattr(lifecycle, name)(jobs, commands, *args)
    letters = spark.createDataFrame([], "job_id long, job_type string, organization_id long, run_number int, attempt int, error_code string, payload_snapshot string, failed_at timestamp_ntz")
    events = spark.createDataFrame([], "job_id long, run_number int, attempt int, event_type string, stage string, payload string, occurred_at timestamp_ntz")
    after = change.apply({"job_queue": jobs, "job_attempts": attempts, "job_execution_resource_claims": claims, "job_dead_letters": letters, "job_events": events})
    assert after["job_queue"].count() == 6 and after["job_queue"].select("id").distinct().count() == 6
    assert after["job_attempts"].count() == 6
    assert after["job_events"].groupBy("job_id", "event_type").count().where("count > 1").count() == 0


def test_of_different_commands_the_first_decides(spark):
    jobs = job(spark, 4, "LEASED")
    fence = jobs.select("id", "run_number", "attempt", "worker_id")
    hint = F.lit(None).cast("timestamp_ntz")
    commands = fence.withColumns({"ordinal": F.col("id") + 10, "kind": F.lit("RETRYABLE"), "error_code": F.lit("e"), "not_before": hint}).unionByName(fence.withColumns({"ordinal": F.col("id"), "kind": F.lit("TERMINAL"), "error_code": F.lit("e"), "not_before": hint}))
    assert {r["status"] for r in lifecycle.fail(jobs, commands, NOW).upserts["job_queue"].collect()} == {"DEAD_LETTERED"}


def test_repeated_requeues_and_patches(spark):
    steps = spark.createDataFrame([(1, 99, "BLOCKED")], "id long, job_id long, status string")
    canceled = job(spark, 3, "CANCELED")
    wanted = canceled.select("id", F.lit("CANCELED").alias("expected_status"), F.lit(1).alias("expected_run"))
    change = lifecycle.compare_and_requeue(canceled, steps, twice(wanted), NOW)
    assert sorted(r["outcome"] for r in change.outcomes.collect()) == ["DUPLICATE"] * 3 + ["REQUEUED"] * 3
    assert change.apply({"job_queue": canceled, "job_events": spark.createDataFrame([], "job_id long, run_number int, attempt int, event_type string, stage string, payload string, occurred_at timestamp_ntz")})["job_queue"].count() == 3
    pending = job(spark, 3, "PENDING").withColumn("attempt", F.lit(0))
    patches = pending.select("id", F.lit("f").alias("field"), F.lit("[1]").alias("value"))
    change = lifecycle.patch_payload(pending, steps, twice(patches))
    assert sorted(r["outcome"] for r in change.outcomes.collect()) == ["DUPLICATE"] * 3 + ["UPDATED"] * 3
    assert change.apply({"job_queue": pending})["job_queue"].count() == 3


def test_a_job_has_one_letter(spark):
    letters = spark.createDataFrame([(1, 1, "old"), (2, 1, "old")], "job_id long, run_number int, error_code string")
    after = Change({"job_dead_letters": spark.createDataFrame([(1, 2, "new")], letters.schema)}).apply({"job_dead_letters": letters})["job_dead_letters"]
    assert sorted((r["job_id"], r["run_number"]) for r in after.collect()) == [(1, 2), (2, 1)]


def test_blank_resource_keys_of_any_white_space(spark):
    definitions = spark.createDataFrame([("t", 5, 3, 60, True)], "job_type string, default_priority int, max_attempts int, default_timeout_seconds int, is_enabled boolean")
    rows = [(n, "t", None, "{}", None, None, None, None, None, key) for n, key in enumerate(["", " ", "　", "  ", "\t\n", "a", " a ", None])]
    commands = spark.createDataFrame(rows, "ordinal long, job_type string, organization_id long, payload string, priority int, max_attempts int, next_run_at timestamp_ntz, idempotency_key string, stage string, execution_resource_key string")
    jobs = spark.createDataFrame([], "id long, job_type string, organization_id long, idempotency_key string, enqueue_request string")
    outcome = {r["ordinal"]: r["outcome"] for r in lifecycle.enqueue(jobs, definitions, commands, NOW, 100).outcomes.collect()}
    assert [outcome[n] for n in range(8)] == ["INVALID_RESOURCE"] * 5 + ["INSERTED"] * 3
