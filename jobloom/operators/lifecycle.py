"""State transitions of jobs: pure functions from a snapshot, a batch of commands and an instant to a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.json_text import canonical_json, json_with
from jobloom.functions.predicates import Scope, expired, instant
from jobloom.functions.timing import failure_outcome, plus_ms, retry_at, retry_delay_ms
from jobloom.operators.changes import Change, event, nth_of, one_each
from jobloom.sources.storage import FEW, by_key, sized, stored

FENCE = ["id", "run_number", "attempt", "worker_id"]
#: A text of nothing but white space of any kind, or none at all.
BLANK = r"(?U)^\s*\z"


def _no_time() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def _no_text() -> Column:
    return F.lit(None).cast("string")


def fenced(jobs: DataFrame, commands: DataFrame, as_of: str) -> DataFrame:
    """Leased jobs with the commands of those who hold them now; all others' are stale and drop out. Of repeated commands for a fence, one counts (``one_each``)."""
    live = jobs.where((F.col("status") == "LEASED") & (F.col("lease_expires_at") > instant(as_of)))
    return live.join(one_each(commands, FENCE), FENCE)


def enqueue(jobs: DataFrame, definitions: DataFrame, commands: DataFrame, as_of: str, first_id: int) -> Change:
    """New jobs from commands (ordinal, job_type, organization_id, payload, priority, max_attempts, next_run_at, idempotency_key, stage; and execution_resource_key, if any).

    Unset values come from the type's enabled definition. A key that is there already, or that an
    earlier command of the batch has, gives the existing job if the requests are equal as
    JSON values, else a conflict; one without stored request is a legacy error. A resource key must not be blank
    or longer than 512 bytes. Commands without a key stay where they are; those with one are
    aggregated by it, and only requests that meet another one are compared.
    Outcomes: ordinal, outcome, job_id.
    """
    now = instant(as_of)
    fields = ["job_type", "organization_id", "payload", "priority", "max_attempts", F.date_format("next_run_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("next_run_at"), "stage"]
    if "execution_resource_key" in commands.columns:
        fields.append("execution_resource_key")
    else:
        commands = commands.withColumn("execution_resource_key", _no_text())
    asked = commands.withColumn("enqueue_request", canonical_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})))
    key = ["job_type", "organization_id", "idempotency_key"]
    same = lambda a, b: (a["job_type"] == b["_job_type"]) & a["organization_id"].eqNullSafe(b["_organization_id"]) & (a["idempotency_key"] == b["_idempotency_key"])
    keyed = asked.where("idempotency_key IS NOT NULL")
    leads = keyed.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.min("ordinal").alias("lead_of"), F.min_by("enqueue_request", "ordinal").alias("lead"))
    there = jobs.where("idempotency_key IS NOT NULL").select(*(F.col(c).alias(f"_{c}") for c in key), F.col("id").alias("there_id"), F.col("enqueue_request").alias("stored"))
    first = keyed.join(leads, same(keyed, leads)).drop("_job_type", "_organization_id", "_idempotency_key")
    met = first.join(there, same(first, there), "left").drop("_job_type", "_organization_id", "_idempotency_key").withColumn("there_request", canonical_json("stored")).drop("stored")
    unkeyed = asked.where("idempotency_key IS NULL").withColumns({"lead_of": F.col("ordinal"), "lead": F.col("enqueue_request"), "there_id": F.lit(None).cast("long"), "there_request": _no_text()})
    known = definitions.where("is_enabled").select("job_type", "default_priority", F.col("max_attempts").alias("default_max"), F.lit(True).alias("defined"))
    resource = F.col("execution_resource_key")
    outcome = (
        F.when(resource.isNotNull() & (resource.rlike(BLANK) | (F.octet_length(resource) > 512)), "INVALID_RESOURCE")
        .when(F.col("there_id").isNotNull() & F.col("there_request").isNull(), "LEGACY_KEY")
        .when(F.col("there_id").isNotNull(), F.when(F.col("there_request") == F.col("enqueue_request"), "EXISTING").otherwise("CONFLICT"))
        .when(F.col("defined").isNull(), "NO_ENABLED_DEFINITION")
        .when(F.col("lead_of") == F.col("ordinal"), "INSERTED")
        .otherwise(F.when(F.col("lead") == F.col("enqueue_request"), "EXISTING").otherwise("CONFLICT"))
    )
    decided = met.unionByName(unkeyed).join(known, "job_type", "left").withColumn("outcome", outcome)
    new = decided.where("outcome = 'INSERTED'").select(
        (F.lit(first_id) + F.col("ordinal")).cast("long").alias("id"), "job_type", "organization_id", "payload", F.lit("PENDING").alias("status"),
        F.coalesce("priority", "default_priority").alias("priority"), F.lit(1).alias("run_number"), F.lit(0).alias("attempt"), F.coalesce("max_attempts", "default_max").alias("max_attempts"),
        F.coalesce("next_run_at", now).alias("next_run_at"), F.coalesce("stage", F.lit("queued")).alias("stage"), "idempotency_key", "enqueue_request", "execution_resource_key", now.alias("created_at"),
    )
    job_id = F.when(F.col("there_id").isNotNull(), F.col("there_id")).when(F.col("outcome").isin("INSERTED", "EXISTING"), (F.lit(first_id) + F.col("lead_of")).cast("long"))
    return Change({"job_queue": new}, {"job_events": event(new, "ENQUEUED", now)}, outcomes=decided.select("ordinal", "outcome", job_id.alias("job_id")))


def mark_running(jobs: DataFrame, commands: DataFrame, as_of: str, attempts: DataFrame | None = None) -> Change:
    """Leased jobs begin to run; ``attempts`` that had no mark of a start get one, by which a reaper knows that the attempt was used."""
    now = instant(as_of)
    held = fenced(jobs, commands, as_of).withColumn("stage", F.lit("running"))
    updates = {}
    if attempts is not None:
        unmarked = attempts.where("execution_started_persisted_at IS NULL").select(F.col("job_id").alias("id"), "run_number", "attempt")
        updates["job_attempts"] = held.join(unmarked, ["id", "run_number", "attempt"], "left_semi").select(F.col("id").alias("job_id"), "run_number", "attempt", now.alias("execution_started_persisted_at"))
    return Change({"job_queue": held}, {"job_events": event(held, "STAGE_CHANGED", now, stage=F.lit("running"))}, updates=updates)


def progress(jobs: DataFrame, commands: DataFrame, as_of: str) -> Change:
    """Merges new progress (new_done, new_total, new_stage); the merged values must fit, the event has what was given."""
    held = fenced(jobs, commands, as_of).withColumns({"progress_done": F.coalesce("new_done", "progress_done"), "progress_total": F.coalesce("new_total", "progress_total"), "stage": F.coalesce("new_stage", "stage")})
    fits = F.coalesce((F.col("progress_done") >= 0) & (F.col("progress_total") >= 0) & (F.col("progress_done") <= F.col("progress_total")), F.lit(True))
    good = held.where(fits)
    payload = F.to_json(F.struct(F.col("new_done").alias("progress_done"), F.col("new_total").alias("progress_total")))
    return Change({"job_queue": good}, {"job_events": event(good, "PROGRESS", instant(as_of), payload, F.col("new_stage"))}, outcomes=held.select("id", F.when(fits, "UPDATED").otherwise("INVALID").alias("outcome")))


def heartbeat(jobs: DataFrame, commands: DataFrame, lease_seconds: int, as_of: str) -> Change:
    """Extends leases, and those of their resources."""
    now = instant(as_of)
    held = fenced(jobs, commands, as_of).withColumn("lease_expires_at", now + F.expr(f"INTERVAL '{int(lease_seconds)}' SECOND"))
    resources = held.where("execution_resource_key IS NOT NULL").select(F.col("execution_resource_key").alias("resource_key"), F.col("id").alias("job_id"), "lease_expires_at")
    return Change({"job_queue": held}, {"job_events": event(held, "HEARTBEAT", now)}, updates={"job_execution_resource_claims": resources})


def _finished(held: DataFrame, as_of: str, outcome) -> DataFrame:
    return held.select(F.col("id").alias("job_id"), "run_number", "attempt", instant(as_of).alias("finished_at"), outcome.alias("outcome"))


def _released(held: DataFrame) -> DataFrame:
    """The resource claims of jobs that end a lease."""
    return held.where("execution_resource_key IS NOT NULL").select(F.col("execution_resource_key").alias("resource_key"), F.col("id").alias("job_id"))


def succeed(jobs: DataFrame, commands: DataFrame, as_of: str) -> Change:
    """Completes jobs; a success has no outcome in its attempt row.

    Commands may have new_done, new_total, new_checkpoint and new_output, which replace progress_done, progress_total, checkpoint and output where they aren't null; merged progress
    that doesn't fit leaves the job as it is. Outcomes (id, outcome) tell COMPLETED from INVALID_PROGRESS.
    """
    given = {old: new for old, new in (("progress_done", "new_done"), ("progress_total", "new_total"), ("checkpoint", "new_checkpoint"), ("output", "new_output")) if new in commands.columns}
    held = fenced(jobs, commands, as_of).withColumns({old: F.coalesce(new, old) if old in jobs.columns else F.col(new) for old, new in given.items()})
    outcomes = None
    if {"new_done", "new_total"} & set(given.values()):
        fits = F.coalesce((F.col("progress_done") >= 0) & (F.col("progress_total") >= 0) & (F.col("progress_done") <= F.col("progress_total")), F.lit(True))
        outcomes, held = held.select("id", F.when(fits, "COMPLETED").otherwise("INVALID_PROGRESS").alias("outcome")), held.where(fits)
    done = held.withColumns({"status": F.lit("SUCCEEDED"), "stage": F.lit("completed"), "lease_expires_at": _no_time(), "worker_id": _no_text()})
    return Change({"job_queue": done}, {"job_events": event(held, "SUCCEEDED", instant(as_of), stage=F.lit("completed"))}, {"job_execution_resource_claims": _released(held)}, outcomes, {"job_attempts": _finished(held, as_of, _no_text())})


def fail(jobs: DataFrame, commands: DataFrame, as_of: str) -> Change:
    """Failures (kind, error_code, not_before): retried by the later of policy and hint, or dead-lettered."""
    now = instant(as_of)
    held = fenced(jobs, commands, as_of).withColumn("leads_to", failure_outcome(F.col("kind"), F.col("attempt"), F.col("max_attempts")))
    at, source = retry_at(now, retry_delay_ms(F.col("attempt"), F.col("id")), F.col("not_before"))
    again = held.where("leads_to = 'RETRY'").withColumns({"next_run_at": at, "source": source})
    dead = held.where("leads_to = 'DEAD_LETTER'")
    free = {"lease_expires_at": _no_time(), "worker_id": _no_text()}
    jobs_after = again.withColumns({"status": F.lit("PENDING"), "stage": F.lit("queued"), **free}).drop("source").unionByName(dead.withColumns({"status": F.lit("DEAD_LETTERED"), "stage": F.lit("completed"), **free}))
    letters = dead.select(F.col("id").alias("job_id"), "job_type", "organization_id", "run_number", "attempt", "error_code", F.col("payload").alias("payload_snapshot"), now.alias("failed_at"))
    payload = F.to_json(F.struct(F.col("kind"), F.col("error_code")))
    schedule = F.to_json(F.struct(F.date_format("next_run_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("next_run_at"), F.col("source").alias("retry_timing_source")))
    events = event(held, "FAILED", now, payload).unionByName(event(again, "RETRY_SCHEDULED", now, schedule)).unionByName(event(dead, "DEAD_LETTERED", now, payload))
    return Change({"job_queue": jobs_after, "job_dead_letters": letters}, {"job_events": events}, {"job_execution_resource_claims": _released(held)}, updates={"job_attempts": _finished(held, as_of, F.col("kind"))})


def continue_after(jobs: DataFrame, commands: DataFrame, as_of: str) -> Change:
    """Ends a run and begins the next after delay_us microseconds."""
    now = instant(as_of)
    held = fenced(jobs, commands, as_of)
    at = now + F.make_dt_interval(secs=(F.col("delay_us") / F.lit(1_000_000)).cast("decimal(18,6)"))
    after = held.withColumns({"run_number": F.col("run_number") + 1, "attempt": F.lit(0), "status": F.lit("PENDING"), "stage": F.lit("queued"), "next_run_at": at, "lease_expires_at": _no_time(), "worker_id": _no_text()})
    payload = F.to_json(F.struct(F.lit("HANDLER_CONTINUATION").alias("reason"), F.lit("HANDLER_CONTINUATION").alias("requeue_kind"), (F.col("run_number") + 1).alias("next_run_number"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("next_run_at"), F.col("delay_us").alias("delay_microseconds")))
    return Change({"job_queue": after}, {"job_events": event(held, "REQUEUED", now, payload)}, {"job_execution_resource_claims": _released(held)}, updates={"job_attempts": _finished(held, as_of, _no_text())})


def cancel(jobs: DataFrame, commands: DataFrame, as_of: str, scope: Scope = Scope.admin()) -> Change:
    """Cancels pending and leased jobs; a lease's end stays, as the sign that its holder may still run.

    So does a live lease's resource claim, to be released at that end; that of a lease that is over goes.
    """
    asked = commands.select("id").distinct()
    seen = asked.join(jobs.where(scope.sees()), "id", "left")
    outcome = F.when(F.col("status").isNull(), "NOT_FOUND").when(F.col("status").isin("PENDING", "LEASED"), "CANCELED").otherwise("INVALID_STATE")
    decided = seen.withColumn("outcome", outcome)
    gone = decided.where("outcome = 'CANCELED'").drop("outcome").withColumns({"status": F.lit("CANCELED"), "worker_id": _no_text()})
    leased = decided.where("outcome = 'CANCELED' AND status = 'LEASED'")
    live = F.coalesce(F.col("lease_expires_at") > instant(as_of), F.lit(False))
    later = leased.where(live & F.col("execution_resource_key").isNotNull()).select(F.col("execution_resource_key").alias("resource_key"), F.col("id").alias("job_id"), F.col("lease_expires_at").alias("release_after"))
    return Change({"job_queue": gone}, {"job_events": event(gone, "CANCELED", instant(as_of))}, {"job_execution_resource_claims": _released(leased.where(~live))}, decided.select("id", "outcome"), {"job_execution_resource_claims": later})


def compare_and_requeue(jobs: DataFrame, steps: DataFrame, commands: DataFrame, as_of: str) -> Change:
    """Starts settled jobs anew if they are as expected (expected_status, expected_run).

    Of commands for one job the first decides (``one_each``); the outcome of the others is DUPLICATE.
    """
    managed = steps.where("job_id IS NOT NULL").select(F.col("job_id").alias("id"), F.lit(True).alias("managed")).distinct()
    joined = nth_of(commands, ["id"]).join(jobs, "id", "left").join(managed, "id", "left")
    quiet = ~F.coalesce(F.col("lease_expires_at") > instant(as_of), F.lit(False))
    outcome = (
        F.when(F.col("_nth") > 1, "DUPLICATE").when(F.col("status").isNull(), "NOT_FOUND")
        .when(F.col("managed").isNotNull(), "WORKFLOW_MANAGED")
        .when((F.col("status") != F.col("expected_status")) | (F.col("run_number") != F.col("expected_run")), "EXPECTATION_MISMATCH")
        .when(~F.col("status").isin("DEAD_LETTERED", "CANCELED"), "INVALID_STATE")
        .when((F.col("status") == "CANCELED") & ~quiet, "CANCELLATION_NOT_QUIESCED")
        .otherwise("REQUEUED")
    )
    decided = joined.withColumn("outcome", outcome)
    again = decided.where("outcome = 'REQUEUED'").select(*jobs.columns)
    after = again.withColumns({"status": F.lit("PENDING"), "run_number": F.col("run_number") + 1, "attempt": F.lit(0), "stage": F.lit("queued"), "next_run_at": instant(as_of), "lease_expires_at": _no_time()})
    return Change({"job_queue": after}, {"job_events": event(again, "REQUEUED", instant(as_of), F.lit('{"reason":"OPERATOR"}'))}, outcomes=decided.select("id", "outcome"))


def replay(jobs: DataFrame, replays: DataFrame, commands: DataFrame, as_of: str, first_id: int) -> Change:
    """New jobs that repeat succeeded ones (ordinal, source_job_id, source_run_number, replay_request_key, reason), once per key: a key that is used again for another reason is a CONFLICT."""
    key = ["source_job_id", "source_run_number", "replay_request_key"]
    source = jobs.select(F.col("id").alias("source_job_id"), F.col("run_number").alias("now_run"), "status", *[c for c in jobs.columns if c not in ("id", "run_number", "status")])
    done = replays.select(*key, F.col("reason").alias("done_reason"), F.col("replay_job_id"))
    first = Window.partitionBy(*key).orderBy("ordinal")
    joined = commands.withColumns({"nth": F.row_number().over(first), "lead_reason": F.first("reason").over(first)}).join(done, key, "left").join(source, "source_job_id", "left")
    outcome = (
        F.when(F.col("done_reason").isNotNull(), F.when(F.col("done_reason") == F.col("reason"), "EXISTING").otherwise("CONFLICT"))
        .when(F.col("status").isNull(), "NOT_FOUND")
        .when((F.col("status") != "SUCCEEDED") | (F.col("now_run") != F.col("source_run_number")), "EXPECTATION_MISMATCH")
        .when(F.col("nth") > 1, F.when(F.col("reason") == F.col("lead_reason"), "EXISTING").otherwise("CONFLICT"))
        .otherwise("REPLAYED")
    )
    decided = joined.withColumn("outcome", outcome).withColumn("new_id", (F.lit(first_id) + F.col("ordinal")).cast("long"))
    made = decided.where("outcome = 'REPLAYED'")
    new = made.withColumns({"id": F.col("new_id"), "status": F.lit("PENDING"), "run_number": F.lit(1), "attempt": F.lit(0), "stage": F.lit("queued"), "next_run_at": instant(as_of), "created_at": instant(as_of), "idempotency_key": _no_text(), "enqueue_request": _no_text(), "worker_id": _no_text(), "lease_expires_at": _no_time()}).select(*jobs.columns)
    lineage = made.select(F.col("new_id").alias("replay_job_id"), *key, "reason")
    return Change({"job_queue": new}, {"job_events": event(new, "ENQUEUED", instant(as_of)), "job_replays": lineage}, outcomes=decided.select("ordinal", "outcome"))


def reap_decisions(jobs: DataFrame, attempts: DataFrame, events: DataFrame, as_of: str, limit: int | None) -> DataFrame:
    """What becomes of the oldest expired leases; of all of them where ``limit`` is None.

    A claim ahead of time that never started is released without using the attempt; an
    exhausted job is dead-lettered; any other is retried.
    """
    stale = jobs.where((F.col("status") == "LEASED") & expired(as_of))
    if limit is not None:
        stale = stale.orderBy(F.asc("lease_expires_at"), F.asc("id")).limit(limit)
    side = by_key
    if limit is not None and limit <= FEW:  # so only their attempts and events are shuffled; more rows than that aren't for the driver to send
        few = F.broadcast(stale.select(F.col("id").alias("job_id")))
        side = lambda rows: rows
        attempts, events = attempts.join(few, "job_id", "left_semi"), events.join(few, "job_id", "left_semi")
    own = attempts.select(F.col("job_id").alias("id"), "run_number", "attempt", "claim_origin", "execution_started_persisted_at").dropDuplicates(["id", "run_number", "attempt"])
    ran = events.where((F.col("event_type") == "STAGE_CHANGED") & (F.col("stage") == "running")).groupBy(F.col("job_id").alias("id"), "run_number", "attempt").agg(F.min_by("occurred_at", "id").alias("running_at"))
    beat = events.where("event_type = 'HEARTBEAT'").select(F.col("job_id").alias("id"), "run_number", "attempt", F.lit(True).alias("beaten")).distinct()
    joined = stale.join(side(own), ["id", "run_number", "attempt"], "left").join(side(ran), ["id", "run_number", "attempt"], "left").join(side(beat), ["id", "run_number", "attempt"], "left")
    started = F.col("execution_started_persisted_at").isNotNull() | F.col("running_at").isNotNull()
    decision = F.when((F.col("claim_origin") == "PRESTART") & ~started, "RELEASE").when(F.col("attempt") >= F.col("max_attempts"), "DEAD_LETTER").otherwise("RETRY")
    return joined.select(*jobs.columns, decision.alias("decision"), started.alias("started"), (started & F.col("beaten").isNull()).alias("started_without_heartbeat"))


def reap(jobs: DataFrame, attempts: DataFrame, events: DataFrame, as_of: str, limit: int | None, retry_delay_seconds: int = 30) -> Change:
    """Applies the decisions, which are made once."""
    now = instant(as_of)
    decided = sized(stored(reap_decisions(jobs, attempts, events, as_of, limit)))
    free = {"lease_expires_at": _no_time(), "worker_id": _no_text()}
    later = plus_ms(now, F.lit(retry_delay_seconds * 1000))
    after = decided.withColumns({
        "status": F.when(F.col("decision") == "DEAD_LETTER", "DEAD_LETTERED").otherwise("PENDING"),
        "attempt": F.when(F.col("decision") == "RELEASE", F.col("attempt") - 1).otherwise(F.col("attempt")),
        "next_run_at": F.when(F.col("decision") == "RETRY", later).otherwise(F.col("next_run_at")), **free,
    }).select(*jobs.columns)
    dead = decided.where("decision = 'DEAD_LETTER'")
    letters = dead.select(F.col("id").alias("job_id"), "job_type", "organization_id", "run_number", "attempt", F.lit("job.lease_expired").alias("error_code"), F.col("payload").alias("payload_snapshot"), now.alias("failed_at"))
    used = decided.where("decision <> 'RELEASE'")
    gone = decided.where("decision = 'RELEASE'").select(F.col("id").alias("job_id"), "run_number", "attempt")
    log = event(used, "LEASE_EXPIRED", now).unionByName(event(decided.where("decision = 'RETRY'"), "RETRY_SCHEDULED", now)).unionByName(event(dead, "DEAD_LETTERED", now))
    deleted = {"job_attempts": gone, "job_execution_resource_claims": _released(decided)}
    return Change({"job_queue": after, "job_dead_letters": letters}, {"job_events": log}, deleted, decided.groupBy("decision").count(), {"job_attempts": _finished(used, as_of, F.lit("LEASE_EXPIRED"))})


def patch_payload(jobs: DataFrame, steps: DataFrame, commands: DataFrame) -> Change:
    """Sets a field of payloads to a JSON array (id, field, value): only of direct, pending, unkeyed jobs that weren't claimed.

    Of commands for one job the first decides (``one_each``); the outcome of the others is DUPLICATE.
    """
    managed = steps.where("job_id IS NOT NULL").select(F.col("job_id").alias("id"), F.lit(True).alias("managed")).distinct()
    joined = nth_of(commands, ["id"]).join(jobs, "id", "left").join(managed, "id", "left")
    outcome = (
        F.when(F.col("_nth") > 1, "DUPLICATE").when(F.col("status").isNull(), "NOT_FOUND").when(F.col("managed").isNotNull(), "WORKFLOW_MANAGED").when(F.col("idempotency_key").isNotNull(), "IDEMPOTENT")
        .when(F.col("status") != "PENDING", "NOT_PENDING").when(F.col("attempt") > 0, "ALREADY_CLAIMED").otherwise("UPDATED")
    )
    decided = joined.withColumn("outcome", outcome)
    new = decided.where("outcome = 'UPDATED'").withColumn("payload", json_with("payload", "field", "value")).select(*jobs.columns)
    return Change({"job_queue": new}, outcomes=decided.select("id", "outcome"))


def patch_step_and_job(steps: DataFrame, jobs: DataFrame, commands: DataFrame) -> Change:
    """Sets the payload of steps (id, new_payload) and of their jobs: both, or neither where the job isn't pending and unclaimed any more.

    Of commands for one step the first decides (``one_each``); the outcome of the others is DUPLICATE.
    """
    own = steps.select("id", "job_id", F.col("status").alias("step_status"))
    state = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job_status"), F.col("attempt").alias("job_attempt"))
    joined = nth_of(commands, ["id"]).join(own, "id", "left").join(state, "job_id", "left")
    outcome = (
        F.when(F.col("_nth") > 1, "DUPLICATE").when(F.col("step_status").isNull(), "NOT_FOUND").when(F.col("job_id").isNull() | F.col("job_status").isNull(), "NO_JOB")
        .when(F.col("job_status") != "PENDING", "NOT_PENDING").when(F.col("job_attempt") > 0, "ALREADY_CLAIMED").otherwise("UPDATED")
    )
    decided = joined.withColumn("outcome", outcome)
    good = decided.where("outcome = 'UPDATED'")
    updates = {"workflow_steps": good.select("id", F.col("new_payload").alias("payload")), "job_queue": good.select(F.col("job_id").alias("id"), F.col("new_payload").alias("payload"))}
    return Change(outcomes=decided.select("id", "outcome"), updates=updates)


def add_logs(jobs: DataFrame, entries: DataFrame) -> Change:
    """Appends log entries (id, job_id, level, message) of jobs that there are. Outcomes: those of others."""
    there = jobs.select(F.col("id").alias("job_id"))
    return Change(appends={"job_logs": entries.join(there, "job_id", "left_semi").select("id", "job_id", "level", "message")}, outcomes=entries.join(there, "job_id", "left_anti").select("id", F.lit("NO_JOB").alias("outcome")))


def defer_poisoned(jobs: DataFrame, errors: DataFrame, as_of: str, retry_delay_seconds: int = 30, samples: int = 16) -> Change:
    """Expired leases that can't be reaped (errors: id, error) are put off: their lease ends later. Outcomes: the first ``samples`` of them, as a report."""
    held = jobs.where((F.col("status") == "LEASED") & expired(as_of)).join(one_each(errors, ["id"]), "id")
    until = plus_ms(instant(as_of), F.lit(retry_delay_seconds * 1000))
    return Change(outcomes=held.orderBy("lease_expires_at", "id").limit(samples).select("id", "error"), updates={"job_queue": held.select("id", until.alias("lease_expires_at"))})
