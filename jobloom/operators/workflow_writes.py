"""Writes to workflow graphs as changes of a ledger: enqueued runs, released steps, steps that follow their jobs, appended steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.json_text import canonical_json
from jobloom.functions.predicates import Scope, instant
from jobloom.operators import lifecycle, workflow
from jobloom.operators.changes import Change, event
from jobloom.sources.storage import by_key, stored


def new_jobs(steps: DataFrame, as_of: str, first_job_id: int) -> DataFrame:
    """A pending job for each released step (id, organization_id, job_type, payload, priority, max_attempts, stage): its id is the step's after ``first_job_id``."""
    return steps.select(
        (F.lit(first_job_id) + F.col("id")).cast("long").alias("id"), "job_type", "organization_id", F.coalesce("payload", F.lit("{}")).alias("payload"), F.lit("PENDING").alias("status"),
        F.col("priority").cast("int").alias("priority"), F.lit(1).alias("run_number"), F.lit(0).alias("attempt"), F.col("max_attempts").cast("int").alias("max_attempts"),
        instant(as_of).alias("next_run_at"), F.coalesce("stage", F.lit("queued")).alias("stage"), instant(as_of).alias("created_at"),
    )


def check_runs(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(ordinal, error): the first thing that is wrong with each declared run, by name; runs without errors are absent."""
    named, by = steps.withColumnRenamed("ordinal", "workflow_run_id"), edges.withColumnRenamed("ordinal", "workflow_run_id")
    wrong = workflow.structure_errors(named, by).select("workflow_run_id", "error").unionByName(workflow.cycles(by).select("workflow_run_id", F.lit("CYCLE").alias("error")))
    return wrong.groupBy(F.col("workflow_run_id").alias("ordinal")).agg(F.min("error").alias("error"))


def value_of(payload: str) -> Column:
    """A payload by its JSON value; one that isn't JSON as it stands."""
    return F.coalesce(canonical_json(payload), F.col(payload)).alias(payload)


def declared(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(ordinal, request): each declared run as one text, whatever the order of its steps and edges and however payloads are spelt."""
    step = F.struct("step_key", "execution_kind", "job_type", value_of("payload"), "priority", "max_attempts", "timeout_seconds", F.coalesce("stage", F.lit("queued")).alias("stage"))
    edge = F.struct("dependent_key", "prerequisite_key", F.coalesce("release_mode", F.lit("ON_TERMINAL")).alias("release_mode"))
    per_step = steps.groupBy("ordinal").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    per_edge = edges.groupBy("ordinal").agg(F.array_sort(F.collect_list(edge)).alias("dependencies"))
    return per_step.join(by_key(per_edge), "ordinal", "left").select("ordinal", F.to_json(F.struct("steps", "dependencies")).alias("request"))


def enqueue_runs(ledger: dict[str, DataFrame], runs: DataFrame, steps: DataFrame, edges: DataFrame, as_of: str, first_run_id: int, first_step_id: int, first_job_id: int) -> Change:
    """Enqueues declared workflow runs, a batch at a time.

    runs: ordinal, workflow_type, organization_id, idempotency_key, result_step_key. steps: ordinal, step_ordinal (its own
    in the batch), step_key, execution_kind, job_type, payload, priority, max_attempts, timeout_seconds, stage. edges:
    ordinal, prerequisite_key, dependent_key, release_mode.

    A run that doesn't check is INVALID; one whose key is there, or that an earlier one of the batch has, is EXISTING
    if the declarations are equal, CONFLICT if not, LEGACY_KEY if none is stored; one with a job type that has
    no enabled definition is NO_ENABLED_DEFINITION. All others are INSERTED: steps take the defaults of their types and start
    BLOCKED with all prerequisites pending; those without any are released at once, as a job or waiting.
    Outcomes: ordinal, outcome, run_id.
    """
    now = instant(as_of)
    asked = runs.join(by_key(declared(steps, edges)), "ordinal", "left").join(by_key(check_runs(steps, edges)), "ordinal", "left")
    known = ledger["job_definitions"].where("is_enabled").select("job_type")
    unknown = steps.where("execution_kind = 'JOB'").join(known, "job_type", "left_anti").select("ordinal", F.lit(True).alias("unknown")).distinct()
    key = ["workflow_type", "organization_id", "idempotency_key"]
    same = lambda a, b: (a["workflow_type"] == b["_workflow_type"]) & a["organization_id"].eqNullSafe(b["_organization_id"]) & (a["idempotency_key"] == b["_idempotency_key"])
    keyed = asked.where("idempotency_key IS NOT NULL")
    leads = keyed.where("error IS NULL").groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.min("ordinal").alias("lead_of"), F.min_by("request", "ordinal").alias("lead"))
    there = ledger["workflow_runs"].where("idempotency_key IS NOT NULL").select(*(F.col(c).alias(f"_{c}") for c in key), F.col("id").alias("there_id"), F.col("enqueue_request").alias("there_request"))
    first = keyed.join(by_key(leads), same(keyed, leads), "left").drop("_workflow_type", "_organization_id", "_idempotency_key")
    met = first.join(by_key(there), same(first, there), "left").drop("_workflow_type", "_organization_id", "_idempotency_key")
    free = asked.where("idempotency_key IS NULL").withColumns({"lead_of": F.col("ordinal"), "lead": F.col("request"), "there_id": F.lit(None).cast("long"), "there_request": F.lit(None).cast("string")})
    alike = lambda other: F.when(F.col(other) == F.col("request"), "EXISTING").otherwise("CONFLICT")
    outcome = (
        F.when(F.col("request").isNull(), "INVALID").when(F.col("error").isNotNull(), "INVALID")
        .when(F.col("there_id").isNotNull() & F.col("there_request").isNull(), "LEGACY_KEY").when(F.col("there_id").isNotNull(), alike("there_request"))
        .when(F.col("unknown").isNotNull(), "NO_ENABLED_DEFINITION").when(F.col("lead_of") == F.col("ordinal"), "INSERTED").otherwise(alike("lead"))
    )
    decided = stored(met.unionByName(free).join(by_key(unknown), "ordinal", "left").withColumn("outcome", outcome))
    made = decided.where("outcome = 'INSERTED'")

    own = workflow.step_defaults(steps.join(by_key(made.select("ordinal", "organization_id")), "ordinal"), ledger["job_definitions"])
    needs = edges.groupBy("ordinal", F.col("dependent_key").alias("step_key")).agg(F.count(F.lit(1)).alias("total"))
    counted = own.join(by_key(needs), ["ordinal", "step_key"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    status = F.when(F.col("total") > 0, "BLOCKED").when(F.col("execution_kind") == "EXTERNAL", "WAITING_FOR_EXTERNAL").otherwise("ENQUEUED")
    placed = stored(counted.withColumns({"id": (F.lit(first_step_id) + F.col("step_ordinal")).cast("long"), "workflow_run_id": (F.lit(first_run_id) + F.col("ordinal")).cast("long"), "status": status}))
    released = placed.where("status = 'ENQUEUED'")
    jobs = new_jobs(released, as_of, first_job_id)
    new_steps = placed.select("id", "workflow_run_id", "step_key", "execution_kind", F.when(F.col("status") == "ENQUEUED", (F.lit(first_job_id) + F.col("id")).cast("long")).alias("job_id"), "status", "job_type", "payload", F.col("total"), F.col("total").alias("pending"), now.alias("created_at"))
    at = lambda side: placed.select("ordinal", F.col("step_key").alias(f"{side}_key"), F.col("id").alias(f"{side}_step_id"), *(["workflow_run_id"] if side == "dependent" else []))
    new_edges = edges.join(by_key(at("dependent")), ["ordinal", "dependent_key"]).join(by_key(at("prerequisite")), ["ordinal", "prerequisite_key"]).select("workflow_run_id", "prerequisite_step_id", "dependent_step_id", F.coalesce("release_mode", F.lit("ON_TERMINAL")).alias("release_mode"))
    begun = made.select((F.lit(first_run_id) + F.col("ordinal")).cast("long").alias("id"), "workflow_type", "organization_id", F.lit("RUNNING").alias("status"), "idempotency_key", F.col("request").alias("enqueue_request"), "result_step_key", now.alias("created_at"))
    state = workflow.run_status(new_steps, begun).select("id", F.col("status").alias("now"))
    new_runs = begun.join(by_key(state), "id").withColumn("status", F.col("now")).drop("now")
    run_id = F.when(F.col("there_id").isNotNull(), F.col("there_id")).when(F.col("outcome").isin("INSERTED", "EXISTING"), (F.lit(first_run_id) + F.col("lead_of")).cast("long"))
    return Change(
        {"workflow_runs": new_runs, "workflow_steps": new_steps, "workflow_step_dependencies": new_edges, "job_queue": jobs}, {"job_events": event(jobs, "ENQUEUED", now)},
        outcomes=decided.select("ordinal", "outcome", run_id.alias("run_id")),
    )


def release(ledger: dict[str, DataFrame], as_of: str, first_job_id: int) -> Change:
    """What finished steps lead to in live runs: steps released as jobs or to wait, steps canceled in cascades, run statuses.

    Outcomes: id, workflow_run_id, status, job_id of each step that changes.
    """
    runs = ledger["workflow_runs"]
    live = runs.where(F.col("status").isin("RUNNING", "WAITING_FOR_EXTERNAL")).select(F.col("id").alias("workflow_run_id"), "organization_id")
    steps = ledger["workflow_steps"].join(live.select("workflow_run_id"), "workflow_run_id", "left_semi")
    edges = ledger["workflow_step_dependencies"].join(live.select("workflow_run_id"), "workflow_run_id", "left_semi")
    settled = workflow.propagate(steps, edges).select("id", F.col("status").alias("becomes"))
    moved = stored(steps.join(settled, "id").where("becomes <> status"))
    job = F.when(F.col("becomes") == "ENQUEUED", (F.lit(first_job_id) + F.col("id")).cast("long"))
    known = ledger["job_definitions"].where("is_enabled").select("job_type", F.col("default_priority").alias("priority"), "max_attempts")
    ready = moved.where("becomes = 'ENQUEUED'").join(live, "workflow_run_id").join(known, "job_type", "left").withColumn("stage", F.lit("queued"))
    jobs = new_jobs(ready, as_of, first_job_id)
    changed = moved.select("id", "workflow_run_id", F.col("becomes").alias("status"), job.alias("job_id"))
    after = steps.join(settled, "id").withColumn("status", F.col("becomes"))
    new_status = workflow.run_status(after, runs.join(live, F.col("id") == F.col("workflow_run_id"), "left_semi")).select("id", "status")
    return Change(
        {"job_queue": jobs}, {"job_events": event(jobs, "ENQUEUED", instant(as_of))}, outcomes=changed,
        updates={"workflow_steps": changed.drop("workflow_run_id"), "workflow_runs": new_status},
    )


def finish_steps(ledger: dict[str, DataFrame], finished: DataFrame, as_of: str, first_job_id: int) -> Change:
    """Finishes steps (id, status) of live runs and does what follows from it, at a cost in proportion to the runs that are touched.

    Steps keep counters (pending, unsatisfied); see ``workflow.advance``. Steps that get ready have jobs or wait, canceled ones cascade, and touched runs
    get their status. Outcomes: id, workflow_run_id, status of each step whose status changed.
    """
    live = ledger["workflow_runs"].where(F.col("status").isin("RUNNING", "WAITING_FOR_EXTERNAL"))
    named = finished.join(ledger["workflow_steps"].select("id", "workflow_run_id"), "id")
    asked = named.join(live.select(F.col("id").alias("workflow_run_id")), "workflow_run_id", "left_semi").select(*finished.columns)
    changed = stored(workflow.advance(ledger["workflow_steps"], ledger["workflow_step_dependencies"], asked))
    runs = changed.select("workflow_run_id").distinct()
    own = ledger["workflow_steps"].join(runs, "workflow_run_id", "left_semi")
    new = changed.select("id", F.col("status").alias("becomes"))
    moved = stored(own.join(new, "id").where("becomes <> status"))
    known = ledger["job_definitions"].where("is_enabled").select("job_type", F.col("default_priority").alias("priority"), "max_attempts")
    ready = moved.where("becomes = 'ENQUEUED'").join(live.select(F.col("id").alias("workflow_run_id"), "organization_id"), "workflow_run_id").join(known, "job_type", "left").withColumn("stage", F.lit("queued"))
    jobs = new_jobs(ready, as_of, first_job_id)
    released = moved.where("becomes = 'ENQUEUED'").select("id", (F.lit(first_job_id) + F.col("id")).cast("long").alias("new_job"))
    after = own.join(new, "id", "left").withColumn("status", F.coalesce("becomes", "status"))
    status = workflow.run_status(after, live.join(runs.select(F.col("workflow_run_id").alias("id")), "id", "left_semi")).select("id", "status")
    job = own.select("id", F.col("job_id").alias("old_job"))
    updates = changed.join(released, "id", "left").join(job, "id").select("id", "workflow_run_id", "status", "pending", "unsatisfied", F.coalesce("new_job", "old_job").alias("job_id"))
    return Change(
        {"job_queue": jobs}, {"job_events": event(jobs, "ENQUEUED", instant(as_of))}, outcomes=moved.select("id", "workflow_run_id", F.col("becomes").alias("status")),
        updates={"workflow_steps": updates, "workflow_runs": status},
    )


def cancel_runs(ledger: dict[str, DataFrame], commands: DataFrame, as_of: str, scope: Scope = Scope.admin()) -> Change:
    """Cancels runs (id): all steps that go on, their jobs, and the run itself. Outcomes: id, outcome.

    A run that is over stays as it is (ALREADY_OVER), one that isn't seen is NOT_FOUND; repeating a command changes nothing more. A step whose job is pending or leased is
    canceled with its job; where that job is over already, the step takes what it led to. A live lease ends as ``lifecycle.cancel`` has it. Steps' outputs and
    counters stay: nothing of a canceled run is released any more.
    """
    now = instant(as_of)
    asked = commands.select("id").distinct().join(ledger["workflow_runs"].where(scope.sees()), "id", "left")
    outcome = F.when(F.col("status").isNull(), "NOT_FOUND").when(F.col("status").isin(*workflow.RUN_TERMINAL), "ALREADY_OVER").otherwise("CANCELED")
    decided = stored(asked.select("id", outcome.alias("outcome")))
    runs = decided.where("outcome = 'CANCELED'").select("id")
    steps = ledger["workflow_steps"].where(~F.col("status").isin(*workflow.TERMINAL)).join(runs.select(F.col("id").alias("workflow_run_id")), "workflow_run_id", "left_semi")
    state = ledger["job_queue"].select(F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    own = stored(steps.select("id", "workflow_run_id", "job_id").join(state, "job_id", "left"))
    jobs = lifecycle.cancel(ledger["job_queue"], own.where("job_status IN ('PENDING', 'LEASED')").select(F.col("job_id").alias("id")), as_of)
    ends = F.when(F.col("job_status") == "SUCCEEDED", "SUCCEEDED").when(F.col("job_status") == "DEAD_LETTERED", "FAILED").otherwise("CANCELED")
    updates = {"workflow_runs": runs.withColumns({"status": F.lit("CANCELED"), "finished_at": now}), "workflow_steps": own.select("id", "workflow_run_id", ends.alias("status"), now.alias("finished_at"))}
    return Change(jobs.upserts, jobs.appends, jobs.deletes, decided, updates | jobs.updates)


def follow_jobs(steps: DataFrame, jobs: DataFrame, as_of: str) -> Change:
    """Steps take the status that their jobs lead to; a step's first start stays.

    A claimed job's step is RUNNING, that of one that waits for another attempt or run ENQUEUED, and those of
    settled ones are over. Steps that are over themselves stay as they are. Outcomes: id, status.
    """
    state = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    becomes = (
        F.when(F.col("job_status") == "LEASED", "RUNNING").when(F.col("job_status") == "PENDING", "ENQUEUED").when(F.col("job_status") == "SUCCEEDED", "SUCCEEDED")
        .when(F.col("job_status") == "DEAD_LETTERED", "FAILED").otherwise("CANCELED")
    )
    joined = steps.where("job_id IS NOT NULL").where(~F.col("status").isin(*workflow.TERMINAL)).join(state, "job_id").withColumn("becomes", becomes).where("becomes <> status")
    started = F.col("started_at") if "started_at" in steps.columns else F.lit(None).cast("timestamp_ntz")
    moved = joined.select("id", F.col("becomes").alias("status"), F.coalesce(started, F.when(F.col("becomes") == "RUNNING", instant(as_of))).alias("started_at"))
    return Change(outcomes=moved.select("id", "status"), updates={"workflow_steps": moved})


def append_steps(ledger: dict[str, DataFrame], commands: DataFrame, steps: DataFrame, edges: DataFrame, as_of: str, first_step_id: int, first_job_id: int) -> Change:
    """Appends steps to runs through their open windows.

    commands: ordinal, window_step_id. steps: as for ``enqueue_runs``. edges: ordinal, prerequisite_key (of the run's own steps or of the new ones), dependent_key, release_mode.
    A window must be an external step that waits, in a live run. New keys must be new in the run, prerequisites must be
    there, new edges must have no cycle. New steps whose prerequisites are all over are released at once, or
    canceled where these don't satisfy them. Outcomes: ordinal, outcome, workflow_run_id.
    """
    there = ledger["workflow_steps"]
    live = ledger["workflow_runs"].where(F.col("status").isin("RUNNING", "WAITING_FOR_EXTERNAL")).select(F.col("id").alias("workflow_run_id"), "organization_id", F.lit(True).alias("live"))
    window = there.select(F.col("id").alias("window_step_id"), "workflow_run_id", "execution_kind", F.col("status").alias("window_status"))
    asked = commands.join(window, "window_step_id", "left").join(live, "workflow_run_id", "left")
    run_of = asked.where("workflow_run_id IS NOT NULL").select("ordinal", "workflow_run_id", "organization_id")
    old = there.join(run_of.select("ordinal", "workflow_run_id"), "workflow_run_id").select("ordinal", "step_key", "id", "status")
    taken = steps.join(old, ["ordinal", "step_key"]).select("ordinal", F.lit("DUPLICATE_KEY").alias("error"))
    both = old.select("ordinal", "step_key").unionByName(steps.select("ordinal", "step_key")).distinct()
    missing = edges.join(both.withColumnRenamed("step_key", "prerequisite_key"), ["ordinal", "prerequisite_key"], "left_anti").select("ordinal", F.lit("MISSING_PREREQUISITE").alias("error"))
    foreign = edges.join(steps.select("ordinal", F.col("step_key").alias("dependent_key")), ["ordinal", "dependent_key"], "left_anti").select("ordinal", F.lit("NOT_A_NEW_STEP").alias("error"))
    loops = workflow.cycles(edges.withColumnRenamed("ordinal", "workflow_run_id")).select(F.col("workflow_run_id").alias("ordinal"), F.lit("CYCLE").alias("error"))
    errors = taken.unionByName(missing).unionByName(foreign).unionByName(loops).groupBy("ordinal").agg(F.min("error").alias("error"))
    open_ = (F.col("execution_kind") == "EXTERNAL") & (F.col("window_status") == "WAITING_FOR_EXTERNAL") & F.col("live").isNotNull()
    outcome = F.when(F.col("workflow_run_id").isNull(), "NOT_FOUND").when(~open_, "WINDOW_CLOSED").when(F.col("error").isNotNull(), "INVALID").otherwise("APPENDED")
    decided = stored(asked.join(errors, "ordinal", "left").withColumn("outcome", outcome))
    good = decided.where("outcome = 'APPENDED'").select("ordinal", "workflow_run_id", "organization_id")

    new_id = (F.lit(first_step_id) + F.col("step_ordinal")).cast("long").alias("id")
    own = workflow.step_defaults(steps.join(good, "ordinal"), ledger["job_definitions"]).select("*", new_id)
    named = old.select("ordinal", F.col("step_key").alias("prerequisite_key"), F.col("id").alias("prerequisite_step_id"), "status").unionByName(own.select("ordinal", F.col("step_key").alias("prerequisite_key"), F.col("id").alias("prerequisite_step_id"), F.lit("BLOCKED").alias("status")))
    placed = edges.join(good, "ordinal").join(own.select("ordinal", F.col("step_key").alias("dependent_key"), F.col("id").alias("dependent_step_id")), ["ordinal", "dependent_key"]).join(named, ["ordinal", "prerequisite_key"])
    mode = F.coalesce("release_mode", F.lit("ON_TERMINAL"))
    over: Column = F.col("status").isin(*workflow.TERMINAL)
    counters = placed.groupBy(F.col("dependent_step_id").alias("id")).agg(F.count(F.lit(1)).alias("total"), F.count_if(~over).alias("pending"), F.count_if(over & (mode == "ON_SUCCESS") & (F.col("status") != "SUCCEEDED")).alias("unsatisfied"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    counted = own.join(counters, "id", "left").withColumns({c: zero(c) for c in ("total", "pending", "unsatisfied")})
    status = F.when(F.col("pending") > 0, "BLOCKED").when(F.col("unsatisfied") > 0, "CANCELED").when(F.col("execution_kind") == "EXTERNAL", "WAITING_FOR_EXTERNAL").otherwise("ENQUEUED")
    born = stored(counted.withColumn("status", status))
    jobs = new_jobs(born.where("status = 'ENQUEUED'"), as_of, first_job_id)
    new_steps = born.select("id", "workflow_run_id", "step_key", "execution_kind", F.when(F.col("status") == "ENQUEUED", (F.lit(first_job_id) + F.col("id")).cast("long")).alias("job_id"), "status", "job_type", "payload", "total", "pending", instant(as_of).alias("created_at"))
    new_edges = placed.select("workflow_run_id", "prerequisite_step_id", "dependent_step_id", mode.alias("release_mode"))
    logs = {"job_events": event(jobs, "ENQUEUED", instant(as_of))}
    if "workflow_run_mutations" in ledger:  # kept for recoveries
        requests = declared(steps, edges.withColumn("release_mode", mode)).join(good, "ordinal")
        logs["workflow_run_mutations"] = requests.select("workflow_run_id", F.col("ordinal").alias("id"), F.lit("APPEND_STEPS").alias("mutation_kind"), "request")
    return Change(
        {"workflow_steps": new_steps, "workflow_step_dependencies": new_edges, "job_queue": jobs}, logs,
        outcomes=decided.select("ordinal", "outcome", "workflow_run_id"),
    )


def same_append(stored_requests: DataFrame, steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(ordinal, same): whether each append is the stored request (ordinal, request), whatever the order of its steps and edges."""
    return stored_requests.join(declared(steps, edges).withColumnRenamed("request", "asked"), "ordinal", "left").select("ordinal", F.col("asked").eqNullSafe(F.col("request")).alias("same"))
