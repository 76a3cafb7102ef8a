"""Listings, lookups and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.predicates import Scope, among, before_cursor, check_page, contains_text, equals, json_is, matches, progress_percent

SUMMARY = ["id", "job_type", "organization_id", "status", "stage", "priority", "run_number", "attempt", "max_attempts", "worker_id", "next_run_at", "lease_expires_at", "created_at"]
STATUS = ["id", "job_type", "status", "run_number", "attempt"]


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page, newest first."""
    check_page(limit, offset)
    return rows.orderBy(F.desc_nulls_first("created_at"), F.desc("id")).offset(offset).limit(limit)


def list_jobs(jobs: DataFrame, scope: Scope = Scope.admin(), status: str | None = None, type_like: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Full jobs, newest first."""
    seen = jobs.where(scope.sees() & equals("status", status) & matches("job_type", type_like))
    return page(seen, limit, offset).withColumn("progress_pct", progress_percent())


def list_job_summaries(jobs: DataFrame, scope: Scope = Scope.admin(), status: str | None = None, job_type: str | None = None, after: tuple[str, int] | None = None, limit: int = 100) -> DataFrame:
    """Jobs without their JSON columns, newest first, after a cursor (created_at, id)."""
    seen = jobs.where(scope.sees() & equals("status", status) & equals("job_type", job_type) & (before_cursor(*after) if after else F.lit(True)))
    return page(seen.select(*SUMMARY), limit)


def job_statuses(jobs: DataFrame, ids: list[int], scope: Scope = Scope.admin()) -> DataFrame:
    """The status of each job of a list that is seen, once, by id."""
    check_page(max(1, len(ids)))
    return jobs.where(scope.sees() & among("id", ids)).select(*STATUS).orderBy("id")


def by_id(rows: DataFrame, row_id: int, scope: Scope = Scope.admin()) -> DataFrame:
    """The row of an id, none if it isn't seen."""
    return rows.where((F.col("id") == row_id) & scope.sees())


def payload_by_key(jobs: DataFrame, job_type: str, key: str, scope: Scope) -> DataFrame:
    """The payload of the job that has an idempotency key."""
    return jobs.where((F.col("job_type") == job_type) & (F.col("idempotency_key") == key) & scope.exactly()).select("id", "payload")


def latest_payload_for_run(jobs: DataFrame, job_type: str, run: str, scope: Scope = Scope.admin()) -> DataFrame:
    """The newest job of a type whose payload names a run."""
    return page(jobs.where(scope.sees() & (F.col("job_type") == job_type) & json_is("payload", "$.run_id", run)), 1).select("id", "payload")


def latest_per(rows: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def of_job(rows: DataFrame, jobs: DataFrame, job_id: int, after: int = 0, limit: int = 100, scope: Scope = Scope.admin()) -> DataFrame:
    """Events or logs of a job that is seen, after an id, oldest first."""
    check_page(limit)
    owner = jobs.where((F.col("id") == job_id) & scope.sees()).select(F.col("id").alias("job_id"))
    return rows.where((F.col("job_id") == job_id) & (F.col("id") > after)).join(owner, "job_id", "left_semi").orderBy("id").limit(limit)


def list_definitions(definitions: DataFrame, type_contains: str | None = None, enabled: bool | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Job definitions by type; the search text has no wildcards."""
    check_page(limit, offset)
    return definitions.where(contains_text("job_type", type_contains) & equals("is_enabled", enabled)).orderBy("job_type").offset(offset).limit(limit)


def list_intents(intents: DataFrame, scope: Scope = Scope.admin(), status: str | None = None, type_like: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(intents.where(scope.sees() & equals("status", status) & matches("job_type", type_like)), limit, offset)


def list_runs(runs: DataFrame, scope: Scope = Scope.admin(), status: str | None = None, type_like: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(runs.where(scope.sees() & equals("status", status) & matches("workflow_type", type_like)), limit, offset)


def count_runs(runs: DataFrame, scope: Scope = Scope.admin(), status: str | None = None, type_like: str | None = None) -> DataFrame:
    return runs.where(scope.sees() & equals("status", status) & matches("workflow_type", type_like)).agg(F.count(F.lit(1)).alias("runs"))


def steps_of(steps: DataFrame, runs: DataFrame, run_id: int, scope: Scope = Scope.admin()) -> DataFrame:
    """The steps of a run that is seen, oldest first."""
    owner = runs.where((F.col("id") == run_id) & scope.sees()).select(F.col("id").alias("workflow_run_id"))
    return steps.where(F.col("workflow_run_id") == run_id).join(owner, "workflow_run_id", "left_semi").orderBy("created_at", "id")


def dependencies_of(edges: DataFrame, runs: DataFrame, run_id: int, scope: Scope = Scope.admin()) -> DataFrame:
    """The dependencies of a run that is seen."""
    owner = runs.where((F.col("id") == run_id) & scope.sees()).select(F.col("id").alias("workflow_run_id"))
    return edges.where(F.col("workflow_run_id") == run_id).join(owner, "workflow_run_id", "left_semi").orderBy("prerequisite_step_id", "dependent_step_id")


def page_of_steps(steps: DataFrame, runs: DataFrame, run_id: int, scope: Scope = Scope.admin(), limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the steps of a run that is seen."""
    check_page(limit, offset)
    return steps_of(steps, runs, run_id, scope).offset(offset).limit(limit)


def page_of_dependencies(edges: DataFrame, runs: DataFrame, run_id: int, scope: Scope = Scope.admin(), limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the dependencies of a run that is seen."""
    check_page(limit, offset)
    return dependencies_of(edges, runs, run_id, scope).offset(offset).limit(limit)


def count_in_runs(rows: DataFrame, runs: DataFrame, scope: Scope = Scope.admin()) -> DataFrame:
    """How many steps, or dependencies, each run that is seen has, none included."""
    per = rows.groupBy(F.col("workflow_run_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return runs.where(scope.sees()).select("id").join(per, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def run_by_key(runs: DataFrame, workflow_type: str, key: str, scope: Scope) -> DataFrame:
    """The run of a type that has an idempotency key, in one organization or in none."""
    return runs.where((F.col("workflow_type") == workflow_type) & (F.col("idempotency_key") == key) & scope.exactly())


def runtime_configs(configs: DataFrame, job_type: str | None = None) -> DataFrame:
    """All runtime configurations by type, or that of one type."""
    return configs.where(equals("job_type", job_type)).orderBy("job_type")


def required_runtime_config(configs: DataFrame, job_type: str) -> DataFrame:
    """The configuration of a type; a type without one is an error."""
    found = runtime_configs(configs, job_type)
    if found.isEmpty():
        raise LookupError(f"no runtime configuration: {job_type}")
    return found


def job_detail(ledger: dict[str, DataFrame], scope: Scope = Scope.admin()) -> DataFrame:
    """Each job that is seen with how many attempts, events and dead letters it has, and its last event."""
    per = lambda name, *more: ledger[name].groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias(name), *more)
    last = F.max_by("event_type", F.struct("occurred_at", "id")).alias("last_event")
    joined = ledger["job_queue"].where(scope.sees()).select("id", "status").join(per("job_attempts"), "id", "left").join(per("job_events", last), "id", "left").join(per("job_dead_letters"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select("id", "status", zero("job_attempts"), zero("job_events"), zero("job_dead_letters"), F.coalesce("last_event", F.lit("-")).alias("last_event"))


def run_of_job(steps: DataFrame, job_ids: list[int]) -> DataFrame:
    """The workflow run of each job that a step has."""
    return steps.where(among("job_id", job_ids)).select("job_id", "workflow_run_id")


def in_order(rows: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of a list of ids, in the list's order."""
    place = F.array_position(F.array(*map(F.lit, ids)), F.col("id"))
    return rows.where(among("id", ids)).withColumn("place", place).orderBy("place")


def workflow_results(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """What asking each run for its result gives.

    A result step that isn't declared is an error whatever the status; then a run that goes on
    is pending, one that didn't succeed unsuccessful, one without output missing.
    """
    output = steps.select(F.col("workflow_run_id").alias("id"), F.col("step_key").alias("result_step_key"), F.col("output").alias("result"), F.lit(True).alias("declared"))
    joined = runs.join(output, ["id", "result_step_key"], "left")
    state = (
        F.when(F.col("result_step_key").isNull() | F.col("declared").isNull(), "undeclared")
        .when(F.col("status").isin("RUNNING", "WAITING_FOR_EXTERNAL"), "pending")
        .when(F.col("status") != "SUCCEEDED", "unsuccessful")
        .when(F.col("result").isNull(), "missing")
        .otherwise("ready")
    )
    return joined.select("id", "status", state.alias("result_state"), F.when(state == "ready", F.col("result")).alias("result"))


def detail(ledger: dict[str, DataFrame], run_id: int, steps_shown: int = 100, edges_shown: int = 100, scope: Scope = Scope.admin()) -> DataFrame:
    """A run with how many steps and edges it has, and whether a view of so many is cut."""
    runs = by_id(ledger["workflow_runs"], run_id, scope)
    steps = ledger["workflow_steps"].where(F.col("workflow_run_id") == run_id).agg(F.count(F.lit(1)).alias("steps"))
    edges = ledger["workflow_step_dependencies"].where(F.col("workflow_run_id") == run_id).agg(F.count(F.lit(1)).alias("edges"))
    return runs.crossJoin(steps).crossJoin(edges).select("id", "workflow_type", "status", "steps", "edges", (F.col("steps") > steps_shown).alias("steps_cut"), (F.col("edges") > edges_shown).alias("edges_cut"))


def decoded_events(events: DataFrame) -> DataFrame:
    """Each event with the kind of its payload: continuation, requeue, or unknown where it has no such shape."""
    from jobloom.functions.predicates import continuation_is_valid

    requeued = F.col("event_type") == "REQUEUED"
    kind = F.when(requeued & continuation_is_valid(), "HANDLER_CONTINUATION").when(requeued & F.get_json_object("payload", "$.reason").isNotNull(), "OTHER_REQUEUE").when(requeued, "UNKNOWN").otherwise("PLAIN")
    return events.select("id", "job_id", "event_type", kind.alias("payload_kind"))


def replay_lineage(jobs: DataFrame, replays: DataFrame, commands: DataFrame) -> DataFrame:
    """The replay that each command (ordinal, source_job_id, source_run_number, replay_request_key, organization_id, reason) repeats: ordinal, replay_job_id, replay_reason, replay_status, replay_run_number.

    A key that was used for another reason still shows its replay, but not that job's state. The source must be of the command's organization, null being one of its own; commands
    that repeat nothing give no row.
    """
    key = ["source_job_id", "source_run_number", "replay_request_key"]
    source = jobs.select(F.col("id").alias("source_job_id"), F.col("organization_id").alias("own_organization"))
    known = commands.join(replays.select(*key, "replay_job_id", F.col("reason").alias("replay_reason")), key).join(source, "source_job_id").where(F.col("organization_id").eqNullSafe(F.col("own_organization")))
    state = jobs.select(F.col("id").alias("_id"), F.col("status").alias("replay_status"), F.col("run_number").alias("replay_run_number"))
    meant = (F.col("_id") == F.col("replay_job_id").outer()) & (F.col("replay_reason").outer() == F.col("reason").outer())
    return known.lateralJoin(state.where(meant), how="left").select("ordinal", "replay_job_id", "replay_reason", "replay_status", "replay_run_number")


def schedule_by_name(schedules: DataFrame, name: str) -> DataFrame:
    """The schedule of a name, none if there isn't one. Names are unique."""
    return schedules.where(F.col("name") == name)
