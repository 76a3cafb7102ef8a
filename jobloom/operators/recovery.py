"""Recovery of workflow runs that are over: new runs from the requests that made the old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.operators import workflow, workflow_writes
from jobloom.operators.changes import Change
from jobloom.sources.storage import by_key, stored

#: What a stored request, a step and a dependency of it may have.
REQUEST, STEP, DEPENDENCY = ("steps", "dependencies"), ("step_key", "execution_kind", "job_type", "payload", "priority", "max_attempts", "timeout_seconds", "stage"), ("dependent_key", "prerequisite_key", "release_mode")
MODES = ("ON_SUCCESS", "ON_TERMINAL")
#: A step's settings that the source's own row replaces, where the ledger keeps them.
SETTINGS = ("payload", "priority", "max_attempts", "timeout_seconds")
_STEPS_A_RUN = 1_000_000


def snapshots(runs: DataFrame, mutations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The declared graphs of runs (workflow_run_id, enqueue_request), with what was appended to them (workflow_run_id, id, mutation_kind, request) laid over in order.

    Gives steps (workflow_run_id, number and the fields of a step), dependencies (workflow_run_id and their fields) and faults (workflow_run_id, fault): SNAPSHOT_MISSING of a run without a stored request, and
    UNSAFE_SNAPSHOT of one whose requests don't parse, have unknown fields, values out of place, a key twice, or mutations of another kind than APPEND_STEPS.
    Requests are taken apart as rows: a graph of any size is spread over tasks.
    """
    parts = runs.select("workflow_run_id", F.lit(-1).cast("long").alias("part"), F.lit("APPEND_STEPS").alias("kind"), F.col("enqueue_request").alias("request")).unionByName(
        mutations.join(by_key(runs.select("workflow_run_id")), "workflow_run_id", "left_semi").select("workflow_run_id", F.col("id").cast("long").alias("part"), F.col("mutation_kind").alias("kind"), "request")
    )
    known = F.from_json("request", "struct<steps: array<map<string,string>>, dependencies: array<map<string,string>>>")
    read = parts.withColumn("read", known).withColumn("names", F.json_object_keys("request"))
    only = lambda names, allowed: F.size(F.array_except(names, F.array(*map(F.lit, allowed)))) == 0
    empty = F.array().cast("array<map<string,string>>")
    steps_of, edges_of = F.coalesce(F.col("read.steps"), empty), F.coalesce(F.col("read.dependencies"), empty)
    whole = F.coalesce(F.col("read").isNotNull() & F.col("names").isNotNull() & only("names", REQUEST) & F.col("read.steps").isNotNull(), F.lit(False))
    fits = F.forall(steps_of, lambda s: F.coalesce(only(F.map_keys(s), STEP) & s["step_key"].isNotNull() & s["execution_kind"].isin("JOB", "EXTERNAL"), F.lit(False))) & F.forall(
        edges_of, lambda e: F.coalesce(only(F.map_keys(e), DEPENDENCY) & e["dependent_key"].isNotNull() & e["prerequisite_key"].isNotNull() & e["release_mode"].isin(*MODES), F.lit(False))
    )
    fault = F.when(F.col("request").isNull(), "SNAPSHOT_MISSING").when((F.col("kind") != "APPEND_STEPS") | ~whole | ~fits, "UNSAFE_SNAPSHOT")
    read = stored(read.select("workflow_run_id", "part", fault.alias("fault"), steps_of.alias("steps"), edges_of.alias("edges")))
    place = F.struct("part", "n")
    steps = read.select("workflow_run_id", "part", F.posexplode("steps").alias("n", "s")).select("workflow_run_id", place.alias("number"), *(F.col("s")[c].cast("int" if c in ("priority", "max_attempts", "timeout_seconds") else "string").alias(c) for c in STEP))
    edges = read.select("workflow_run_id", F.explode("edges").alias("e")).select("workflow_run_id", *(F.col("e")[c].alias(c) for c in DEPENDENCY))
    twice = steps.groupBy("workflow_run_id", "step_key").count().where("count > 1").select("workflow_run_id", F.lit("UNSAFE_SNAPSHOT").alias("fault"))
    faults = read.where("fault IS NOT NULL").select("workflow_run_id", "fault").unionByName(twice).groupBy("workflow_run_id").agg(F.min("fault").alias("fault"))
    return steps, edges, faults


def recover(ledger: dict[str, DataFrame], commands: DataFrame, as_of: str, first_run_id: int, first_step_id: int, first_job_id: int) -> Change:
    """Full replays of runs that are over, as new runs linked to them, once for each request.

    commands: ordinal, source_run_id, organization_id, source_step_id, request_key, mode, reason. The ledger has workflow_recoveries (recovery_run_id, source_run_id, source_step_id, request_key, mode, reason) and
    workflow_run_mutations besides its other tables. A new run has the graph that the source was declared with and what was appended to it, with payloads and settings as the source's steps
    have them now, and no idempotency key; the source stays as it is. Outcomes (ordinal, outcome, run_id), the first that holds:

    NOT_FOUND no such run in the organization; EXISTING or CONFLICT the request key was used for the source before, by the ledger or by an earlier
    command that was carried out, for an equal or another request; NOT_TERMINAL the source isn't over; STEP_NOT_FOUND its named step isn't the source's;
    SNAPSHOT_MISSING, UNSAFE_SNAPSHOT as in ``snapshots``, and where steps of the snapshot and of the source differ; ACTIVE_KEY_HELD its active key is a live run's or
    an earlier command's; INVALID, NO_ENABLED_DEFINITION as in ``enqueue_runs``; INSERTED.
    """
    runs, there = ledger["workflow_runs"], ledger["workflow_steps"]
    key = ["source_run_id", "request_key"]
    active = F.col("active_key") if "active_key" in runs.columns else F.lit(None).cast("string").alias("active_key")
    source = runs.select(F.col("id").alias("source_run_id"), "workflow_type", F.col("organization_id").alias("own_organization"), F.col("status").alias("source_status"), "enqueue_request", "result_step_key", active)
    done = ledger["workflow_recoveries"].select(*key, F.col("recovery_run_id").alias("done_id"), F.struct("source_step_id", "mode", "reason").alias("done"))
    owner = there.select(F.col("id").alias("source_step_id"), F.col("workflow_run_id").alias("step_of"))
    asked = commands.join(by_key(source), "source_run_id", "left").join(by_key(done), key, "left").join(by_key(owner), "source_step_id", "left").withColumn("request", F.struct("source_step_id", "mode", "reason"))
    seen = F.col("workflow_type").isNotNull() & F.col("organization_id").eqNullSafe(F.col("own_organization"))
    early = (
        F.when(~seen, "NOT_FOUND").when(F.col("done_id").isNotNull(), F.when(F.col("done") == F.col("request"), "EXISTING").otherwise("CONFLICT"))
        .when(~F.col("source_status").isin(*workflow.RUN_TERMINAL), "NOT_TERMINAL").when(F.col("source_step_id").isNotNull() & ~F.coalesce(F.col("step_of") == F.col("source_run_id"), F.lit(False)), "STEP_NOT_FOUND")
    )
    asked = stored(asked.withColumn("early", early))

    wanted = stored(asked.where("early IS NULL").select(F.col("source_run_id").alias("workflow_run_id"), "enqueue_request").dropDuplicates(["workflow_run_id"]))
    steps, edges, faults = snapshots(wanted, ledger["workflow_run_mutations"])
    steps = stored(steps)
    own = there.join(by_key(wanted.select("workflow_run_id")), "workflow_run_id", "left_semi").select("workflow_run_id", "step_key", F.col("execution_kind").alias("own_kind"), *(F.col(c).alias(f"own_{c}") for c in SETTINGS if c in there.columns))
    paired = stored(steps.join(own, ["workflow_run_id", "step_key"], "full"))
    unlike = paired.where("execution_kind IS NULL OR own_kind IS NULL OR execution_kind <> own_kind").select("workflow_run_id", F.lit("UNSAFE_SNAPSHOT").alias("fault"))
    faults = faults.unionByName(unlike).groupBy(F.col("workflow_run_id").alias("source_run_id")).agg(F.min("fault").alias("fault"))

    live = runs.where(F.col("status").isin("RUNNING", "WAITING_FOR_EXTERNAL")).select("workflow_type", "organization_id", active).where("active_key IS NOT NULL").distinct()
    held = live.select(F.col("workflow_type").alias("_type"), F.col("organization_id").alias("_organization"), F.col("active_key").alias("_key"), F.lit(True).alias("held"))
    checked = asked.join(by_key(faults), "source_run_id", "left")
    checked = checked.join(by_key(held), (F.col("workflow_type") == F.col("_type")) & F.col("own_organization").eqNullSafe(F.col("_organization")) & (F.col("active_key") == F.col("_key")), "left")
    checked = stored(checked.withColumn("refused", F.coalesce("early", "fault", F.when(F.col("held"), "ACTIVE_KEY_HELD"))).drop("_type", "_organization", "_key", "held"))
    ready = checked.where("refused IS NULL")
    leads = ready.groupBy(*key).agg(F.min("ordinal").alias("lead"), F.min_by("request", "ordinal").alias("lead_request"))
    firsts = ready.join(by_key(leads), key).where("lead = ordinal")
    # of several that would take one active key, the first does
    takers = firsts.where("active_key IS NOT NULL").groupBy("workflow_type", "own_organization", "active_key").agg(F.min("ordinal").alias("ordinal")).select("ordinal")
    going = stored(firsts.where("active_key IS NULL").unionByName(firsts.join(by_key(takers), "ordinal", "left_semi")).select("ordinal", "source_run_id", "workflow_type", "organization_id", "result_step_key", "active_key", "source_step_id", *["request_key", "mode", "reason"]))

    nth = F.row_number().over(Window.partitionBy("workflow_run_id").orderBy("number"))
    kept = {c: F.coalesce(f"own_{c}", c) if f"own_{c}" in paired.columns else F.col(c) for c in SETTINGS}
    graph = paired.where("execution_kind IS NOT NULL").withColumns(kept).withColumn("nth", nth).join(by_key(going.select("ordinal", F.col("source_run_id").alias("workflow_run_id"))), "workflow_run_id")
    new_steps = graph.select("ordinal", (F.col("ordinal") * _STEPS_A_RUN + F.col("nth")).cast("long").alias("step_ordinal"), *STEP)
    new_edges = edges.join(by_key(going.select("ordinal", F.col("source_run_id").alias("workflow_run_id"))), "workflow_run_id").select("ordinal", *DEPENDENCY)
    new_runs = going.select("ordinal", "workflow_type", "organization_id", F.lit(None).cast("string").alias("idempotency_key"), "result_step_key")
    change = workflow_writes.enqueue_runs(ledger, new_runs, stored(new_steps), stored(new_edges), as_of, first_run_id, first_step_id, first_job_id)

    result = change.outcomes.select(F.col("ordinal").alias("lead"), F.col("outcome").alias("led_to"), "run_id")
    led = checked.join(by_key(leads), key, "left").join(by_key(result), "lead", "left")
    inserted = F.col("led_to") == "INSERTED"
    outcome = (
        F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("led_to").isNull(), "ACTIVE_KEY_HELD").when(~inserted | (F.col("lead") == F.col("ordinal")), F.col("led_to"))
        .otherwise(F.when(F.col("lead_request") == F.col("request"), "EXISTING").otherwise("CONFLICT"))
    )
    final = led.withColumn("outcome", outcome)
    run_id = F.when(F.col("outcome") == "EXISTING", F.coalesce("done_id", "run_id")).when(F.col("outcome") == "INSERTED", F.col("run_id"))
    change.outcomes = stored(final.select("ordinal", "outcome", run_id.alias("run_id")))
    made = change.outcomes.where("outcome = 'INSERTED'").join(by_key(going), "ordinal")
    change.appends["workflow_recoveries"] = made.select(F.col("run_id").alias("recovery_run_id"), "source_run_id", "source_step_id", "request_key", "mode", "reason")
    if "active_key" in runs.columns:
        keys = made.select(F.col("run_id").alias("id"), "active_key")
        change.upserts["workflow_runs"] = change.upserts["workflow_runs"].join(by_key(keys), "id", "left")
    return change
