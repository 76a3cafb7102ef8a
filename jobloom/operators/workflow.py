"""Workflow graphs: validation, release, propagation of finished steps, run status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions.json_text import canonical_json
from jobloom.functions.predicates import instant
from jobloom.sources.storage import by_key

TERMINAL = ("SUCCEEDED", "FAILED", "CANCELED")
ACTIVE = ("ENQUEUED", "RUNNING", "BLOCKED")
RUN_TERMINAL = ("SUCCEEDED", "COMPLETED_WITH_ERRORS", "CANCELED")


def step_defaults(steps: DataFrame, definitions: DataFrame) -> DataFrame:
    """Steps with the values that their job type's enabled definition has where they set none; external steps have none."""
    known = definitions.where("is_enabled").select("job_type", "default_priority", F.col("max_attempts").alias("default_max"), "default_timeout_seconds")
    job = F.col("execution_kind") == "JOB"
    pick = lambda own, default: F.when(job, F.coalesce(own, default)).alias(own)
    rest = [c for c in steps.columns if c not in ("priority", "max_attempts", "timeout_seconds", "job_type")]
    return steps.join(known, "job_type", "left").select(*rest, "job_type", pick("priority", "default_priority"), pick("max_attempts", "default_max"), pick("timeout_seconds", "default_timeout_seconds"))


def dependency_counts(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Each step with all its prerequisites, those that go on, and those whose end doesn't satisfy it."""
    status = steps.select(F.col("id").alias("prerequisite_step_id"), F.col("status").alias("before"))
    per = edges.join(status, "prerequisite_step_id").groupBy(F.col("dependent_step_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("before").isin(*TERMINAL)).alias("pending"),
        F.count_if(F.col("before").isin(*TERMINAL) & (F.col("release_mode") == "ON_SUCCESS") & (F.col("before") != "SUCCEEDED")).alias("unsatisfied"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return steps.join(per, "id", "left").select("id", "workflow_run_id", "step_key", "execution_kind", "status", zero("total"), zero("pending"), zero("unsatisfied"))


def ready_steps(steps: DataFrame, edges: DataFrame, runs: DataFrame) -> DataFrame:
    """Blocked steps of live runs with no prerequisite that goes on, and what they become."""
    live = runs.where(F.col("status").isin("RUNNING", "WAITING_FOR_EXTERNAL")).select(F.col("id").alias("workflow_run_id"))
    counts = dependency_counts(steps, edges).where("status = 'BLOCKED' AND pending = 0").join(live, "workflow_run_id", "left_semi")
    becomes = F.when(F.col("unsatisfied") > 0, "CANCELED").when(F.col("execution_kind") == "EXTERNAL", "WAITING_FOR_EXTERNAL").otherwise("ENQUEUED")
    return counts.select("id", "workflow_run_id", "step_key", becomes.alias("becomes"))


def run_status(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """The status of each run from its steps: active over waiting over errors over success; canceled stays."""
    per = steps.groupBy(F.col("workflow_run_id").alias("id")).agg(
        F.count_if(F.col("status").isin(*ACTIVE)).alias("active"), F.count_if(F.col("status") == "WAITING_FOR_EXTERNAL").alias("waiting"), F.count_if(F.col("status").isin("FAILED", "CANCELED")).alias("errored")
    )
    now = F.when(F.col("active") > 0, "RUNNING").when(F.col("waiting") > 0, "WAITING_FOR_EXTERNAL").when(F.col("errored") > 0, "COMPLETED_WITH_ERRORS").otherwise("SUCCEEDED")
    return runs.join(by_key(per), "id").select("id", F.when(F.col("status") == "CANCELED", "CANCELED").otherwise(now).alias("status"), "active", "waiting", "errored")


def propagate(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """The steps after all finished ones took effect, canceled ones cascading: id, workflow_run_id, status, pending, unsatisfied.

    Joins over the whole table do a wave at a time: each wave settles blocked steps whose
    prerequisites are all settled; only steps that a wave cancels begin another one. A run of any size and number
    of edges is spread over tasks. The number of waves is at most the longest chain of cancellations.
    """
    from jobloom.sources.storage import stored

    now = stored(dependency_counts(steps, edges))
    while True:
        settled = (F.col("status") == "BLOCKED") & (F.col("pending") == 0)
        becomes = F.when(settled & (F.col("unsatisfied") > 0), "CANCELED").when(settled & (F.col("execution_kind") == "EXTERNAL"), "WAITING_FOR_EXTERNAL").when(settled, "ENQUEUED").otherwise(F.col("status"))
        moved = now.withColumn("after", becomes)
        canceled = stored(moved.where("after = 'CANCELED' AND status = 'BLOCKED'").select(F.col("id").alias("prerequisite_step_id")))
        moved = moved.drop("status").withColumnRenamed("after", "status")
        if canceled.isEmpty():
            return moved.select("id", "workflow_run_id", "status", "pending", "unsatisfied")
        less = edges.join(canceled, "prerequisite_step_id").groupBy(F.col("dependent_step_id").alias("id")).agg(F.count(F.lit(1)).alias("ended"), F.count_if(F.col("release_mode") == "ON_SUCCESS").alias("failed"))
        now = stored(
            moved.join(less, "id", "left").withColumns({"pending": F.col("pending") - F.coalesce("ended", F.lit(0)), "unsatisfied": F.col("unsatisfied") + F.coalesce("failed", F.lit(0))}).select(*now.columns)
        )


def advance(steps: DataFrame, edges: DataFrame, finished: DataFrame) -> DataFrame:
    """What newly finished steps (id, status) change, from counters that steps keep: id, workflow_run_id, status, pending, unsatisfied of changed steps alone.

    ``steps`` have ``pending`` and ``unsatisfied``, as of all earlier finishes. A step that is blocked or over can't finish: such commands change
    nothing, so repeating one is safe; of different ones for a step the first counts (``one_each``). Waves go from the finished steps along their edges, and on from
    those that they cancel, so the work is in proportion to steps and edges of the runs that are touched; the result is that of ``propagate``.
    """
    from jobloom.operators.changes import one_each
    from jobloom.sources.storage import stored

    ends = one_each(finished.select("id", F.col("status").alias("ended")).where(F.col("ended").isin(*TERMINAL)), ["id"])
    columns = ["id", "workflow_run_id", "execution_kind", "status", "pending", "unsatisfied"]
    began = stored(steps.join(ends, "id").where(F.col("status").isin("ENQUEUED", "RUNNING", "WAITING_FOR_EXTERNAL")).withColumn("status", F.col("ended")).select(*columns))
    runs = began.select("workflow_run_id").distinct()
    own = stored(steps.select(*columns).join(runs, "workflow_run_id", "left_semi"))
    links = stored(edges.join(runs, "workflow_run_id", "left_semi").select("prerequisite_step_id", F.col("dependent_step_id").alias("id"), (F.col("release_mode") == "ON_SUCCESS").alias("needs_success")))
    changed, front = began, began
    while not front.isEmpty():
        before = front.select(F.col("id").alias("prerequisite_step_id"), (F.col("status") != "SUCCEEDED").alias("failed"))
        hits = links.join(before, "prerequisite_step_id").groupBy("id").agg(F.count(F.lit(1)).alias("less"), F.count_if(F.col("needs_success") & F.col("failed")).alias("more"))
        now = own.join(changed.select("id"), "id", "left_anti").unionByName(changed)
        counted = now.join(hits, "id").withColumns({"pending": F.col("pending") - F.col("less"), "unsatisfied": F.col("unsatisfied") + F.col("more"), "was": F.col("status")})
        settled = (F.col("status") == "BLOCKED") & (F.col("pending") == 0)
        becomes = F.when(settled & (F.col("unsatisfied") > 0), "CANCELED").when(settled & (F.col("execution_kind") == "EXTERNAL"), "WAITING_FOR_EXTERNAL").when(settled, "ENQUEUED").otherwise(F.col("status"))
        wave = stored(counted.withColumn("status", becomes).select(*columns, "was"))
        changed = stored(changed.join(wave.select("id"), "id", "left_anti").unionByName(wave.drop("was")))
        front = wave.where("status = 'CANCELED' AND was = 'BLOCKED'").drop("was")
    return changed.select("id", "workflow_run_id", "status", "pending", "unsatisfied")


def downstream(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id): all steps that depend on each root (id), directly or not, a wave of edges at a time."""
    from jobloom.sources.storage import stored

    links = edges.select(F.col("prerequisite_step_id").alias("id"), F.col("dependent_step_id").alias("next"))
    found = front = roots.select(F.col("id").alias("root"), "id").distinct()
    found = found.where("false")
    while not front.isEmpty():
        reached = front.join(links, "id").select("root", F.col("next").alias("id")).distinct()
        front = stored(reached.join(found, ["root", "id"], "left_anti"))
        found = stored(found.unionByName(front))
    return found


def structure_errors(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_run_id, error, step_key): what is wrong with declared graphs, except cycles.

    ``edges`` names steps by key: workflow_run_id, prerequisite_key, dependent_key.
    """
    keys = steps.select("workflow_run_id", "step_key")
    row = lambda df, error, key: df.select("workflow_run_id", F.lit(error).alias("error"), F.col(key).alias("step_key"))
    blank = row(keys.where(F.trim("step_key") == ""), "BLANK_KEY", "step_key")
    double = row(keys.groupBy("workflow_run_id", "step_key").count().where("count > 1"), "DUPLICATE_KEY", "step_key")
    missing = row(edges.join(by_key(keys.withColumnRenamed("step_key", "prerequisite_key")), ["workflow_run_id", "prerequisite_key"], "left_anti").distinct(), "MISSING_PREREQUISITE", "dependent_key")
    itself = row(edges.where("prerequisite_key = dependent_key"), "SELF_DEPENDENCY", "dependent_key")
    twice = row(edges.groupBy("workflow_run_id", "prerequisite_key", "dependent_key").count().where("count > 1"), "DUPLICATE_DEPENDENCY", "dependent_key")
    return blank.unionByName(double).unionByName(missing).unionByName(itself).unionByName(twice)


def cycles(edges: DataFrame) -> DataFrame:
    """(workflow_run_id, step_key): steps that no order can place, as they are on a cycle or after one. A graph is one run's declaration.

    Edges from steps that depend on none are taken away, a wave over all graphs at a time, until none goes; so a
    graph of any size is spread over tasks. There are as many waves as the longest path has steps.
    """
    from jobloom.sources.storage import stored

    now = stored(edges.select("workflow_run_id", "prerequisite_key", "dependent_key").distinct())
    n = now.count()
    while n:
        waiting = now.select("workflow_run_id", F.col("dependent_key").alias("prerequisite_key")).distinct()
        after = stored(now.join(by_key(waiting), ["workflow_run_id", "prerequisite_key"], "left_semi"))
        left = after.count()
        if left == n:
            break
        now, n = after, left
    return now.select("workflow_run_id", F.col("dependent_key").alias("step_key")).distinct()


def complete_external(steps: DataFrame, commands: DataFrame, as_of: str) -> DataFrame:
    """The outcome for each command (id, new_status, new_output) on a waiting external step; the same again is accepted."""
    joined = commands.join(steps, "id", "left")
    same = (F.col("status") == F.col("new_status")) & canonical_json("output").eqNullSafe(canonical_json("new_output"))
    outcome = (
        F.when(F.col("status").isNull(), "NOT_FOUND").when(F.col("execution_kind") != "EXTERNAL", "NOT_EXTERNAL").when(F.col("status") == "WAITING_FOR_EXTERNAL", "COMPLETED")
        .when(F.col("status").isin(*TERMINAL), F.when(same, "ALREADY_COMPLETED").otherwise("CONFLICT")).otherwise("NOT_WAITING")
    )
    return joined.select("id", outcome.alias("outcome"), F.when(outcome == "COMPLETED", F.col("new_status")).otherwise(F.col("status")).alias("status"), F.when(outcome == "COMPLETED", instant(as_of)).alias("finished_at"))


def cancel_run(steps: DataFrame, runs: DataFrame, run_ids: DataFrame) -> DataFrame:
    """What canceling runs (id) does to their steps: id, action. A run that is over has none."""
    live = runs.where(~F.col("status").isin(*RUN_TERMINAL)).join(run_ids, "id", "left_semi").select(F.col("id").alias("workflow_run_id"))
    action = F.when(F.col("execution_kind") == "EXTERNAL", "CANCEL_STEP").when(F.col("status") == "BLOCKED", "CANCEL_STEP").otherwise("CANCEL_JOB_AND_STEP")
    return steps.where(~F.col("status").isin(*TERMINAL)).join(live, "workflow_run_id", "left_semi").select("id", "workflow_run_id", action.alias("action"))


def appendable(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """For steps to append (edges: window_step_id, prerequisite_step_id, dependent_key, release_mode): their counters and whether they are born unsatisfied."""
    state = steps.select(F.col("id").alias("prerequisite_step_id"), F.col("status").alias("before"))
    over = F.col("before").isin(*TERMINAL)
    return edges.join(state, "prerequisite_step_id").groupBy("dependent_key").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~over).alias("pending"), F.count_if(over & (F.col("release_mode") == "ON_SUCCESS") & (F.col("before") != "SUCCEEDED")).alias("unsatisfied")
    ).withColumn("born_unsatisfied", (F.col("pending") == 0) & (F.col("unsatisfied") > 0))


def canonical_request(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """A run's declaration as one text, the same for equal ones: steps by key with their kind, type and payload as a value, dependencies by keys with their effective mode."""
    names = lambda side: steps.select(F.col("id").alias(f"{side}_step_id"), F.col("step_key").alias(side))
    named = edges.join(names("dependent"), "dependent_step_id").join(names("prerequisite"), "prerequisite_step_id")
    edge = F.struct("dependent", "prerequisite", F.coalesce("release_mode", F.lit("ON_TERMINAL")).alias("release_mode"))
    per_edge = named.groupBy("workflow_run_id").agg(F.array_sort(F.collect_list(edge)).alias("dependencies"))
    step = F.struct("step_key", "execution_kind", F.coalesce("job_type", F.lit("")).alias("job_type"), F.coalesce(canonical_json("payload"), "payload", F.lit("{}")).alias("payload"))
    per_step = steps.groupBy("workflow_run_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return per_step.join(per_edge, "workflow_run_id", "left").select("workflow_run_id", F.to_json(F.struct("steps", "dependencies")).alias("request"))


def active_key(runs: DataFrame, commands: DataFrame) -> DataFrame:
    """For commands (ordinal, organization_id, active_key): the live run of the organization that has the key, or the first command that gets it.

    A command without a key always gets a run of its own.
    """
    key = ["organization_id", "active_key"]
    match = lambda a, b: a["organization_id"].eqNullSafe(b["_organization_id"]) & (a["active_key"] == b["_active_key"])
    keyed, free = commands.where("active_key IS NOT NULL"), commands.where("active_key IS NULL").select("ordinal", F.col("ordinal").alias("first"), F.lit(None).cast("long").alias("run_id"))
    live = runs.where(F.col("status").isin("RUNNING", "WAITING_FOR_EXTERNAL") & F.col("active_key").isNotNull()).groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.min("id").alias("run_id"))
    leads = keyed.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.min("ordinal").alias("first"))
    led = keyed.join(leads, match(keyed, leads)).select("ordinal", *key, "first")
    met = led.join(live, match(led, live), "left").select("ordinal", "first", "run_id").unionByName(free)
    return met.select("ordinal", F.when(F.col("run_id").isNotNull(), "EXISTING").when(F.col("first") == F.col("ordinal"), "ENQUEUED").otherwise("EXISTING").alias("outcome"), "run_id", F.when(F.col("run_id").isNull(), F.col("first")).alias("enqueued_by"))


def recovery_blueprint(runs: DataFrame, steps: DataFrame, edges: DataFrame, commands: DataFrame) -> DataFrame:
    """For full replays (source_run_id): the steps to create anew, each with its prerequisites' keys, of runs that are over."""
    over = runs.where(F.col("status").isin(*RUN_TERMINAL)).select(F.col("id").alias("workflow_run_id")).join(commands.select(F.col("source_run_id").alias("workflow_run_id")), "workflow_run_id", "left_semi")
    names = steps.select(F.col("id").alias("prerequisite_step_id"), F.col("step_key").alias("prerequisite_key"))
    needs = edges.join(names, "prerequisite_step_id").groupBy(F.col("dependent_step_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("prerequisite_key", "release_mode"))).alias("needs"))
    return steps.join(over, "workflow_run_id", "left_semi").join(needs, "id", "left").select("workflow_run_id", "step_key", "execution_kind", F.coalesce(F.array_join(F.transform("needs", lambda n: F.concat_ws(":", n["prerequisite_key"], n["release_mode"])), ","), F.lit("")).alias("needs"))
