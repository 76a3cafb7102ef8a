"""Audits: rows that break the ledger's rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOB_STATUS = ("PENDING", "LEASED", "SUCCEEDED", "DEAD_LETTERED", "CANCELED")


def missing_snapshots(rows: DataFrame) -> DataFrame:
    """Rows with an idempotency key but no stored request."""
    return rows.where("idempotency_key IS NOT NULL AND enqueue_request IS NULL").select("id")


def broken_links(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Steps whose job is missing, and released job steps without job: id, problem."""
    linked = steps.where("job_id IS NOT NULL")
    lost = linked.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti").select("id", F.lit("JOB_MISSING").alias("problem"))
    unlinked = steps.where("execution_kind = 'JOB' AND job_id IS NULL AND status <> 'BLOCKED'").select("id", F.lit("JOB_NOT_LINKED").alias("problem"))
    return lost.unionByName(unlinked)


def scope_conflicts(steps: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs whose organization isn't that of their step's run."""
    run = runs.select(F.col("id").alias("workflow_run_id"), F.col("organization_id").alias("run_organization"))
    job = jobs.select(F.col("id").alias("job_id"), F.col("organization_id").alias("job_organization"))
    return steps.join(run, "workflow_run_id").join(job, "job_id").where(~F.col("run_organization").eqNullSafe(F.col("job_organization"))).select("id", "workflow_run_id", "job_id")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has; a null is a value."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose parent isn't there."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def job_violations(jobs: DataFrame) -> DataFrame:
    """(id, rule) for each rule that a job breaks."""
    rules = {
        "STATUS": ~F.col("status").isin(*JOB_STATUS), "BLANK_TYPE": F.trim("job_type") == "", "RUN_NUMBER": F.col("run_number") < 1, "ATTEMPT": F.col("attempt") < 0,
        "PROGRESS": F.col("progress_done") > F.col("progress_total"), "LEASE": (F.col("status") == "LEASED") & (F.col("lease_expires_at").isNull() | F.col("worker_id").isNull()),
        "RESOURCE_KEY": F.octet_length("execution_resource_key") > 512,
    }
    found = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))
    return jobs.select("id", F.explode(found).alias("rule"))


def intent_violations(intents: DataFrame) -> DataFrame:
    """Intents whose columns don't fit their status."""
    promoted = F.col("promoted_job_id").isNotNull() & F.col("promoted_at").isNotNull() & F.col("conflicted_at").isNull()
    conflicted = F.col("conflicted_at").isNotNull() & F.col("promoted_job_id").isNull() & F.col("promoted_at").isNull()
    pending = F.col("promoted_job_id").isNull() & F.col("promoted_at").isNull() & F.col("conflicted_at").isNull()
    shape = F.when(F.col("status") == "PROMOTED", promoted).when(F.col("status") == "CONFLICTED", conflicted).when(F.col("status") == "PENDING", pending).otherwise(F.lit(False))
    return intents.where(~shape).select("id", "status")


def unavailable_schedules(schedules: DataFrame, definitions: DataFrame) -> DataFrame:
    """Active schedules whose type has no enabled definition."""
    return schedules.where("is_active").join(definitions.where("is_enabled").select("job_type"), "job_type", "left_anti").select("id", "name", "job_type")


def catalogue_changes(definitions: DataFrame, catalogue: list[str] | DataFrame, scope: list[str] | DataFrame, exact: bool = True) -> DataFrame:
    """What a sync of a catalogue of types (names, or a frame of job_type) does: (job_type, action).

    Types that aren't there are inserted. An exact sync disables enabled types of the scope that the catalogue lacks; an additive one disables none.
    """
    spark = definitions.sparkSession
    named = lambda given: (given if isinstance(given, DataFrame) else spark.createDataFrame([(t,) for t in given], "job_type string")).select("job_type").where("job_type IS NOT NULL").distinct()
    wanted = named(catalogue)
    insert = wanted.join(definitions, "job_type", "left_anti").select("job_type", F.lit("INSERT").alias("action"))
    if not exact:
        return insert
    disable = definitions.where("is_enabled").join(named(scope), "job_type", "left_semi").join(wanted, "job_type", "left_anti").select("job_type", F.lit("DISABLE").alias("action"))
    return reduce(DataFrame.unionByName, [insert, disable])


def all_there(rows: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Whether each of some different names is a value of a column: one row, one boolean."""
    return rows.where(F.col(column).isin(wanted)).agg((F.count_distinct(column) == len(set(wanted))).alias("all_there"))


def broken_job_links(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Links between steps and jobs that are broken, both ways: steps whose job isn't there, and jobs that several steps have."""
    lost = steps.where("job_id IS NOT NULL").join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti").select("id", F.lit("NO_JOB").alias("fault"))
    shared = steps.where("job_id IS NOT NULL").groupBy(F.col("job_id").alias("id")).count().where("count > 1").select("id", F.lit("SEVERAL_STEPS").alias("fault"))
    return lost.unionByName(shared)
