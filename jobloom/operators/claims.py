"""Claims: which due jobs run next, one per execution resource."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.predicates import among, due, expired, instant
from jobloom.operators.changes import Change, event

LEAST_WINDOW, MOST_WINDOW, WINDOW_TIMES = 1024, 16384, 64


def order() -> list:
    return [F.desc("priority"), F.asc_nulls_last("next_run_at"), F.asc_nulls_last("created_at"), F.asc("id")]


def resource_window(limit: int) -> int:
    """How many due jobs with a resource are looked at for the first of each resource."""
    return max(LEAST_WINDOW, min(MOST_WINDOW, WINDOW_TIMES * limit))


def eligible(jobs: DataFrame, as_of: str, types: list[str] | None = None) -> DataFrame:
    """Pending jobs that are due; an empty list of types has none."""
    return jobs.where((F.col("status") == "PENDING") & due(as_of) & (among("job_type", types) if types is not None else F.lit(True)))


def resource_heads(jobs: DataFrame, taken: DataFrame, as_of: str, limit: int, types: list[str] | None = None) -> DataFrame:
    """The first due job of each free resource, within the window."""
    with_key = eligible(jobs, as_of, types).where(F.col("execution_resource_key").isNotNull())
    free = with_key.join(taken.select(F.col("resource_key").alias("execution_resource_key")), "execution_resource_key", "left_anti")
    window = free.orderBy(*order()).limit(resource_window(limit))
    first = F.row_number().over(Window.partitionBy("execution_resource_key").orderBy(*order()))
    return window.withColumn("_n", first).where("_n = 1").drop("_n")


def candidates(jobs: DataFrame, taken: DataFrame, as_of: str, limit: int, types: list[str] | None = None) -> DataFrame:
    """The jobs that a claim of so many takes."""
    plain = eligible(jobs, as_of, types).where(F.col("execution_resource_key").isNull())
    return plain.unionByName(resource_heads(jobs, taken, as_of, limit, types)).orderBy(*order()).limit(limit)


def claim(jobs: DataFrame, taken: DataFrame, worker: str, lease_seconds: int, as_of: str, limit: int, types: list[str] | None = None, prestart: bool = False) -> Change:
    """Leases the next jobs to a worker: another attempt each, an attempt row, an event, and their resources."""
    now = instant(as_of)
    until = now + F.expr(f"INTERVAL '{int(lease_seconds)}' SECOND")
    leased = candidates(jobs, taken, as_of, limit, types).withColumns({"status": F.lit("LEASED"), "attempt": F.col("attempt") + 1, "worker_id": F.lit(worker), "lease_expires_at": until})
    attempts = leased.select(F.col("id").alias("job_id"), "run_number", "attempt", "worker_id", F.lit("PRESTART" if prestart else "DIRECT").alias("claim_origin"), now.alias("created_at"), now.alias("started_at"))
    resources = leased.where("execution_resource_key IS NOT NULL").select(F.col("execution_resource_key").alias("resource_key"), F.col("id").alias("job_id"), "lease_expires_at")
    return Change({"job_queue": leased}, {"job_attempts": attempts, "job_events": event(leased, "LEASED", now), "job_execution_resource_claims": resources})


def release_unstarted(jobs: DataFrame, fence: DataFrame, as_of: str) -> Change:
    """Gives claims back that didn't start: the attempt is undone, its row and its resource claim are deleted."""
    now = instant(as_of)
    held = jobs.join(fence, ["id", "run_number", "attempt", "worker_id"], "left_semi").where("status = 'LEASED'")
    gone = held.select(F.col("id").alias("job_id"), "run_number", "attempt")
    free = held.where("execution_resource_key IS NOT NULL").select(F.col("execution_resource_key").alias("resource_key"), F.col("id").alias("job_id"))
    back = held.withColumns({"status": F.lit("PENDING"), "attempt": F.col("attempt") - 1, "worker_id": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp_ntz"), "stage": F.lit("queued")})
    return Change({"job_queue": back}, {"job_events": event(held, "REQUEUED", now, F.lit('{"reason":"UNSTARTED_CLAIM_RELEASED"}'))}, {"job_attempts": gone, "job_execution_resource_claims": free})


def quiesced(canceled: DataFrame, as_of: str) -> DataFrame:
    """Canceled jobs whose last holder can't run any more: the lease is over, or there was none."""
    live = canceled.where(F.coalesce(~expired(as_of), F.lit(False)) & F.col("lease_expires_at").isNotNull()).select("id")
    return canceled.where("status = 'CANCELED'").join(live, "id", "left_anti")


def not_acquired(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Candidates with a resource that another job holds: what a claim passes over."""
    held = taken.select(F.col("resource_key").alias("execution_resource_key"), F.col("job_id").alias("holder"))
    return wanted.where("execution_resource_key IS NOT NULL").join(held, "execution_resource_key", "left").where(F.col("holder").isNotNull() & (F.col("holder") != F.col("id")))


def expired_resources(taken: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """Expired resource claims whose owner isn't leased any more."""
    leased = jobs.where("status = 'LEASED'").select(F.col("id").alias("job_id"))
    return taken.where(expired(as_of)).join(leased, "job_id", "left_anti")
