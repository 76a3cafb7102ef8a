"""Rollups and dashboards over the ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions.predicates import Scope, check_page, continuation_is_valid, equals, expired, last_day

KEY = ["organization_id", "job_type"]


def _count(condition) -> F.Column:
    return F.count_if(condition)


def queue_counts(jobs: DataFrame, as_of: str) -> DataFrame:
    """Pending and leased jobs and stale leases by organization and type."""
    return jobs.groupBy(*KEY).agg(
        _count(F.col("status") == "PENDING").alias("pending_count"),
        _count(F.col("status") == "LEASED").alias("leased_count"),
        _count((F.col("status") == "LEASED") & expired(as_of)).alias("stale_leases"),
    )


def recent_attempts(attempts: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """Finished attempts created in the last day, with their job's key and how long they took."""
    recent = attempts.where(last_day(as_of, "created_at") & F.col("finished_at").isNotNull())
    owner = jobs.select(F.col("id").alias("job_id"), *KEY)
    took = F.expr("timestampdiff(MICROSECOND, started_at, finished_at)") / 1000.0
    return recent.join(owner, "job_id").select(*KEY, "outcome", took.alias("duration_ms"))


def attempt_rollup(attempts: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """Outcomes and exact duration percentiles of finished attempts of the last day."""
    counts = [_count(F.col("outcome") == k).alias(f"{k.lower()}_24h") for k in ("RETRYABLE", "TERMINAL", "PANICKED", "TIMEOUT")]
    percentiles = [F.percentile("duration_ms", p).alias(f"p{round(p * 100)}_duration_ms_24h") for p in (0.5, 0.95)]
    return recent_attempts(attempts, jobs, as_of).groupBy(*KEY).agg(*counts, *percentiles)


def dead_letter_rollup(dead_letters: DataFrame, as_of: str) -> DataFrame:
    """Dead letters of the last day, by the key they carry themselves."""
    return dead_letters.where(last_day(as_of, "failed_at")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("dead_lettered_24h"))


def succeeded_rollup(events: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """Success events of the last day, whatever their job's status is now."""
    won = events.where((F.col("event_type") == "SUCCEEDED") & last_day(as_of, "occurred_at")).select("job_id")
    return won.join(jobs.select(F.col("id").alias("job_id"), *KEY), "job_id").groupBy(*KEY).agg(F.count(F.lit(1)).alias("succeeded_24h"))


COUNTS = ["pending_count", "leased_count", "stale_leases", "succeeded_24h", "retryable_24h", "terminal_24h", "panicked_24h", "timeout_24h", "dead_lettered_24h"]
PERCENTILES = ["p50_duration_ms_24h", "p95_duration_ms_24h"]


def job_metrics_rollup(ledger: dict[str, DataFrame], as_of: str) -> DataFrame:
    """All measures of each organization and job type that any of the four rollups has.

    The rollups are stacked and merged by one aggregation, whose null keys are a group as any
    other: no null-safe joins, and one shuffle of rows that are already aggregated.
    """
    jobs = ledger["job_queue"]
    parts = [
        queue_counts(jobs, as_of),
        attempt_rollup(ledger["job_attempts"], jobs, as_of),
        dead_letter_rollup(ledger["job_dead_letters"], as_of),
        succeeded_rollup(ledger["job_events"], jobs, as_of),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.groupBy(*KEY).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS), *(F.max(c).alias(c) for c in PERCENTILES))


def metric_keys(ledger: dict[str, DataFrame], as_of: str) -> DataFrame:
    """The organizations and job types that any of the four rollups has, each once."""
    jobs = ledger["job_queue"]
    owner = jobs.select(F.col("id").alias("job_id"), *KEY)
    won = ledger["job_events"].where((F.col("event_type") == "SUCCEEDED") & last_day(as_of, "occurred_at")).join(owner, "job_id")
    letters = ledger["job_dead_letters"].where(last_day(as_of, "failed_at"))
    return reduce(DataFrame.union, [jobs.select(*KEY), recent_attempts(ledger["job_attempts"], jobs, as_of).select(*KEY), letters.select(*KEY), won.select(*KEY)]).distinct()


def job_metrics(ledger: dict[str, DataFrame], as_of: str, scope: Scope = Scope.admin(), job_type: str | None = None) -> DataFrame:
    """Measures of each job definition, zero where it has no activity.

    Over several organizations the percentiles are averages of theirs, not percentiles of all.
    """
    rollup = job_metrics_rollup(ledger, as_of).where(scope.sees()).drop("organization_id")
    definitions = ledger["job_definitions"].where(equals("job_type", job_type)).select("job_type")
    return definitions.join(rollup, "job_type", "left").groupBy("job_type").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS), *(F.avg(c).alias(c) for c in PERCENTILES)
    )


def continuation_rollup(events: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """Valid continuations of the last day, and active jobs that one led to, by organization and type."""
    valid = events.where((F.col("event_type") == "REQUEUED") & continuation_is_valid()).select("job_id", (F.col("run_number") + 1).alias("next_run"), "occurred_at")
    owner = jobs.select(F.col("id").alias("job_id"), *KEY)
    continued = valid.where(last_day(as_of, "occurred_at")).join(owner, "job_id").groupBy(*KEY).agg(F.count(F.lit(1)).alias("continued_24h"))
    alive = jobs.where(F.col("status").isin("PENDING", "LEASED"))
    active = alive.join(valid, (alive["id"] == valid["job_id"]) & (alive["run_number"] == valid["next_run"]), "left_semi").groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("active_continued_count"), F.max("run_number").alias("max_active_run_number")
    )
    return continued.unionByName(active, allowMissingColumns=True).groupBy(*KEY).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("continued_24h", "active_continued_count")), F.coalesce(F.max("max_active_run_number"), F.lit(0)).alias("max_active_run_number")
    )


def continuation_metrics(ledger: dict[str, DataFrame], as_of: str, scope: Scope = Scope.admin(), job_type: str | None = None) -> DataFrame:
    """Continuation measures of each job definition, zero where it has none."""
    rollup = continuation_rollup(ledger["job_events"], ledger["job_queue"], as_of).where(scope.sees()).drop("organization_id")
    definitions = ledger["job_definitions"].where(equals("job_type", job_type)).select("job_type")
    return definitions.join(rollup, "job_type", "left").groupBy("job_type").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("continued_24h", "active_continued_count")), F.coalesce(F.max("max_active_run_number"), F.lit(0)).alias("max_active_run_number")
    )


def intent_metrics(intents: DataFrame, as_of: str, scope: Scope = Scope.admin(), job_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Outbox measures by job type, in one pass; types with old settled intents alone are left out."""
    check_page(limit, offset)
    pending = F.col("status") == "PENDING"
    conflicted = (F.col("status") == "CONFLICTED") & last_day(as_of, "conflicted_at")
    promoted = (F.col("status") == "PROMOTED") & last_day(as_of, "promoted_at")
    seen = intents.where(scope.sees() & equals("job_type", job_type) & (pending | conflicted | promoted))
    return seen.groupBy("job_type").agg(
        _count(pending).alias("pending_count"),
        _count(pending & (F.col("promotion_attempts") > 0)).alias("retrying_count"),
        F.coalesce(F.max(F.when(pending, F.col("promotion_attempts"))), F.lit(0)).alias("max_promotion_attempts"),
        _count(conflicted).alias("conflicted_24h"),
        _count(promoted).alias("promoted_24h"),
        F.min(F.when(pending, F.col("created_at"))).alias("oldest_pending_at"),
    ).orderBy("job_type").offset(offset).limit(limit)


def dashboard(ledger: dict[str, DataFrame], as_of: str, scope: Scope = Scope.admin()) -> DataFrame:
    """Both measures of each definition, busiest first, with its load and durations as shown."""
    both = job_metrics(ledger, as_of, scope).join(continuation_metrics(ledger, as_of, scope), "job_type", "left")
    shown = lambda c: F.coalesce(F.format_string("%.0f", F.bround(c, 0)), F.lit("—"))
    return both.withColumn("load", F.col("pending_count") + F.col("leased_count")).withColumns({f"{c}_shown": shown(c) for c in PERCENTILES}).orderBy(F.desc("load"), "job_type")


def dashboard_counts(runs: DataFrame, scope: Scope = Scope.admin()) -> DataFrame:
    """Workflow runs that need attention: one row."""
    return runs.where(scope.sees()).agg(
        _count(F.col("status") == "COMPLETED_WITH_ERRORS").alias("completed_with_errors"), _count(F.col("status") == "WAITING_FOR_EXTERNAL").alias("waiting_for_external")
    )
