"""Registered ledger queries and their oracle SQL.

Each entry applies a library operator to the ledger derived from the supplied tables. The
oracle states the same result in DuckDB SQL over the same views, written apart from the operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.json_text import canonical_json
from jobloom.functions.predicates import Scope, any_field_contains, progress_percent
from jobloom.functions.timing import deferral_ms, failure_outcome, retry_delay_ms
from jobloom.operators import changes, claims, integrity, intents, lifecycle, metrics, reads, recovery, schedules, workflow, workflow_writes
from jobloom.operators.percentiles import exact_percentiles
from jobloom.sources import clustered, keyed
from jobloom.sources.adapter import AS_OF, Ledger, from_star, with_views
from jobloom.sources.storage import by_key, shared_path, stored
from jobloom.sources.store import LedgerStore
from jobloom.streaming import job_states

FLAGSHIP = "q2_job_metrics"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

NOW = f"CAST('{AS_OF}' AS TIMESTAMP)"
DAY = f"({NOW} - INTERVAL '24' HOUR)"
ORG = "coalesce(CAST(organization_id AS VARCHAR), '-') AS organization"


def org(name: str = "organization_id") -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("-")).alias("organization")


def query(name: str, views: str = "", sql: str | None = None):
    """Registers a function of a ledger under a name, with SQL over the named views."""

    def add(make: Callable[[Ledger], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: make(from_star(spark, sf_dir))
        if sql:
            _ORACLES[name] = with_views(sql, *views.split())
        return make

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each ledger query by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the ledger queries."""
    return dict(_ORACLES)


# ---------------------------------------------------------------- rollups

_Q_COUNTS = f"""queue_counts AS (
    SELECT organization_id, job_type, count(*) FILTER (WHERE status = 'PENDING') AS pending_count, count(*) FILTER (WHERE status = 'LEASED') AS leased_count,
           count(*) FILTER (WHERE status = 'LEASED' AND lease_expires_at < {NOW}) AS stale_leases
    FROM job_queue GROUP BY ALL)"""
_Q_ATTEMPTS = f"""attempt_rollup AS (
    SELECT q.organization_id, q.job_type, count(*) FILTER (WHERE a.outcome = 'RETRYABLE') AS retryable_24h, count(*) FILTER (WHERE a.outcome = 'TERMINAL') AS terminal_24h,
           count(*) FILTER (WHERE a.outcome = 'PANICKED') AS panicked_24h, count(*) FILTER (WHERE a.outcome = 'TIMEOUT') AS timeout_24h,
           quantile_cont((epoch_us(a.finished_at) - epoch_us(a.started_at)) / 1000.0, 0.5) AS p50_duration_ms_24h, quantile_cont((epoch_us(a.finished_at) - epoch_us(a.started_at)) / 1000.0, 0.95) AS p95_duration_ms_24h
    FROM job_attempts a JOIN job_queue q ON q.id = a.job_id WHERE a.created_at >= {DAY} AND a.finished_at IS NOT NULL GROUP BY ALL)"""
_Q_DEAD = f"dead AS (SELECT organization_id, job_type, count(*) AS dead_lettered_24h FROM job_dead_letters WHERE failed_at >= {DAY} GROUP BY ALL)"
_Q_WON = f"""won AS (SELECT q.organization_id, q.job_type, count(*) AS succeeded_24h FROM job_events e JOIN job_queue q ON q.id = e.job_id
    WHERE e.event_type = 'SUCCEEDED' AND e.occurred_at >= {DAY} GROUP BY ALL)"""
_Q_ROLLUP = f"""{_Q_COUNTS}, {_Q_ATTEMPTS}, {_Q_DEAD}, {_Q_WON},
    keys AS (SELECT organization_id, job_type FROM queue_counts UNION SELECT organization_id, job_type FROM attempt_rollup UNION SELECT organization_id, job_type FROM dead UNION SELECT organization_id, job_type FROM won),
    rollup AS (SELECT k.organization_id, k.job_type, coalesce(c.pending_count, 0) AS pending_count, coalesce(c.leased_count, 0) AS leased_count, coalesce(c.stale_leases, 0) AS stale_leases,
        coalesce(w.succeeded_24h, 0) AS succeeded_24h, coalesce(a.retryable_24h, 0) AS retryable_24h, coalesce(a.terminal_24h, 0) AS terminal_24h, coalesce(a.panicked_24h, 0) AS panicked_24h,
        coalesce(a.timeout_24h, 0) AS timeout_24h, coalesce(d.dead_lettered_24h, 0) AS dead_lettered_24h, a.p50_duration_ms_24h, a.p95_duration_ms_24h
        FROM keys k LEFT JOIN queue_counts c ON c.organization_id IS NOT DISTINCT FROM k.organization_id AND c.job_type = k.job_type
        LEFT JOIN attempt_rollup a ON a.organization_id IS NOT DISTINCT FROM k.organization_id AND a.job_type = k.job_type
        LEFT JOIN dead d ON d.organization_id IS NOT DISTINCT FROM k.organization_id AND d.job_type = k.job_type
        LEFT JOIN won w ON w.organization_id IS NOT DISTINCT FROM k.organization_id AND w.job_type = k.job_type)"""
_COUNT_COLUMNS = ", ".join(metrics.COUNTS)
_BY_DEFINITION = f"""metrics AS (SELECT d.job_type, {', '.join(f'CAST(coalesce(sum(r.{c}), 0) AS BIGINT) AS {c}' for c in metrics.COUNTS)}, {', '.join(f'avg(r.{c}) AS {c}' for c in metrics.PERCENTILES)}
    FROM job_definitions d LEFT JOIN rollup r ON r.job_type = d.job_type GROUP BY d.job_type)"""
_VALID = """valid AS (SELECT job_id, run_number, occurred_at FROM job_events WHERE event_type = 'REQUEUED'
    AND json_type(payload, '$.next_run_number') IN ('UBIGINT', 'BIGINT') AND regexp_full_match(json_extract_string(payload, '$.next_run_number'), '[1-9][0-9]*')
    AND TRY_CAST(json_extract_string(payload, '$.next_run_number') AS BIGINT) = run_number + 1 AND TRY_CAST(json_extract_string(payload, '$.next_run_number') AS BIGINT) <= 2147483647
    AND json_type(payload, '$.next_run_at') = 'VARCHAR' AND regexp_full_match(json_extract_string(payload, '$.next_run_at'), '[+-]?[0-9]+-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})')
    AND TRY_CAST(substr(json_extract_string(payload, '$.next_run_at'), 1, 19) AS TIMESTAMP) IS NOT NULL
    AND json_type(payload, '$.delay_microseconds') IN ('UBIGINT', 'BIGINT') AND regexp_full_match(json_extract_string(payload, '$.delay_microseconds'), '0|[1-9][0-9]*')
    AND json_type(payload, '$.reason') = 'VARCHAR' AND json_extract_string(payload, '$.reason') = 'HANDLER_CONTINUATION'
    AND (json_extract_string(payload, '$.requeue_kind') = 'HANDLER_CONTINUATION' OR NOT json_exists(payload, '$.requeue_kind')))"""
_CONTINUED = f"""{_VALID}, continued AS (SELECT q.organization_id, q.job_type, count(*) AS n, 0 AS active, 0 AS top FROM valid v JOIN job_queue q ON q.id = v.job_id WHERE v.occurred_at >= {DAY} GROUP BY ALL
    UNION ALL SELECT organization_id, job_type, 0, count(*), max(run_number) FROM job_queue q WHERE status IN ('PENDING', 'LEASED') AND EXISTS (SELECT 1 FROM valid v WHERE v.job_id = q.id AND v.run_number = q.run_number - 1) GROUP BY ALL)"""
_CONTINUED_BY_DEFINITION = """continued_by AS (SELECT d.job_type, CAST(coalesce(sum(n), 0) AS BIGINT) AS continued_24h, CAST(coalesce(sum(active), 0) AS BIGINT) AS active_continued_count, CAST(coalesce(max(top), 0) AS INTEGER) AS max_active_run_number
    FROM job_definitions d LEFT JOIN continued c ON c.job_type = d.job_type GROUP BY d.job_type)"""
_ALL = "job_definitions job_queue job_attempts job_dead_letters job_events"


@query("q1_queue_counts", "job_queue", f"WITH {_Q_COUNTS} SELECT {ORG}, job_type, pending_count, leased_count, stale_leases FROM queue_counts")
def _(l):
    return metrics.queue_counts(l["job_queue"], AS_OF).select(org(), "job_type", "pending_count", "leased_count", "stale_leases")


@query("q1_attempt_rollup", "job_queue job_attempts", f"WITH {_Q_ATTEMPTS} SELECT {ORG}, job_type, retryable_24h, terminal_24h, panicked_24h, timeout_24h, round(p50_duration_ms_24h, 3) AS p50, round(p95_duration_ms_24h, 3) AS p95 FROM attempt_rollup")
def _(l):
    return metrics.attempt_rollup(l["job_attempts"], l["job_queue"], AS_OF).select(org(), "job_type", "retryable_24h", "terminal_24h", "panicked_24h", "timeout_24h", F.round("p50_duration_ms_24h", 3).alias("p50"), F.round("p95_duration_ms_24h", 3).alias("p95"))


@query("q1_dead_letter_rollup", "job_dead_letters", f"WITH {_Q_DEAD} SELECT {ORG}, job_type, dead_lettered_24h FROM dead")
def _(l):
    return metrics.dead_letter_rollup(l["job_dead_letters"], AS_OF).select(org(), "job_type", "dead_lettered_24h")


@query("q1_succeeded_rollup", "job_queue job_events", f"WITH {_Q_WON} SELECT {ORG}, job_type, succeeded_24h FROM won")
def _(l):
    return metrics.succeeded_rollup(l["job_events"], l["job_queue"], AS_OF).select(org(), "job_type", "succeeded_24h")


@query("q1_job_metrics_rollup", _ALL, f"WITH {_Q_ROLLUP} SELECT {ORG}, job_type, {_COUNT_COLUMNS}, coalesce(round(p50_duration_ms_24h, 3), -1) AS p50, coalesce(round(p95_duration_ms_24h, 3), -1) AS p95 FROM rollup")
def _(l):
    rollup = metrics.job_metrics_rollup(l, AS_OF)
    return rollup.select(org(), "job_type", *metrics.COUNTS, *(F.coalesce(F.round(f"{p}_duration_ms_24h", 3), F.lit(-1.0)).alias(p) for p in ("p50", "p95")))


@query("q2_job_metrics", _ALL, f"WITH {_Q_ROLLUP}, {_BY_DEFINITION} SELECT job_type, {_COUNT_COLUMNS}, coalesce(round(p50_duration_ms_24h, 3), -1) AS p50, coalesce(round(p95_duration_ms_24h, 3), -1) AS p95 FROM metrics")
def _(l):
    return metrics.job_metrics(l, AS_OF).select("job_type", *metrics.COUNTS, *(F.coalesce(F.round(f"{p}_duration_ms_24h", 3), F.lit(-1.0)).alias(p) for p in ("p50", "p95")))


@query("q2_job_metrics_one_organization", _ALL, f"WITH {_Q_ROLLUP} SELECT d.job_type, {', '.join(f'CAST(coalesce(sum(r.{c}), 0) AS BIGINT) AS {c}' for c in metrics.COUNTS)} FROM job_definitions d LEFT JOIN rollup r ON r.job_type = d.job_type AND r.organization_id = 3 GROUP BY d.job_type")
def _(l):
    return metrics.job_metrics(l, AS_OF, Scope.of(3)).select("job_type", *metrics.COUNTS)


@query("q3_continuation_rollup", "job_queue job_events", f"WITH {_CONTINUED} SELECT {ORG}, job_type, CAST(sum(n) AS BIGINT) AS continued_24h, CAST(sum(active) AS BIGINT) AS active_continued_count, CAST(max(top) AS INTEGER) AS max_active_run_number FROM continued GROUP BY organization_id, job_type")
def _(l):
    return metrics.continuation_rollup(l["job_events"], l["job_queue"], AS_OF).select(org(), "job_type", "continued_24h", "active_continued_count", "max_active_run_number")


@query("q3_continuation_metrics", _ALL, f"WITH {_CONTINUED}, {_CONTINUED_BY_DEFINITION} SELECT * FROM continued_by")
def _(l):
    return metrics.continuation_metrics(l, AS_OF)


@query("q4_intent_metrics", "job_enqueue_intents", f"""
    SELECT job_type, count(*) FILTER (WHERE status = 'PENDING') AS pending_count, count(*) FILTER (WHERE status = 'PENDING' AND promotion_attempts > 0) AS retrying_count,
           coalesce(max(promotion_attempts) FILTER (WHERE status = 'PENDING'), 0) AS max_promotion_attempts, count(*) FILTER (WHERE status = 'CONFLICTED') AS conflicted_24h,
           count(*) FILTER (WHERE status = 'PROMOTED') AS promoted_24h, min(created_at) FILTER (WHERE status = 'PENDING') AS oldest_pending_at
    FROM job_enqueue_intents WHERE status = 'PENDING' OR status = 'CONFLICTED' AND conflicted_at >= {DAY} OR status = 'PROMOTED' AND promoted_at >= {DAY} GROUP BY job_type""")
def _(l):
    return metrics.intent_metrics(l["job_enqueue_intents"], AS_OF)


@query("q5_dashboard", _ALL, f"WITH {_Q_ROLLUP}, {_BY_DEFINITION}, {_CONTINUED}, {_CONTINUED_BY_DEFINITION} SELECT m.job_type, pending_count + leased_count AS load, {_COUNT_COLUMNS}, continued_24h, active_continued_count, max_active_run_number FROM metrics m JOIN continued_by c ON c.job_type = m.job_type")
def _(l):
    return metrics.dashboard(l, AS_OF).select("job_type", "load", *metrics.COUNTS, "continued_24h", "active_continued_count", "max_active_run_number")


@query("q5_dashboard_counts", "workflow_runs", "SELECT count(*) FILTER (WHERE status = 'COMPLETED_WITH_ERRORS') AS completed_with_errors, count(*) FILTER (WHERE status = 'WAITING_FOR_EXTERNAL') AS waiting_for_external FROM workflow_runs")
def _(l):
    return metrics.dashboard_counts(l["workflow_runs"])


# ---------------------------------------------------------------- listings and lookups

@query("q6_list_jobs", "job_queue", f"""
    SELECT id, job_type, {ORG}, status, priority, payload, coalesce(CASE WHEN progress_total > 0 THEN round(progress_done * 100.0 / progress_total, 2) END, -1) AS progress_pct, created_at
    FROM job_queue WHERE status = 'PENDING' AND job_type ILIKE '%OBS_P%' ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 50""")
def _(l):
    found = reads.list_jobs(l["job_queue"], status="PENDING", type_like="OBS_P", limit=100, offset=50)
    return found.select("id", "job_type", org(), "status", "priority", "payload", F.coalesce("progress_pct", F.lit(-1.0)).alias("progress_pct"), "created_at")


@query("q6_list_jobs_global", "job_queue", "SELECT id, job_type, status FROM job_queue WHERE organization_id IS NULL ORDER BY created_at DESC, id DESC LIMIT 100")
def _(l):
    return reads.list_jobs(l["job_queue"], Scope.tenantless()).select("id", "job_type", "status")


@query("q7_job_summaries", "job_queue", "SELECT id, job_type, status, stage, run_number, attempt, next_run_at, created_at FROM job_queue WHERE job_type = 'jobs.p2' AND (created_at, id) < (CAST('2024-01-15 00:00:00' AS TIMESTAMP), 700) ORDER BY created_at DESC, id DESC LIMIT 100")
def _(l):
    found = reads.list_job_summaries(l["job_queue"], job_type="jobs.p2", after=("2024-01-15 00:00:00", 700))
    return found.select("id", "job_type", "status", "stage", "run_number", "attempt", "next_run_at", "created_at")


@query("q8_job_statuses", "job_queue", "SELECT id, job_type, status, run_number, attempt FROM job_queue WHERE organization_id = 2 AND (id IN (9, 123456789) OR id < 400 AND id % 3 = 0)")
def _(l):
    return reads.job_statuses(l["job_queue"], list(range(0, 400, 3)) + [9, 123456789], Scope.of(2))


@query("q9_job_by_id", "job_queue", "SELECT id, job_type, status, payload FROM job_queue WHERE id = 42")
def _(l):
    return reads.by_id(l["job_queue"], 42).select("id", "job_type", "status", "payload")


@query("q10_payload_by_key", "job_queue", "SELECT id, payload FROM job_queue WHERE idempotency_key = 'key-100' AND organization_id IS NOT DISTINCT FROM (SELECT organization_id FROM job_queue WHERE id = 100) AND job_type = (SELECT job_type FROM job_queue WHERE id = 100)")
def _(l):
    owner = l["job_queue"].where("id = 100").first()
    return reads.payload_by_key(l["job_queue"], owner["job_type"], "key-100", Scope.tenantless() if owner["organization_id"] is None else Scope.of(owner["organization_id"]))


@query("q11_latest_payload_for_run", "job_queue", "SELECT id, payload FROM job_queue WHERE job_type = 'jobs.p1' AND json_extract_string(payload, '$.run_id') = 'r7' ORDER BY created_at DESC, id DESC LIMIT 1")
def _(l):
    return reads.latest_payload_for_run(l["job_queue"], "jobs.p1", "r7")


@query("q11_latest_per_type", "job_queue", "SELECT id, job_type, created_at FROM job_queue QUALIFY row_number() OVER (PARTITION BY job_type ORDER BY created_at DESC, id DESC) = 1")
def _(l):
    return reads.latest_per(l["job_queue"], "job_type").select("id", "job_type", "created_at")


@query("q12_job_events", "job_queue job_events", "SELECT e.id, e.event_type, e.payload, e.occurred_at FROM job_events e WHERE e.job_id = 7 AND e.id > 3 AND EXISTS (SELECT 1 FROM job_queue q WHERE q.id = e.job_id) ORDER BY e.id LIMIT 50")
def _(l):
    return reads.of_job(l["job_events"], l["job_queue"], 7, after=3, limit=50).select("id", "event_type", "payload", "occurred_at")


@query("q13_job_logs", "job_queue job_logs", "SELECT id, level, message FROM job_logs WHERE job_id = 3 AND id > 0 AND job_id IN (SELECT id FROM job_queue) ORDER BY id LIMIT 100")
def _(l):
    return reads.of_job(l["job_logs"], l["job_queue"], 3).select("id", "level", "message")


@query("q14_definitions", "job_definitions", r"SELECT job_type, version, max_attempts, is_enabled FROM job_definitions WHERE contains(lower(job_type), 'un_used%')")
def _(l):
    return reads.list_definitions(l["job_definitions"], "UN_USED%").select("job_type", "version", "max_attempts", "is_enabled")


@query("q15_intents", "job_enqueue_intents", f"SELECT id, job_type, {ORG}, status, created_at FROM job_enqueue_intents WHERE status = 'PENDING' ORDER BY created_at DESC, id DESC LIMIT 100")
def _(l):
    return reads.list_intents(l["job_enqueue_intents"], status="PENDING").select("id", "job_type", org(), "status", "created_at")


@query("q16_runtime_configs", "job_runtime_configs", "SELECT job_type, schema_version, config FROM job_runtime_configs WHERE job_type = 'jobs.p3'")
def _(l):
    return l["job_runtime_configs"].where("job_type = 'jobs.p3'")


@query("q17_schedule_by_name", "job_schedules", "SELECT id, name, cron_expr, is_active, next_fire_at FROM job_schedules WHERE name = 'schedule-3'")
def _(l):
    return reads.schedule_by_name(l["job_schedules"], "schedule-3").select("id", "name", "cron_expr", "is_active", "next_fire_at")


@query("q18_latest_run_per_type", "workflow_runs", "SELECT id, workflow_type, status FROM workflow_runs QUALIFY row_number() OVER (PARTITION BY workflow_type ORDER BY created_at DESC, id DESC) = 1")
def _(l):
    return reads.latest_per(l["workflow_runs"], "workflow_type").select("id", "workflow_type", "status")


@query("q19_runs", "workflow_runs", "SELECT id, workflow_type, status, created_at FROM workflow_runs WHERE workflow_type ILIKE '%FLOW_1%' ORDER BY created_at DESC, id DESC LIMIT 40")
def _(l):
    return reads.list_runs(l["workflow_runs"], type_like="FLOW_1", limit=40).select("id", "workflow_type", "status", "created_at")


@query("q19_count_runs", "workflow_runs", "SELECT count(*) AS runs FROM workflow_runs WHERE status = 'RUNNING' AND organization_id IS NULL")
def _(l):
    return reads.count_runs(l["workflow_runs"], Scope.tenantless(), "RUNNING")


@query("q20_steps", "workflow_runs workflow_steps", "SELECT id, step_key, status FROM workflow_steps WHERE workflow_run_id = 12 AND workflow_run_id IN (SELECT id FROM workflow_runs) ORDER BY created_at, id")
def _(l):
    return reads.steps_of(l["workflow_steps"], l["workflow_runs"], 12).select("id", "step_key", "status")


@query("q21_dependencies", "workflow_runs workflow_step_dependencies", "SELECT prerequisite_step_id, dependent_step_id, release_mode FROM workflow_step_dependencies WHERE workflow_run_id = 12 AND workflow_run_id IN (SELECT id FROM workflow_runs)")
def _(l):
    return reads.dependencies_of(l["workflow_step_dependencies"], l["workflow_runs"], 12).select("prerequisite_step_id", "dependent_step_id", "release_mode")


@query("q22_run_of_job", "workflow_steps", "SELECT job_id, workflow_run_id FROM workflow_steps WHERE job_id IN (4, 5, 44, 444)")
def _(l):
    return reads.run_of_job(l["workflow_steps"], [4, 5, 44, 444])


@query("q23_workflow_results", "workflow_runs workflow_steps", """
    SELECT r.id, r.status, CASE WHEN s.id IS NULL THEN 'undeclared' WHEN r.status IN ('RUNNING', 'WAITING_FOR_EXTERNAL') THEN 'pending' WHEN r.status <> 'SUCCEEDED' THEN 'unsuccessful'
           WHEN s.output IS NULL THEN 'missing' ELSE 'ready' END AS result_state, CASE WHEN s.id IS NOT NULL AND r.status = 'SUCCEEDED' THEN s.output END AS result
    FROM workflow_runs r LEFT JOIN workflow_steps s ON s.workflow_run_id = r.id AND s.step_key = r.result_step_key""")
def _(l):
    return reads.workflow_results(l["workflow_runs"], l["workflow_steps"])


@query("q24_run_detail", "workflow_runs workflow_steps workflow_step_dependencies", """
    SELECT id, workflow_type, status, s.steps, e.edges, s.steps > 5 AS steps_cut, e.edges > 100 AS edges_cut FROM workflow_runs,
           (SELECT count(*) AS steps FROM workflow_steps WHERE workflow_run_id = 9) s, (SELECT count(*) AS edges FROM workflow_step_dependencies WHERE workflow_run_id = 9) e WHERE id = 9""")
def _(l):
    return reads.detail(l, 9, steps_shown=5)


@query("q25_decoded_events", "job_events", f"""WITH {_VALID.replace('SELECT job_id,', 'SELECT id, job_id,')}
    SELECT e.id, e.job_id, e.event_type, CASE WHEN e.event_type <> 'REQUEUED' THEN 'PLAIN' WHEN v.id IS NOT NULL THEN 'HANDLER_CONTINUATION' WHEN json_extract_string(e.payload, '$.reason') IS NOT NULL THEN 'OTHER_REQUEUE' ELSE 'UNKNOWN' END AS payload_kind
    FROM job_events e LEFT JOIN valid v ON v.id = e.id""")
def _(l):
    return reads.decoded_events(l["job_events"])


@query("q26_missing_snapshots", "job_queue", "SELECT id FROM job_queue WHERE idempotency_key IS NOT NULL AND enqueue_request IS NULL")
def _(l):
    return integrity.missing_snapshots(l["job_queue"])


@query("q26_broken_links", "workflow_steps job_queue", """
    SELECT id, 'JOB_MISSING' AS problem FROM workflow_steps s WHERE job_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM job_queue q WHERE q.id = s.job_id)
    UNION ALL SELECT id, 'JOB_NOT_LINKED' FROM workflow_steps WHERE execution_kind = 'JOB' AND job_id IS NULL AND status <> 'BLOCKED'""")
def _(l):
    return integrity.broken_links(l["workflow_steps"], l["job_queue"])


@query("j17_scope_conflicts", "workflow_steps workflow_runs job_queue", """
    SELECT s.id, s.workflow_run_id, s.job_id FROM workflow_steps s JOIN workflow_runs r ON r.id = s.workflow_run_id JOIN job_queue q ON q.id = s.job_id WHERE q.organization_id IS DISTINCT FROM r.organization_id""")
def _(l):
    return integrity.scope_conflicts(l["workflow_steps"], l["workflow_runs"], l["job_queue"])


@query("integrity_job_violations", "job_queue", """
    SELECT id, 'PROGRESS' AS rule FROM job_queue WHERE progress_done > progress_total UNION ALL SELECT id, 'LEASE' FROM job_queue WHERE status = 'LEASED' AND (lease_expires_at IS NULL OR worker_id IS NULL)""")
def _(l):
    return integrity.job_violations(l["job_queue"])


@query("integrity_duplicate_intents", "job_enqueue_intents", f"SELECT job_type, {ORG}, idempotency_key, count(*) AS rows FROM job_enqueue_intents GROUP BY job_type, organization_id, idempotency_key HAVING count(*) > 1")
def _(l):
    return integrity.duplicate_keys(l["job_enqueue_intents"], "job_type", "organization_id", "idempotency_key").select("job_type", org(), "idempotency_key", "rows")


@query("integrity_orphan_logs", "job_logs job_queue", "SELECT id, job_id FROM job_logs WHERE job_id NOT IN (SELECT id FROM job_queue)")
def _(l):
    return integrity.orphans(l["job_logs"], "job_id", l["job_queue"]).select("id", "job_id")


@query("integrity_intents", "job_enqueue_intents", "SELECT id, status FROM job_enqueue_intents WHERE (status = 'PROMOTED') <> (promoted_at IS NOT NULL) OR (status = 'CONFLICTED') <> (conflicted_at IS NOT NULL)")
def _(l):
    return integrity.intent_violations(l["job_enqueue_intents"])


@query("x29_unavailable_schedules", "job_schedules job_definitions", "SELECT id, name, job_type FROM job_schedules WHERE is_active AND job_type NOT IN (SELECT job_type FROM job_definitions WHERE is_enabled)")
def _(l):
    return integrity.unavailable_schedules(l["job_schedules"], l["job_definitions"])


@query("x28_catalogue_changes", "job_definitions", "SELECT * FROM (VALUES ('jobs.new', 'INSERT'), ('jobs.p2', 'DISABLE'), ('jobs.p5', 'DISABLE')) AS t(job_type, action)")
def _(l):
    return integrity.catalogue_changes(l["job_definitions"], ["jobs.p1", "jobs.new", "jobs.p3"], ["jobs.p1", "jobs.p2", "jobs.p4", "jobs.p5"])


# ---------------------------------------------------------------- predicates and projections

@query("f20_search", "job_queue", "SELECT id FROM job_queue WHERE contains(lower(job_type), 'p4') OR contains(lower(coalesce(worker_id, '')), 'p4') OR contains(CAST(id AS VARCHAR), 'p4')")
def _(l):
    return l["job_queue"].where(any_field_contains("P4", "job_type", "worker_id", "id")).select("id")


@query("p4_progress", "job_queue", "SELECT id, coalesce(CASE WHEN progress_total > 0 THEN round(progress_done * 100.0 / progress_total, 2) END, -1) AS progress_pct FROM job_queue")
def _(l):
    return l["job_queue"].select("id", F.coalesce(progress_percent(), F.lit(-1.0)).alias("progress_pct"))


@query("t6_in_order", "job_queue", "SELECT id, status, CAST(list_position([9, 3, 5, 1], id) AS BIGINT) AS place FROM job_queue WHERE id IN (9, 3, 5, 1)")
def _(l):
    return reads.in_order(l["job_queue"], [9, 3, 5, 1]).select("id", "status", "place")


# ---------------------------------------------------------------- claims and transitions

def _all_and_none(l):
    """Every job's id, and one that no job has."""
    return l["job_queue"].select("id").union(l.spark.range(-1, 0))


_ELIGIBLE = f"""free AS (SELECT * FROM job_queue q WHERE status = 'PENDING' AND next_run_at <= {NOW} AND execution_resource_key IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM job_execution_resource_claims c WHERE c.resource_key = q.execution_resource_key) ORDER BY priority DESC, next_run_at, created_at, id LIMIT 3200),
    heads AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY execution_resource_key ORDER BY priority DESC, next_run_at, created_at, id) = 1)"""


@query("w1_resource_heads", "job_queue job_execution_resource_claims", f"WITH {_ELIGIBLE} SELECT id, execution_resource_key FROM heads")
def _(l):
    return claims.resource_heads(l["job_queue"], l["job_execution_resource_claims"], AS_OF, 50).select("id", "execution_resource_key")


@query("x5_claim", "job_queue job_execution_resource_claims", f"""WITH {_ELIGIBLE}, plain AS (SELECT * FROM job_queue WHERE status = 'PENDING' AND next_run_at <= {NOW} AND execution_resource_key IS NULL)
    SELECT id, status_after AS status, attempt, worker_id, lease_expires_at FROM (SELECT id, 'LEASED' AS status_after, attempt + 1 AS attempt, 'w1' AS worker_id, {NOW} + INTERVAL '60' SECOND AS lease_expires_at, priority, next_run_at, created_at
    FROM (SELECT * FROM heads UNION ALL SELECT * FROM plain)) ORDER BY priority DESC, next_run_at, created_at, id LIMIT 50""")
def _(l):
    change = claims.claim(l["job_queue"], l["job_execution_resource_claims"], "w1", 60, AS_OF, 50)
    return change.upserts["job_queue"].select("id", "status", "attempt", "worker_id", "lease_expires_at")


@query("x22_expired_resources", "job_queue job_execution_resource_claims", f"SELECT resource_key, job_id FROM job_execution_resource_claims c WHERE lease_expires_at < {NOW} AND NOT EXISTS (SELECT 1 FROM job_queue q WHERE q.id = c.job_id AND q.status = 'LEASED')")
def _(l):
    return claims.expired_resources(l["job_execution_resource_claims"], l["job_queue"], AS_OF).select("resource_key", "job_id")


@query("x11_failure_outcome", "job_queue", "SELECT id, CASE WHEN id % 5 IN (1, 2) THEN 'DEAD_LETTER' WHEN attempt >= max_attempts THEN 'DEAD_LETTER' ELSE 'RETRY' END AS leads_to FROM job_queue")
def _(l):
    kind = F.element_at(F.array(*map(F.lit, ("RETRYABLE", "TERMINAL", "PANICKED", "TIMEOUT", "LEASE_EXPIRED"))), (F.col("id") % 5 + 1).cast("int"))
    return l["job_queue"].select("id", failure_outcome(kind, F.col("attempt"), F.col("max_attempts")).alias("leads_to"))


@query("x13_retry_delay", "job_queue", "SELECT id, CAST(greatest(1000, least(5000 * CAST(pow(2, least(greatest(attempt, 1), 10)) AS BIGINT), 300000) + id % 1000 - 500) AS BIGINT) AS delay_ms FROM job_queue")
def _(l):
    return l["job_queue"].select("id", retry_delay_ms(F.col("attempt"), F.col("id")).cast("long").alias("delay_ms"))


@query("x17_cancel", "job_queue", "SELECT CAST(i AS BIGINT) AS id, CASE WHEN q.id IS NULL THEN 'NOT_FOUND' WHEN q.status IN ('PENDING', 'LEASED') THEN 'CANCELED' ELSE 'INVALID_STATE' END AS outcome FROM (SELECT id AS i FROM job_queue UNION ALL SELECT -1) t LEFT JOIN job_queue q ON q.id = i AND q.organization_id = 3")
def _(l):
    return lifecycle.cancel(l["job_queue"], _all_and_none(l), AS_OF, Scope.of(3)).outcomes


@query("x18_requeue", "job_queue workflow_steps", f"""
    SELECT CAST(i AS BIGINT) AS id, CASE WHEN q.id IS NULL THEN 'NOT_FOUND' WHEN m.job_id IS NOT NULL THEN 'WORKFLOW_MANAGED' WHEN q.status <> 'CANCELED' OR q.run_number <> 3 THEN 'EXPECTATION_MISMATCH'
           WHEN q.lease_expires_at > {NOW} THEN 'CANCELLATION_NOT_QUIESCED' ELSE 'REQUEUED' END AS outcome
    FROM (SELECT id AS i FROM job_queue UNION ALL SELECT -1) t LEFT JOIN job_queue q ON q.id = i LEFT JOIN (SELECT DISTINCT job_id FROM workflow_steps WHERE job_id IS NOT NULL) m ON m.job_id = i""")
def _(l):
    commands = _all_and_none(l).select("id", F.lit("CANCELED").alias("expected_status"), F.lit(3).alias("expected_run"))
    return lifecycle.compare_and_requeue(l["job_queue"], l["workflow_steps"], commands, AS_OF).outcomes


_REAPED = f"""
    WITH stale AS (SELECT * FROM job_queue WHERE status = 'LEASED' AND lease_expires_at < {NOW} ORDER BY lease_expires_at, id LIMIT LEASES),
    ran AS (SELECT DISTINCT job_id, run_number, attempt FROM job_events WHERE event_type = 'STAGE_CHANGED' AND stage = 'running'), beat AS (SELECT DISTINCT job_id, run_number, attempt FROM job_events WHERE event_type = 'HEARTBEAT'),
    j AS (SELECT s.id, s.attempt, s.max_attempts, a.claim_origin, a.execution_started_persisted_at IS NOT NULL OR r.job_id IS NOT NULL AS started, b.job_id IS NOT NULL AS beaten FROM stale s
        LEFT JOIN job_attempts a ON a.job_id = s.id AND a.run_number = s.run_number AND a.attempt = s.attempt LEFT JOIN ran r ON r.job_id = s.id AND r.run_number = s.run_number AND r.attempt = s.attempt
        LEFT JOIN beat b ON b.job_id = s.id AND b.run_number = s.run_number AND b.attempt = s.attempt)
    SELECT id, CASE WHEN claim_origin = 'PRESTART' AND NOT started THEN 'RELEASE' WHEN attempt >= max_attempts THEN 'DEAD_LETTER' ELSE 'RETRY' END AS decision, started, started AND NOT beaten AS started_without_heartbeat FROM j"""


@query("x20_reap", "job_queue job_attempts job_events", _REAPED.replace("LEASES", "200"))
def _(l):
    return lifecycle.reap_decisions(l["job_queue"], l["job_attempts"], l["job_events"], AS_OF, 200).select("id", "decision", "started", "started_without_heartbeat")


@query("x24_patch_payload", "job_queue workflow_steps", """
    SELECT CAST(i AS BIGINT) AS id, CASE WHEN q.id IS NULL THEN 'NOT_FOUND' WHEN m.job_id IS NOT NULL THEN 'WORKFLOW_MANAGED' WHEN q.idempotency_key IS NOT NULL THEN 'IDEMPOTENT' WHEN q.status <> 'PENDING' THEN 'NOT_PENDING' WHEN q.attempt > 0 THEN 'ALREADY_CLAIMED' ELSE 'UPDATED' END AS outcome
    FROM (SELECT id AS i FROM job_queue UNION ALL SELECT -1) t LEFT JOIN job_queue q ON q.id = i LEFT JOIN (SELECT DISTINCT job_id FROM workflow_steps WHERE job_id IS NOT NULL) m ON m.job_id = i""")
def _(l):
    commands = _all_and_none(l).select("id", F.lit("tags").alias("field"), F.lit("[]").alias("value"))
    return lifecycle.patch_payload(l["job_queue"], l["workflow_steps"], commands).outcomes


# ---------------------------------------------------------------- outbox and schedules

@query("i2_eligible_intents", "job_enqueue_intents job_definitions", f"SELECT id, job_type FROM job_enqueue_intents WHERE status = 'PENDING' AND next_promotion_at <= {NOW} AND job_type IN ('jobs.p1', 'jobs.p4', 'jobs.p5') AND job_type IN (SELECT job_type FROM job_definitions WHERE is_enabled)")
def _(l):
    return intents.eligible(l["job_enqueue_intents"], l["job_definitions"], ["jobs.p1", "jobs.p4", "jobs.p5"], AS_OF).select("id", "job_type")


@query("i3_promotion_batch", "job_enqueue_intents job_definitions", f"SELECT id, job_type, next_promotion_at FROM job_enqueue_intents WHERE status = 'PENDING' AND next_promotion_at <= {NOW} AND job_type IN ('jobs.p1', 'jobs.p2') AND job_type IN (SELECT job_type FROM job_definitions WHERE is_enabled) ORDER BY next_promotion_at, created_at, id LIMIT 24")
def _(l):
    return intents.batch(l["job_enqueue_intents"], l["job_definitions"], ["jobs.p1", "jobs.p2"], AS_OF, 100).select("id", "job_type", "next_promotion_at")


@query("i5_deferral", "job_enqueue_intents", "SELECT id, round(least(240000.0, pow(2, least(promotion_attempts, 9)) * 1000) + (id % 100) / 100.0 * least(60000.0, pow(2, least(promotion_attempts, 9)) * 250), 3) AS delay_ms FROM job_enqueue_intents")
def _(l):
    return l["job_enqueue_intents"].select("id", F.round(deferral_ms(F.col("promotion_attempts"), F.col("id") % 100 / 100.0), 3).alias("delay_ms"))


@query("i6_retention", "job_enqueue_intents", "SELECT id FROM job_enqueue_intents WHERE status = 'PROMOTED' AND promoted_at < CAST('2024-01-28 12:00:00' AS TIMESTAMP) ORDER BY promoted_at, id LIMIT 40")
def _(l):
    return intents.delete_promoted_before(l["job_enqueue_intents"], "2024-01-28 12:00:00", 40)[1]


@query("i7_retention_by_job", "job_enqueue_intents", "SELECT id FROM job_enqueue_intents WHERE NOT (status = 'PROMOTED' AND coalesce(promoted_job_id IN (1, 4, 7, 10), false))")
def _(l):
    return intents.delete_promoted_for(l["job_enqueue_intents"], [1, 4, 7, 10]).select("id")


@query("h3_due_schedules", "job_schedules", f"SELECT id, name, next_fire_at FROM job_schedules WHERE is_active AND next_fire_at <= {NOW} ORDER BY next_fire_at, id LIMIT 20")
def _(l):
    return schedules.due_schedules(l["job_schedules"], AS_OF, 20).select("id", "name", "next_fire_at")


@query("h4_materialise", "job_schedules job_definitions", f"""
    SELECT s.id, s.job_type, CASE WHEN d.job_type IS NOT NULL THEN '{{"source":"schedule","_schedule":{{"id":"' || CAST(s.id AS VARCHAR) || '","name":"' || name || '","scheduled_for":"' || strftime(next_fire_at, '%Y-%m-%dT%H:%M:%S') || 'Z"}}}}' END AS payload,
        'scheduled' AS stage, CASE WHEN d.job_type IS NOT NULL THEN {NOW} ELSE {NOW} + INTERVAL '30' SECOND END AS next_run_at, d.job_type IS NOT NULL AS enqueued
    FROM (SELECT * FROM job_schedules WHERE is_active AND next_fire_at <= {NOW} ORDER BY next_fire_at, id LIMIT 1000) s LEFT JOIN job_definitions d ON d.job_type = s.job_type AND d.is_enabled""")
def _(l):
    return schedules.materialise(l["job_schedules"], l["job_definitions"], AS_OF, 1000)


_JITTER = "CASE WHEN max_jitter_seconds > 0 THEN xor(id, epoch_ms(k.fire)) % (max_jitter_seconds + 1) ELSE 0 END * INTERVAL '1' SECOND"


@query("h5_next_fires", "job_schedules", f"""
    WITH f AS (SELECT unnest(range(TIMESTAMP '2024-01-28 00:00:00', TIMESTAMP '2024-02-05 00:00:00', INTERVAL '1' MINUTE)) AS fire),
    k AS (SELECT '0 * * * * *' AS cron, fire FROM f UNION ALL SELECT '0 */15 * * * *', fire FROM f WHERE minute(fire) % 15 = 0 UNION ALL SELECT '0 30 2 * * Mon-Fri', fire FROM f WHERE hour(fire) = 2 AND minute(fire) = 30 AND isodow(fire) <= 5),
    b AS (SELECT s.id, arg_min(k.fire + {_JITTER}, k.fire) AS first FROM job_schedules s JOIN k ON k.cron = s.cron_expr AND k.fire > s.next_fire_at GROUP BY s.id),
    a AS (SELECT s.id, min(k.fire + {_JITTER}) AS later FROM job_schedules s JOIN k ON k.cron = s.cron_expr AND k.fire + {_JITTER} > {NOW} AND k.fire > {NOW} - CASE WHEN max_jitter_seconds > 0 THEN max_jitter_seconds + 1 ELSE 0 END * INTERVAL '1' SECOND GROUP BY s.id)
    SELECT s.id, cron_expr, next_fire_at, CASE WHEN first > {NOW} THEN first ELSE later END AS following_fire_at FROM job_schedules s JOIN b USING (id) JOIN a USING (id)""")
def _(l):
    return schedules.next_fires(l["job_schedules"], AS_OF).select("id", "cron_expr", "next_fire_at", "following_fire_at")


@query("h9_deactivate", "job_schedules", "SELECT name FROM job_schedules WHERE is_active AND name IN ('schedule-1', 'schedule-2', 'schedule-3') AND name NOT IN ('schedule-2')")
def _(l):
    return schedules.to_deactivate(l["job_schedules"], ["schedule-1", "schedule-2", "schedule-3"], ["schedule-2"])


# ---------------------------------------------------------------- workflow graphs

_PER_STEP = """per AS (SELECT s.id, s.workflow_run_id, s.status, s.execution_kind, count(p.id) AS total, count(p.id) FILTER (WHERE p.status NOT IN ('SUCCEEDED', 'FAILED', 'CANCELED')) AS pending,
    count(p.id) FILTER (WHERE p.status IN ('FAILED', 'CANCELED') AND e.release_mode = 'ON_SUCCESS') AS unsatisfied
    FROM workflow_steps s LEFT JOIN workflow_step_dependencies e ON e.dependent_step_id = s.id LEFT JOIN workflow_steps p ON p.id = e.prerequisite_step_id GROUP BY ALL)"""


@query("d7_dependency_counts", "workflow_steps workflow_step_dependencies", f"WITH {_PER_STEP} SELECT id, total, pending, unsatisfied FROM per")
def _(l):
    return workflow.dependency_counts(l["workflow_steps"], l["workflow_step_dependencies"]).select("id", "total", "pending", "unsatisfied")


@query("d8_ready_steps", "workflow_runs workflow_steps workflow_step_dependencies", f"""WITH {_PER_STEP}
    SELECT p.id, p.workflow_run_id, CASE WHEN unsatisfied > 0 THEN 'CANCELED' WHEN execution_kind = 'EXTERNAL' THEN 'WAITING_FOR_EXTERNAL' ELSE 'ENQUEUED' END AS becomes
    FROM per p JOIN workflow_runs r ON r.id = p.workflow_run_id WHERE p.status = 'BLOCKED' AND pending = 0 AND r.status IN ('RUNNING', 'WAITING_FOR_EXTERNAL')""")
def _(l):
    return workflow.ready_steps(l["workflow_steps"], l["workflow_step_dependencies"], l["workflow_runs"]).select("id", "workflow_run_id", "becomes")


def _waves(n: int) -> str:
    """``n`` waves of settling, each a table of all steps; the supplied graphs have paths of ten steps."""
    waves = "w0 AS MATERIALIZED (SELECT id, workflow_run_id, execution_kind, status FROM workflow_steps)"
    for k in range(1, n + 1):
        waves += f""", p{k} AS (SELECT e.dependent_step_id AS id, count(*) FILTER (WHERE s.status NOT IN ('SUCCEEDED', 'FAILED', 'CANCELED')) AS pending,
                count(*) FILTER (WHERE s.status IN ('FAILED', 'CANCELED') AND e.release_mode = 'ON_SUCCESS') AS unsatisfied FROM workflow_step_dependencies e JOIN w{k - 1} s ON s.id = e.prerequisite_step_id GROUP BY 1),
            w{k} AS MATERIALIZED (SELECT w.id, workflow_run_id, execution_kind, CASE WHEN status <> 'BLOCKED' OR coalesce(pending, 0) > 0 THEN status WHEN coalesce(unsatisfied, 0) > 0 THEN 'CANCELED'
                WHEN execution_kind = 'EXTERNAL' THEN 'WAITING_FOR_EXTERNAL' ELSE 'ENQUEUED' END AS status FROM w{k - 1} w LEFT JOIN p{k} USING (id))"""
    return waves


@query("d9_propagate", "workflow_steps workflow_step_dependencies", f"""WITH {_waves(11)} SELECT w11.id, workflow_run_id, status, coalesce(pending, 0) AS pending, coalesce(unsatisfied, 0) AS unsatisfied FROM w11 LEFT JOIN p11 USING (id)""")
def _(l):
    return workflow.propagate(l["workflow_steps"], l["workflow_step_dependencies"])


@query("d9_downstream", "workflow_step_dependencies workflow_steps", """
    SELECT DISTINCT root, id FROM (WITH RECURSIVE reach AS (SELECT prerequisite_step_id AS root, dependent_step_id AS id FROM workflow_step_dependencies
        UNION SELECT r.root, e.dependent_step_id FROM reach r JOIN workflow_step_dependencies e ON e.prerequisite_step_id = r.id) SELECT * FROM reach)""")
def _(l):
    return workflow.downstream(l["workflow_step_dependencies"], l["workflow_steps"].select("id"))


@query("d10_run_status", "workflow_runs workflow_steps", """
    SELECT r.id, CASE WHEN r.status = 'CANCELED' THEN 'CANCELED' WHEN active > 0 THEN 'RUNNING' WHEN waiting > 0 THEN 'WAITING_FOR_EXTERNAL' WHEN errored > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'SUCCEEDED' END AS status, active, waiting, errored
    FROM workflow_runs r JOIN (SELECT workflow_run_id, count(*) FILTER (WHERE status IN ('ENQUEUED', 'RUNNING', 'BLOCKED')) AS active, count(*) FILTER (WHERE status = 'WAITING_FOR_EXTERNAL') AS waiting,
        count(*) FILTER (WHERE status IN ('FAILED', 'CANCELED')) AS errored FROM workflow_steps GROUP BY 1) s ON s.workflow_run_id = r.id""")
def _(l):
    return workflow.run_status(l["workflow_steps"], l["workflow_runs"])


@query("d14_cancel_runs", "workflow_runs workflow_steps", """
    SELECT s.id, s.workflow_run_id, CASE WHEN execution_kind = 'EXTERNAL' OR s.status = 'BLOCKED' THEN 'CANCEL_STEP' ELSE 'CANCEL_JOB_AND_STEP' END AS action
    FROM workflow_steps s JOIN workflow_runs r ON r.id = s.workflow_run_id WHERE r.status NOT IN ('SUCCEEDED', 'COMPLETED_WITH_ERRORS', 'CANCELED') AND s.status NOT IN ('SUCCEEDED', 'FAILED', 'CANCELED')""")
def _(l):
    return workflow.cancel_run(l["workflow_steps"], l["workflow_runs"], l["workflow_runs"].select("id"))


@query("d15_recovery_blueprint", "workflow_runs workflow_steps workflow_step_dependencies", """
    SELECT s.workflow_run_id, s.step_key, s.execution_kind, coalesce((SELECT string_agg(p.step_key || ':' || e.release_mode, ',' ORDER BY p.step_key) FROM workflow_step_dependencies e JOIN workflow_steps p ON p.id = e.prerequisite_step_id WHERE e.dependent_step_id = s.id), '') AS needs
    FROM workflow_steps s JOIN workflow_runs r ON r.id = s.workflow_run_id WHERE r.status IN ('SUCCEEDED', 'COMPLETED_WITH_ERRORS', 'CANCELED')""")
def _(l):
    return workflow.recovery_blueprint(l["workflow_runs"], l["workflow_steps"], l["workflow_step_dependencies"], l["workflow_runs"].select(F.col("id").alias("source_run_id")))


@query("d1_cycles", "workflow_step_dependencies", "SELECT workflow_run_id, CAST(dependent_step_id AS VARCHAR) AS step_key FROM workflow_step_dependencies WHERE false")
def _(l):
    edges = l["workflow_step_dependencies"].select("workflow_run_id", F.col("prerequisite_step_id").cast("string").alias("prerequisite_key"), F.col("dependent_step_id").cast("string").alias("dependent_key"))
    return workflow.cycles(edges)


@query("x3_canonical_requests", "job_queue", "SELECT id, enqueue_request AS request FROM job_queue WHERE enqueue_request IS NOT NULL")
def _(l):
    return l["job_queue"].where("enqueue_request IS NOT NULL").select("id", canonical_json("enqueue_request").alias("request"))


# ---------------------------------------------------------------- streams

@query("st6_job_states", "job_events", """
    SELECT job_id, max(run_number) AS run_number, count(*) FILTER (WHERE e.run_number < top) AS stale_events, count(*) FILTER (WHERE e.run_number >= top) AS events,
           arg_max(event_type, (occurred_at, id)) FILTER (WHERE e.run_number >= top) AS last_event
    FROM (SELECT *, coalesce(max(run_number) OVER (PARTITION BY job_id ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM job_events) e GROUP BY job_id""")
def _(l):
    return job_states.drain(l["job_events"])


@query("st7_terminal_changes", "workflow_runs", "SELECT id, status FROM workflow_runs WHERE status IN ('SUCCEEDED', 'COMPLETED_WITH_ERRORS', 'CANCELED')")
def _(l):
    return job_states.drain_terminal_runs(l["workflow_runs"])


# ---------------------------------------------------------------- single operators

@query("f1_scopes", "job_queue", """
    SELECT 'admin' AS scope, count(*) AS jobs FROM job_queue UNION ALL SELECT 'global', count(*) FROM job_queue WHERE organization_id IS NULL UNION ALL SELECT 'organization', count(*) FROM job_queue WHERE organization_id = 4""")
def _(l):
    scopes = {"admin": Scope.admin(), "global": Scope.tenantless(), "organization": Scope.of(4)}
    seen = F.explode(F.array_compact(F.array(*(F.when(s.sees(), name) for name, s in scopes.items())))).alias("scope")
    return l["job_queue"].select(seen).groupBy("scope").agg(F.count(F.lit(1)).alias("jobs"))


@query("j14_free_resources", "job_queue job_execution_resource_claims", "SELECT id FROM job_queue q WHERE status = 'PENDING' AND execution_resource_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM job_execution_resource_claims c WHERE c.resource_key = q.execution_resource_key)")
def _(l):
    taken = l["job_execution_resource_claims"].select(F.col("resource_key").alias("execution_resource_key"))
    return l["job_queue"].where("status = 'PENDING' AND execution_resource_key IS NOT NULL").join(taken, "execution_resource_key", "left_anti").select("id")


@query("j19_first_running_event", "job_events", "SELECT job_id, run_number, attempt, arg_min(occurred_at, id) AS running_at FROM job_events WHERE event_type = 'STAGE_CHANGED' AND stage = 'running' GROUP BY ALL")
def _(l):
    ran = l["job_events"].where("event_type = 'STAGE_CHANGED' AND stage = 'running'")
    return ran.groupBy("job_id", "run_number", "attempt").agg(F.min_by("occurred_at", "id").alias("running_at"))


@query("j21_workflow_managed", "job_queue workflow_steps", "SELECT id, EXISTS (SELECT 1 FROM workflow_steps s WHERE s.job_id = q.id) AS workflow_managed FROM job_queue q")
def _(l):
    managed = l["workflow_steps"].where("job_id IS NOT NULL").select(F.col("job_id").alias("id"), F.lit(True).alias("managed")).distinct()
    return l["job_queue"].select("id").join(managed, "id", "left").select("id", F.col("managed").isNotNull().alias("workflow_managed"))


@query("u1_metric_keys", "job_queue job_dead_letters job_events", f"SELECT {ORG}, job_type FROM (SELECT organization_id, job_type FROM job_queue WHERE status = 'PENDING' UNION SELECT organization_id, job_type FROM job_dead_letters WHERE failed_at >= {DAY})")
def _(l):
    from jobloom.functions.predicates import last_day

    pending = l["job_queue"].where("status = 'PENDING'").select("organization_id", "job_type")
    dead = l["job_dead_letters"].where(last_day(AS_OF, "failed_at")).select("organization_id", "job_type")
    return pending.union(dead).distinct().select(org(), "job_type")


@query("u3_difference", "job_queue job_definitions", "SELECT job_type FROM job_definitions EXCEPT SELECT job_type FROM job_queue")
def _(l):
    return l["job_definitions"].select("job_type").subtract(l["job_queue"].select("job_type"))


@query("p6_json_objects", "job_queue", """SELECT id, CASE WHEN worker_id IS NULL THEN concat('{"status":"', status, '","run":', CAST(run_number AS VARCHAR), '}') ELSE concat('{"status":"', status, '","run":', CAST(run_number AS VARCHAR), ',"worker":"', worker_id, '"}') END AS note FROM job_queue""")
def _(l):
    return l["job_queue"].select("id", F.to_json(F.struct("status", F.col("run_number").alias("run"), F.col("worker_id").alias("worker"))).alias("note"))


@query("src3_json_records", "job_queue", "SELECT id, 'k' || CAST(id % 3 AS VARCHAR) AS k, CAST(CASE WHEN id % 2 = 0 THEN -1 ELSE id END AS BIGINT) AS n FROM job_queue")
def _(l):
    text = F.concat(F.lit('[{"k":"k'), (F.col("id") % 3).cast("string"), F.lit('","n":'), F.when(F.col("id") % 2 == 0, "null").otherwise(F.col("id").cast("string")), F.lit("}]"))
    rows = l["job_queue"].select("id", text.alias("records")).select("id", F.inline(F.from_json("records", "array<struct<k:string,n:bigint>>")))
    return rows.select("id", "k", F.coalesce("n", F.lit(-1).cast("long")).alias("n"))


@query("src5_array_with_ordinality", "workflow_step_dependencies", "SELECT dependent_step_id, prerequisite_step_id, row_number() OVER (PARTITION BY dependent_step_id ORDER BY prerequisite_step_id) AS place FROM workflow_step_dependencies")
def _(l):
    packed = l["workflow_step_dependencies"].groupBy("dependent_step_id").agg(F.array_sort(F.collect_list("prerequisite_step_id")).alias("needs"))
    return packed.select("dependent_step_id", F.posexplode("needs").alias("place", "prerequisite_step_id")).select("dependent_step_id", "prerequisite_step_id", (F.col("place") + 1).cast("long").alias("place"))


@query("snk3_upsert", "job_dead_letters", "SELECT job_id, CASE WHEN job_id % 2 = 0 THEN 'again' ELSE error_code END AS error_code FROM job_dead_letters UNION ALL SELECT -1, 'again'")
def _(l):
    from jobloom.operators.changes import upsert

    base = l["job_dead_letters"].select("job_id", "error_code")
    rows = base.where("job_id % 2 = 0").select("job_id", F.lit("again").alias("error_code")).union(l.spark.sql("SELECT -1L, 'again'"))
    return upsert(base, rows, ["job_id"])


@query("snk4_insert_missing", "job_runtime_configs", "SELECT job_type, schema_version FROM job_runtime_configs UNION ALL SELECT 'jobs.new', 1")
def _(l):
    from jobloom.operators.changes import insert_missing

    base = l["job_runtime_configs"].select("job_type", "schema_version")
    return insert_missing(base, l.spark.sql("SELECT 'jobs.new' AS job_type, 1 AS schema_version UNION ALL SELECT 'jobs.p1', 99"), ["job_type"])


_COMMANDS = "SELECT id AS ordinal, job_type, organization_id, idempotency_key, id % 400 AS n FROM job_enqueue_intents"


@query("x2_enqueue", "job_queue job_enqueue_intents job_definitions", f"""
    WITH c AS ({_COMMANDS}), j AS (SELECT c.*, q.id AS there, q.enqueue_request AS r, d.job_type AS defined, row_number() OVER (PARTITION BY c.job_type, c.organization_id, c.idempotency_key ORDER BY ordinal) AS nth
        FROM c LEFT JOIN job_queue q ON q.job_type = c.job_type AND q.organization_id IS NOT DISTINCT FROM c.organization_id AND q.idempotency_key = c.idempotency_key LEFT JOIN job_definitions d ON d.job_type = c.job_type AND d.is_enabled)
    SELECT ordinal, CASE WHEN there IS NOT NULL AND r IS NULL THEN 'LEGACY_KEY' WHEN there IS NOT NULL THEN 'CONFLICT' WHEN defined IS NULL THEN 'NO_ENABLED_DEFINITION' WHEN nth = 1 THEN 'INSERTED' ELSE 'EXISTING' END AS outcome FROM j""")
def _(l):
    commands = l["job_enqueue_intents"].select(
        F.col("id").alias("ordinal"), "job_type", "organization_id", F.concat(F.lit('{"n":'), (F.col("id") % 400).cast("string"), F.lit("}")).alias("payload"), F.lit(None).cast("int").alias("priority"),
        F.lit(None).cast("int").alias("max_attempts"), F.lit(None).cast("timestamp_ntz").alias("next_run_at"), "idempotency_key", F.lit(None).cast("string").alias("stage"),
    )
    return lifecycle.enqueue(l["job_queue"], l["job_definitions"], commands, AS_OF, 10_000_000).outcomes.select("ordinal", "outcome")


@query("i1_record", "job_enqueue_intents", """
    WITH c AS (SELECT id AS ordinal, * FROM job_enqueue_intents WHERE id % 2 = 0), base AS (SELECT DISTINCT job_type, organization_id, idempotency_key FROM job_enqueue_intents WHERE id % 2 = 1)
    SELECT ordinal, CASE WHEN b.job_type IS NOT NULL THEN 'EXISTING' WHEN row_number() OVER (PARTITION BY c.job_type, c.organization_id, c.idempotency_key ORDER BY ordinal) = 1 THEN 'INSERTED' ELSE 'EXISTING' END AS outcome
    FROM c LEFT JOIN base b ON b.job_type = c.job_type AND b.organization_id IS NOT DISTINCT FROM c.organization_id AND b.idempotency_key = c.idempotency_key""")
def _(l):
    table = l["job_enqueue_intents"]
    there = table.where("id % 2 = 1").dropDuplicates(["job_type", "organization_id", "idempotency_key"])
    return intents.record(there, table.where("id % 2 = 0").withColumnRenamed("id", "ordinal"), AS_OF, 1_000_000).outcomes


_LIVE = f"status = 'LEASED' AND lease_expires_at > {NOW}"


def _fence(l, condition):
    return l["job_queue"].where(f"status = 'LEASED' AND {condition}").select("id", "run_number", "attempt", "worker_id")


@query("x10_success", "job_queue", f"SELECT id, 'SUCCEEDED' AS status, run_number, attempt FROM job_queue WHERE {_LIVE}")
def _(l):
    return lifecycle.succeed(l["job_queue"], _fence(l, "true"), AS_OF).upserts["job_queue"].select("id", "status", "run_number", "attempt")


@query("x9_heartbeat", "job_queue", f"SELECT id, {NOW} + INTERVAL '90' SECOND AS lease_expires_at FROM job_queue WHERE {_LIVE}")
def _(l):
    return lifecycle.heartbeat(l["job_queue"], _fence(l, "true"), 90, AS_OF).upserts["job_queue"].select("id", "lease_expires_at")


@query("x14_failures", "job_queue", f"""
    SELECT id, CASE WHEN id % 3 = 0 OR attempt >= max_attempts THEN 'DEAD_LETTERED' ELSE 'PENDING' END AS status,
           CASE WHEN id % 3 = 0 OR attempt >= max_attempts THEN next_run_at ELSE {NOW} + greatest(1000, least(5000 * CAST(pow(2, least(greatest(attempt, 1), 10)) AS BIGINT), 300000) + id % 1000 - 500) * INTERVAL '1' MILLISECOND END AS next_run_at
    FROM job_queue WHERE {_LIVE}""")
def _(l):
    kind = F.when(F.col("id") % 3 == 0, "TERMINAL").otherwise("RETRYABLE")
    commands = _fence(l, "true").withColumns({"kind": kind, "error_code": F.lit("e"), "not_before": F.lit(None).cast("timestamp_ntz")})
    return lifecycle.fail(l["job_queue"], commands, AS_OF).upserts["job_queue"].select("id", "status", "next_run_at")


@query("x16_continuation", "job_queue", f"SELECT id, run_number + 1 AS run_number, 0 AS attempt, {NOW} + INTERVAL '2500' MILLISECOND AS next_run_at FROM job_queue WHERE {_LIVE}")
def _(l):
    commands = _fence(l, "true").withColumn("delay_us", F.lit(2_500_000))
    return lifecycle.continue_after(l["job_queue"], commands, AS_OF).upserts["job_queue"].select("id", "run_number", "attempt", "next_run_at")


@query("x6_release_unstarted", "job_queue", "SELECT id, 'PENDING' AS status, attempt - 1 AS attempt FROM job_queue WHERE status = 'LEASED'")
def _(l):
    return claims.release_unstarted(l["job_queue"], _fence(l, "true"), AS_OF).upserts["job_queue"].select("id", "status", "attempt")


@query("x19_replay", "job_queue", """SELECT id AS ordinal, CASE WHEN id % 7 = 0 THEN CASE WHEN id % 2 = 0 THEN 'EXISTING' ELSE 'CONFLICT' END WHEN status <> 'SUCCEEDED' OR run_number <> 1 THEN 'EXPECTATION_MISMATCH' WHEN id % 2 = 0 THEN 'EXISTING' ELSE 'REPLAYED' END AS outcome FROM job_queue
    UNION ALL SELECT -id, CASE WHEN id % 7 = 0 THEN 'EXISTING' WHEN status <> 'SUCCEEDED' OR run_number <> 1 THEN 'EXPECTATION_MISMATCH' ELSE 'REPLAYED' END FROM job_queue WHERE id % 2 = 0
    UNION ALL SELECT 0, 'NOT_FOUND'""")
def _(l):
    # a seventh was replayed before, half of these for another reason; every second one is asked for twice
    key = lambda ordinal: l["job_queue"].select(ordinal.alias("ordinal"), F.col("id").alias("source_job_id"), F.lit(1).alias("source_run_number"), F.lit("k").alias("replay_request_key"), F.lit("again").alias("reason"))
    done = l["job_queue"].where("id % 7 = 0").select(F.col("id").alias("source_job_id"), F.lit(1).alias("source_run_number"), F.lit("k").alias("replay_request_key"), F.when(F.col("id") % 2 == 0, "again").otherwise("other").alias("reason"), (F.col("id") + 5_000_000).alias("replay_job_id"))
    twice = key(-F.col("id")).where("source_job_id % 2 = 0")
    absent = l.spark.sql("SELECT 0L AS ordinal, -1L AS source_job_id, 1 AS source_run_number, 'k' AS replay_request_key, 'again' AS reason")
    return lifecycle.replay(l["job_queue"], done, key(F.col("id")).unionByName(twice).unionByName(absent), AS_OF, 10_000_000).outcomes


@query("x20_reap_report", "job_queue job_attempts job_events", _REAPED.replace("LEASES", "1000").replace("SELECT id, CASE WHEN claim_origin", "SELECT decision, count(*) AS count FROM (SELECT id, CASE WHEN claim_origin") + ") GROUP BY decision")
def _(l):
    return lifecycle.reap(l["job_queue"], l["job_attempts"], l["job_events"], AS_OF, 1000).outcomes


@query("i3_promotion_report", "job_enqueue_intents job_queue job_definitions", f"""
    WITH b AS (SELECT * FROM job_enqueue_intents WHERE status = 'PENDING' AND next_promotion_at <= {NOW} AND job_type IN ('jobs.p1', 'jobs.p2', 'jobs.p3', 'jobs.p5') AND job_type IN (SELECT job_type FROM job_definitions WHERE is_enabled) ORDER BY next_promotion_at, created_at, id LIMIT 24),
    m AS (SELECT b.*, q.id AS there_id, q.enqueue_request AS there, row_number() OVER (PARTITION BY b.job_type, b.organization_id, b.idempotency_key ORDER BY b.created_at, b.id) AS nth
        FROM b LEFT JOIN job_queue q ON q.job_type = b.job_type AND q.organization_id IS NOT DISTINCT FROM b.organization_id AND q.idempotency_key = b.idempotency_key)
    SELECT CASE WHEN there_id IS NOT NULL AND there IS DISTINCT FROM enqueue_request THEN 'DEFERRED' WHEN there_id IS NOT NULL OR nth > 1 THEN 'EXISTING' ELSE 'PROMOTED' END AS outcome, count(*) AS count FROM m GROUP BY 1""")
def _(l):
    return intents.promote(l["job_enqueue_intents"], l["job_queue"], l["job_definitions"], ["jobs.p1", "jobs.p2", "jobs.p3", "jobs.p5"], AS_OF, 10_000_000).outcomes


@query("d5_step_defaults", "workflow_steps job_definitions", """
    SELECT s.id, coalesce(CASE WHEN execution_kind = 'JOB' THEN CASE WHEN s.id % 3 = 0 THEN 7 ELSE d.default_priority END END, -1) AS priority
    FROM workflow_steps s LEFT JOIN job_definitions d ON d.is_enabled AND d.job_type = 'jobs.p' || CAST(1 + s.id % 5 AS VARCHAR)""")
def _(l):
    steps = l["workflow_steps"].withColumns({"job_type": F.concat(F.lit("jobs.p"), (1 + F.col("id") % 5).cast("string")), "priority": F.when(F.col("id") % 3 == 0, 7), "max_attempts": F.lit(None).cast("int"), "timeout_seconds": F.lit(None).cast("int")})
    return workflow.step_defaults(steps, l["job_definitions"]).select("id", F.coalesce("priority", F.lit(-1)).alias("priority"))


@query("d12_external_completion", "workflow_steps", """
    SELECT id, CASE WHEN execution_kind <> 'EXTERNAL' THEN 'NOT_EXTERNAL' WHEN status = 'WAITING_FOR_EXTERNAL' THEN 'COMPLETED' WHEN status = 'SUCCEEDED' AND output IS NOT NULL THEN 'ALREADY_COMPLETED'
           WHEN status IN ('SUCCEEDED', 'FAILED', 'CANCELED') THEN 'CONFLICT' ELSE 'NOT_WAITING' END AS outcome FROM workflow_steps""")
def _(l):
    output = F.concat(F.lit('{ "v" : '), F.col("id").cast("string"), F.lit(".0 }"))
    commands = l["workflow_steps"].select("id", F.lit("SUCCEEDED").alias("new_status"), output.alias("new_output"))
    return workflow.complete_external(l["workflow_steps"], commands, AS_OF).select("id", "outcome")


@query("d18_active_keys", "workflow_runs", """
    SELECT id AS ordinal, CASE WHEN EXISTS (SELECT 1 FROM workflow_runs r WHERE r.status IN ('RUNNING', 'WAITING_FOR_EXTERNAL') AND r.idempotency_key = c.idempotency_key) THEN 'EXISTING' ELSE 'ENQUEUED' END AS outcome
    FROM workflow_runs c WHERE idempotency_key IS NOT NULL""")
def _(l):
    runs = l["workflow_runs"].withColumnRenamed("idempotency_key", "active_key")
    commands = runs.where("active_key IS NOT NULL").select(F.col("id").alias("ordinal"), "workflow_type", "organization_id", "active_key")
    return workflow.active_key(runs, commands).select("ordinal", "outcome")


@query("d13_append_counters", "workflow_steps", """
    SELECT 'new-' || CAST(id % 20 AS VARCHAR) AS dependent_key, count(*) AS total, count(*) FILTER (WHERE status NOT IN ('SUCCEEDED', 'FAILED', 'CANCELED')) AS pending, count(*) FILTER (WHERE status IN ('FAILED', 'CANCELED')) AS unsatisfied
    FROM workflow_steps GROUP BY ALL""")
def _(l):
    edges = l["workflow_steps"].select(F.col("id").alias("prerequisite_step_id"), F.concat(F.lit("new-"), (F.col("id") % 20).cast("string")).alias("dependent_key"), F.lit("ON_SUCCESS").alias("release_mode"))
    return workflow.appendable(l["workflow_steps"], edges).drop("born_unsatisfied")


@query("d16_canonical_requests", "workflow_steps workflow_step_dependencies", r"""
    SELECT workflow_run_id, '{"steps":[' || steps || ']' || CASE WHEN deps IS NULL THEN '' ELSE ',"dependencies":[' || deps || ']' END || '}' AS request
    FROM (SELECT workflow_run_id, string_agg('{"step_key":"' || step_key || '","execution_kind":"' || execution_kind || '","job_type":"' || coalesce(job_type, '') || '","payload":"' || replace(payload, '"', '\"') || '"}', ',' ORDER BY step_key, execution_kind) AS steps FROM workflow_steps GROUP BY 1)
    LEFT JOIN (SELECT e.workflow_run_id, string_agg('{"dependent":"' || d.step_key || '","prerequisite":"' || p.step_key || '","release_mode":"' || release_mode || '"}', ',' ORDER BY d.step_key, p.step_key, release_mode) AS deps
        FROM workflow_step_dependencies e JOIN workflow_steps d ON d.id = e.dependent_step_id JOIN workflow_steps p ON p.id = e.prerequisite_step_id GROUP BY 1) USING (workflow_run_id)""")
def _(l):
    return workflow.canonical_request(l["workflow_steps"], l["workflow_step_dependencies"])


# ---------------------------------------------------------------- changes applied to all tables they touch

def _snapshot(after):
    """The tables that job transitions touch, a row of text for each of theirs."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    row = lambda name, key, *values: after[name].select(F.lit(name).alias("tbl"), key.cast("string").alias("k"), F.concat_ws("|", *map(none, values)).alias("v"))
    return (
        row("job_queue", F.col("id"), "status", "run_number", "attempt", "worker_id", "stage", "lease_expires_at", "next_run_at")
        .unionByName(row("job_attempts", F.concat_ws(":", "job_id", "run_number", "attempt"), "worker_id", "started_at", "finished_at", "outcome"))
        .unionByName(row("job_execution_resource_claims", F.col("resource_key"), "job_id", "lease_expires_at"))
        .unionByName(row("job_dead_letters", F.concat_ws(":", "job_id", "run_number"), "attempt", "error_code"))
        .unionByName(after["job_events"].groupBy("event_type").count().select(F.lit("job_events").alias("tbl"), F.col("event_type").alias("k"), F.col("count").cast("string").alias("v")))
    )


def _applied(name, hit, make, events, status="status", run="run_number", attempt="attempt", worker="NULL", stage="stage", until="NULL", next_run="next_run_at", ends=None, gone=False, claim="DELETED", dead="false", error="''"):
    """Registers a transition applied to the ledger. ``hit`` are the jobs it changes; the other arguments are SQL of what becomes of them."""
    text = lambda *columns: "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns) + ")"
    new = lambda value, old: value if value == old else f"CASE WHEN hit THEN {value} ELSE {old} END"
    queue = text(new(status, "status"), new(run, "run_number"), new(attempt, "attempt"), new(worker, "worker_id"), new(stage, "stage"), new(until, "lease_expires_at"), new(next_run, "next_run_at"))
    finished, outcome = ("a.finished_at", "a.outcome") if ends is None else (f"CASE WHEN hit THEN {NOW} ELSE a.finished_at END", f"CASE WHEN hit THEN {ends} ELSE a.outcome END")
    kept = {"DELETED": "NOT coalesce(hit, false)", "KEPT": "true"}.get(claim, claim)
    lease = f"CASE WHEN hit THEN {until} ELSE c.lease_expires_at END" if claim == "KEPT" and until != "lease_expires_at" else "c.lease_expires_at"
    logged = " UNION ALL ".join(f"SELECT '{kind}', count(*) FROM t WHERE hit AND ({when})" for kind, when in events)
    sql = f"""WITH t AS (SELECT *, coalesce({hit}, false) AS hit, coalesce({dead}, false) AS dead FROM job_queue)
        SELECT 'job_queue' AS tbl, CAST(id AS VARCHAR) AS k, {queue} AS v FROM t
        UNION ALL SELECT 'job_attempts', concat_ws(':', a.job_id, a.run_number, a.attempt), {text("a.worker_id", "a.started_at", finished, outcome)}
            FROM job_attempts a LEFT JOIN t ON t.id = a.job_id AND t.run_number = a.run_number AND t.attempt = a.attempt WHERE {"NOT coalesce(hit, false)" if gone else "true"}
        UNION ALL SELECT 'job_execution_resource_claims', c.resource_key, {text("c.job_id", lease)}
            FROM job_execution_resource_claims c LEFT JOIN t ON t.id = c.job_id AND t.execution_resource_key = c.resource_key WHERE {kept}
        UNION ALL SELECT 'job_dead_letters', concat_ws(':', job_id, run_number), concat_ws('|', attempt, error_code) FROM job_dead_letters
        UNION ALL SELECT 'job_dead_letters', concat_ws(':', id, run_number), concat_ws('|', attempt, {error}) FROM t WHERE hit AND dead
        UNION ALL SELECT 'job_events', event_type, CAST(sum(n) AS VARCHAR) FROM (SELECT event_type, count(*) AS n FROM job_events GROUP BY 1 UNION ALL {logged}) GROUP BY event_type HAVING sum(n) > 0"""
    query(name, "job_queue job_attempts job_execution_resource_claims job_dead_letters job_events", sql)(lambda l: _snapshot(make(l).apply(_touched(l))))


def _touched(l):
    return {name: l[name] for name in ("job_queue", "job_attempts", "job_execution_resource_claims", "job_dead_letters", "job_events")}


_applied("snk1_success", _LIVE, lambda l: lifecycle.succeed(l["job_queue"], _fence(l, "true"), AS_OF), [("SUCCEEDED", "true")], status="'SUCCEEDED'", stage="'completed'", ends="NULL")
_applied("snk1_heartbeat", _LIVE, lambda l: lifecycle.heartbeat(l["job_queue"], _fence(l, "true"), 90, AS_OF), [("HEARTBEAT", "true")], worker="worker_id", until=f"{NOW} + INTERVAL '90' SECOND", claim="KEPT")
_applied("snk1_release", "status = 'LEASED'", lambda l: claims.release_unstarted(l["job_queue"], _fence(l, "true"), AS_OF), [("REQUEUED", "true")], status="'PENDING'", attempt="attempt - 1", stage="'queued'", gone=True)
_applied("snk1_cancel", "status IN ('PENDING', 'LEASED')", lambda l: lifecycle.cancel(l["job_queue"], l["job_queue"].select("id"), AS_OF), [("CANCELED", "true")], status="'CANCELED'", until="lease_expires_at", claim=f"NOT coalesce(status = 'LEASED' AND lease_expires_at <= {NOW}, false)".replace("lease_expires_at", "t.lease_expires_at"))
_applied("snk1_continuation", _LIVE, lambda l: lifecycle.continue_after(l["job_queue"], _fence(l, "true").withColumn("delay_us", F.lit(2_000_000)), AS_OF), [("REQUEUED", "true")], status="'PENDING'", run="run_number + 1", attempt="0", stage="'queued'", next_run=f"{NOW} + INTERVAL '2' SECOND", ends="NULL")
_applied(
    "snk1_failure", _LIVE, lambda l: lifecycle.fail(l["job_queue"], _fence(l, "true").withColumns({"kind": F.when(F.col("id") % 3 == 0, "TERMINAL").otherwise("RETRYABLE"), "error_code": F.lit("e"), "not_before": F.lit(None).cast("timestamp_ntz")}), AS_OF),
    [("FAILED", "true"), ("RETRY_SCHEDULED", "NOT dead"), ("DEAD_LETTERED", "dead")], status="CASE WHEN dead THEN 'DEAD_LETTERED' ELSE 'PENDING' END", stage="CASE WHEN dead THEN 'completed' ELSE 'queued' END", ends="CASE WHEN id % 3 = 0 THEN 'TERMINAL' ELSE 'RETRYABLE' END".replace("id %", "t.id %"),
    next_run=f"CASE WHEN dead THEN next_run_at ELSE {NOW} + greatest(1000, least(5000 * CAST(pow(2, least(greatest(attempt, 1), 10)) AS BIGINT), 300000) + id % 1000 - 500) * INTERVAL '1' MILLISECOND END", dead="id % 3 = 0 OR attempt >= max_attempts", error="'e'",
)
_applied(
    "snk1_reap", f"status = 'LEASED' AND lease_expires_at < {NOW}", lambda l: lifecycle.reap(l["job_queue"], l["job_attempts"].limit(0), l["job_events"], AS_OF, None),
    [("LEASE_EXPIRED", "true"), ("RETRY_SCHEDULED", "NOT dead"), ("DEAD_LETTERED", "dead")], status="CASE WHEN dead THEN 'DEAD_LETTERED' ELSE 'PENDING' END", ends="'LEASE_EXPIRED'",
    next_run=f"CASE WHEN dead THEN next_run_at ELSE {NOW} + INTERVAL '30' SECOND END", dead="attempt >= max_attempts", error="'job.lease_expired'",
)


# ---------------------------------------------------------------- workflow writes

def _declared(l):
    """All runs of the ledger, declared anew: types by place, every fifth pair of runs under one key, and a disabled type in every 17th run."""
    runs = l["workflow_runs"].select(F.col("id").alias("ordinal"), "workflow_type", "organization_id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("new-"), F.floor(F.col("id") / 40).cast("string"))).alias("idempotency_key"), "result_step_key")
    place = F.col("id") % 10
    none = lambda kind: F.lit(None).cast(kind)
    kind = F.when(F.col("workflow_run_id") % 17 == 0, "jobs.p4").otherwise(F.concat(F.lit("jobs.p"), (1 + place % 3).cast("string")))
    steps = l["workflow_steps"].select(F.col("workflow_run_id").alias("ordinal"), F.col("id").alias("step_ordinal"), "step_key", "execution_kind", F.when(F.col("execution_kind") == "JOB", kind).alias("job_type"), "payload", none("int").alias("priority"), none("int").alias("max_attempts"), none("int").alias("timeout_seconds"), none("string").alias("stage"))
    key = lambda side: l["workflow_steps"].select(F.col("id").alias(f"{side}_step_id"), F.col("step_key").alias(f"{side}_key"))
    edges = l["workflow_step_dependencies"].join(by_key(key("dependent")), "dependent_step_id").join(by_key(key("prerequisite")), "prerequisite_step_id").select(F.col("workflow_run_id").alias("ordinal"), "prerequisite_key", "dependent_key", "release_mode")
    return runs, steps, edges


@query("d4_enqueue_run", "workflow_runs workflow_steps workflow_step_dependencies job_definitions", """
    WITH s AS (SELECT *, CASE WHEN execution_kind = 'JOB' THEN CASE WHEN workflow_run_id % 17 = 0 THEN 'jobs.p4' ELSE 'jobs.p' || CAST(1 + id % 10 % 3 AS VARCHAR) END END AS kind FROM workflow_steps),
    e AS (SELECT d.workflow_run_id, d.id, d.step_key || '<' || p.step_key || ':' || release_mode AS edge FROM workflow_step_dependencies x JOIN workflow_steps d ON d.id = dependent_step_id JOIN workflow_steps p ON p.id = prerequisite_step_id),
    r AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'new-' || CAST(id // 40 AS VARCHAR) END AS key, workflow_type, organization_id,
        (SELECT string_agg(step_key || execution_kind || coalesce(kind, '') || payload, ',' ORDER BY step_key) FROM s WHERE s.workflow_run_id = r.id) || coalesce((SELECT string_agg(edge, ',' ORDER BY edge) FROM e WHERE e.workflow_run_id = r.id), '') AS request,
        EXISTS (SELECT 1 FROM s WHERE s.workflow_run_id = r.id AND kind = 'jobs.p4') AS unknown FROM workflow_runs r),
    led AS (SELECT *, CASE WHEN key IS NULL THEN id ELSE min(id) OVER (PARTITION BY workflow_type, organization_id, key) END AS lead_of FROM r),
    o AS (SELECT led.id, CASE WHEN led.unknown THEN 'NO_ENABLED_DEFINITION' WHEN lead_of = led.id THEN 'INSERTED' WHEN led.request = f.request THEN 'EXISTING' ELSE 'CONFLICT' END AS outcome FROM led JOIN r f ON f.id = lead_of),
    new AS (SELECT s.*, (SELECT count(*) FROM e WHERE e.id = s.id) AS total FROM s JOIN o ON o.id = s.workflow_run_id AND outcome = 'INSERTED'),
    born AS (SELECT *, CASE WHEN total > 0 THEN 'BLOCKED' WHEN execution_kind = 'EXTERNAL' THEN 'WAITING_FOR_EXTERNAL' ELSE 'ENQUEUED' END AS now FROM new)
    SELECT 'outcome' AS tbl, id AS k, outcome AS v FROM o
    UNION ALL SELECT 'run', 1000000 + workflow_run_id, CASE WHEN bool_or(now IN ('BLOCKED', 'ENQUEUED')) THEN 'RUNNING' ELSE 'WAITING_FOR_EXTERNAL' END FROM born GROUP BY workflow_run_id
    UNION ALL SELECT 'step', 2000000 + id, now || '|' || CAST(total AS VARCHAR) || '|' || coalesce(kind, '-') FROM born
    UNION ALL SELECT 'job', 5000000 + id, kind || '|' || CAST(default_priority AS VARCHAR) || '|' || CAST(max_attempts AS VARCHAR) || '|' || payload FROM born JOIN job_definitions d ON d.job_type = kind WHERE now = 'ENQUEUED'
    UNION ALL SELECT 'edges', 0, CAST(count(*) AS VARCHAR) FROM e JOIN o ON o.id = e.workflow_run_id AND outcome = 'INSERTED'""")
def _(l):
    runs, steps, edges = _declared(l)
    there = {"job_definitions": l["job_definitions"], "workflow_runs": l["workflow_runs"].where("false")}
    change = workflow_writes.enqueue_runs(there, runs, steps, edges, AS_OF, 1_000_000, 2_000_000, 3_000_000)
    made = change.upserts
    row = lambda frame, name, key, value: frame.select(F.lit(name).alias("tbl"), key.cast("long").alias("k"), value.alias("v"))
    text = lambda *columns: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    return (
        row(change.outcomes, "outcome", F.col("ordinal"), F.col("outcome")).unionByName(row(made["workflow_runs"], "run", F.col("id"), F.col("status")))
        .unionByName(row(made["workflow_steps"], "step", F.col("id"), text("status", "pending", "job_type")))
        .unionByName(row(made["job_queue"], "job", F.col("id"), text("job_type", "priority", "max_attempts", "payload")))
        .unionByName(row(made["workflow_step_dependencies"].agg(F.count(F.lit(1)).alias("n")), "edges", F.lit(0), F.col("n").cast("string")))
    )


@query("d8_release", "workflow_runs workflow_steps workflow_step_dependencies job_definitions", f"""WITH {_waves(11)},
    live AS (SELECT * FROM workflow_runs WHERE status IN ('RUNNING', 'WAITING_FOR_EXTERNAL')),
    moved AS (SELECT s.*, w11.status AS becomes FROM workflow_steps s JOIN w11 USING (id) JOIN live ON live.id = s.workflow_run_id WHERE w11.status <> s.status)
    SELECT 'step' AS tbl, id AS k, becomes || '|' || CASE WHEN becomes = 'ENQUEUED' THEN CAST(3000000 + id AS VARCHAR) ELSE '-' END AS v FROM moved
    UNION ALL SELECT 'job', 3000000 + m.id, coalesce(m.job_type, '-') || '|' || coalesce(CAST(d.default_priority AS VARCHAR), '-') || '|' || m.payload FROM moved m LEFT JOIN job_definitions d ON d.job_type = m.job_type AND d.is_enabled WHERE becomes = 'ENQUEUED'
    UNION ALL SELECT 'run', live.id, CASE WHEN bool_or(w11.status IN ('ENQUEUED', 'RUNNING', 'BLOCKED')) THEN 'RUNNING' WHEN bool_or(w11.status = 'WAITING_FOR_EXTERNAL') THEN 'WAITING_FOR_EXTERNAL'
        WHEN bool_or(w11.status IN ('FAILED', 'CANCELED')) THEN 'COMPLETED_WITH_ERRORS' ELSE 'SUCCEEDED' END FROM live JOIN w11 ON w11.workflow_run_id = live.id GROUP BY live.id""")
def _(l):
    change = workflow_writes.release(l, AS_OF, 3_000_000)
    row = lambda frame, name, *values: frame.select(F.lit(name).alias("tbl"), F.col("id").alias("k"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in values)).alias("v"))
    return row(change.outcomes, "step", "status", "job_id").unionByName(row(change.upserts["job_queue"], "job", "job_type", "priority", "payload")).unionByName(row(change.updates["workflow_runs"], "run", "status"))


@query("d11_follow_jobs", "workflow_steps job_queue", """
    SELECT id, becomes AS status FROM (SELECT s.id, s.status, CASE q.status WHEN 'LEASED' THEN 'RUNNING' WHEN 'PENDING' THEN 'ENQUEUED' WHEN 'SUCCEEDED' THEN 'SUCCEEDED' WHEN 'DEAD_LETTERED' THEN 'FAILED' ELSE 'CANCELED' END AS becomes
    FROM workflow_steps s JOIN job_queue q ON q.id = s.job_id WHERE s.status NOT IN ('SUCCEEDED', 'FAILED', 'CANCELED')) WHERE becomes <> status""")
def _(l):
    return workflow_writes.follow_jobs(l["workflow_steps"], l["job_queue"], AS_OF).outcomes


@query("d13_append_steps", "workflow_steps workflow_runs", """
    SELECT w.id AS ordinal, CASE WHEN execution_kind <> 'EXTERNAL' OR w.status <> 'WAITING_FOR_EXTERNAL' OR r.status NOT IN ('RUNNING', 'WAITING_FOR_EXTERNAL') THEN 'WINDOW_CLOSED' WHEN w.id % 12 = 11 THEN 'INVALID' ELSE 'APPENDED' END AS outcome
    FROM workflow_steps w JOIN workflow_runs r ON r.id = w.workflow_run_id UNION ALL SELECT -1, 'NOT_FOUND'""")
def _(l):
    # each step as a window for two new ones, the second of which needs the first; some need a step that isn't there
    windows = l["workflow_steps"].select(F.col("id").alias("ordinal"), F.col("id").alias("window_step_id"), F.col("step_key").alias("window_key")).union(l.spark.sql("SELECT -1L, -1L, 'x'"))
    none = lambda kind: F.lit(None).cast(kind)
    new = windows.select("ordinal", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    steps = new.select("ordinal", (2 * F.col("ordinal") + F.col("n")).alias("step_ordinal"), F.concat(F.lit("more-"), F.col("n").cast("string")).alias("step_key"), F.lit("JOB").alias("execution_kind"), F.lit("jobs.p1").alias("job_type"), F.lit("{}").alias("payload"), none("int").alias("priority"), none("int").alias("max_attempts"), none("int").alias("timeout_seconds"), none("string").alias("stage"))
    edges = windows.select("ordinal", F.when(F.col("ordinal") % 12 == 11, "absent").otherwise(F.col("window_key")).alias("prerequisite_key"), F.lit("more-0").alias("dependent_key"), F.lit("ON_SUCCESS").alias("release_mode")).unionByName(
        windows.select("ordinal", F.lit("more-0").alias("prerequisite_key"), F.lit("more-1").alias("dependent_key"), F.lit("ON_SUCCESS").alias("release_mode")))
    return workflow_writes.append_steps(l, windows.drop("window_key"), steps, edges, AS_OF, 2_000_000, 3_000_000).outcomes.select("ordinal", "outcome")


# ---------------------------------------------------------------- other reads and writes

@query("f4_legacy_scope", "job_queue", "SELECT 'none' AS scope, count(*) AS jobs FROM job_queue UNION ALL SELECT 'organization', count(*) FROM job_queue WHERE organization_id = 4")
def _(l):
    scopes = {"none": Scope.from_legacy(None), "organization": Scope.from_legacy(4)}
    seen = F.explode(F.array_compact(F.array(*(F.when(s.sees(), name) for name, s in scopes.items())))).alias("scope")
    return l["job_queue"].select(seen).groupBy("scope").agg(F.count(F.lit(1)).alias("jobs"))


@query("q18_run_by_key", "workflow_runs", "SELECT id, status FROM workflow_runs WHERE workflow_type = 'flow.1' AND idempotency_key = 'wf-9' AND organization_id = 3")
def _(l):
    return reads.run_by_key(l["workflow_runs"], "flow.1", "wf-9", Scope.of(3)).select("id", "status")


@query("q16_all_runtime_configs", "job_runtime_configs", "SELECT job_type, schema_version, config FROM job_runtime_configs")
def _(l):
    return reads.runtime_configs(l["job_runtime_configs"]).select("job_type", "schema_version", "config")


@query("q20_page_of_steps", "workflow_runs workflow_steps", "SELECT id, step_key FROM workflow_steps WHERE workflow_run_id = 12 ORDER BY created_at, id LIMIT 3 OFFSET 2")
def _(l):
    return reads.page_of_steps(l["workflow_steps"], l["workflow_runs"], 12, limit=3, offset=2).select("id", "step_key")


@query("q20_count_steps", "workflow_runs workflow_steps", "SELECT r.id, count(s.id) AS n FROM workflow_runs r LEFT JOIN workflow_steps s ON s.workflow_run_id = r.id WHERE r.organization_id = 3 GROUP BY r.id")
def _(l):
    return reads.count_in_runs(l["workflow_steps"], l["workflow_runs"], Scope.of(3))


@query("q21_page_of_dependencies", "workflow_runs workflow_step_dependencies", "SELECT prerequisite_step_id, dependent_step_id FROM workflow_step_dependencies WHERE workflow_run_id = 12 ORDER BY 1, 2 LIMIT 4 OFFSET 3")
def _(l):
    return reads.page_of_dependencies(l["workflow_step_dependencies"], l["workflow_runs"], 12, limit=4, offset=3).select("prerequisite_step_id", "dependent_step_id")


@query("q21_count_dependencies", "workflow_runs workflow_step_dependencies", "SELECT r.id, count(e.workflow_run_id) AS n FROM workflow_runs r LEFT JOIN workflow_step_dependencies e ON e.workflow_run_id = r.id GROUP BY r.id")
def _(l):
    return reads.count_in_runs(l["workflow_step_dependencies"], l["workflow_runs"])


@query("q24_job_detail", "job_queue job_attempts job_events job_dead_letters", """
    SELECT q.id, q.status, coalesce(a.n, 0) AS job_attempts, coalesce(e.n, 0) AS job_events, coalesce(d.n, 0) AS job_dead_letters, coalesce(e.last, '-') AS last_event FROM job_queue q
    LEFT JOIN (SELECT job_id, count(*) AS n FROM job_attempts GROUP BY 1) a ON a.job_id = q.id LEFT JOIN (SELECT job_id, count(*) AS n, arg_max(event_type, (occurred_at, id)) AS last FROM job_events GROUP BY 1) e ON e.job_id = q.id
    LEFT JOIN (SELECT job_id, count(*) AS n FROM job_dead_letters GROUP BY 1) d ON d.job_id = q.id""")
def _(l):
    return reads.job_detail(l)


@query("j11_passed_over", "job_queue job_execution_resource_claims", "SELECT q.id, c.job_id AS holder FROM job_queue q JOIN job_execution_resource_claims c ON c.resource_key = q.execution_resource_key WHERE q.status = 'PENDING' AND c.job_id <> q.id")
def _(l):
    return claims.not_acquired(l["job_queue"].where("status = 'PENDING'"), l["job_execution_resource_claims"]).select("id", "holder")


@query("j15_quiesced", "job_queue", f"SELECT id FROM job_queue WHERE status = 'CANCELED' AND (lease_expires_at IS NULL OR lease_expires_at < {NOW})")
def _(l):
    return claims.quiesced(l["job_queue"], AS_OF).select("id")


@query("j16_broken_links", "workflow_steps job_queue", "SELECT id, 'NO_JOB' AS fault FROM workflow_steps WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT id FROM job_queue WHERE status <> 'CANCELED') UNION ALL SELECT job_id, 'SEVERAL_STEPS' FROM workflow_steps WHERE job_id IS NOT NULL GROUP BY job_id HAVING count(*) > 1")
def _(l):
    return integrity.broken_job_links(l["workflow_steps"], l["job_queue"].where("status <> 'CANCELED'"))


@query("a11_all_there", "job_definitions", "SELECT count(DISTINCT job_type) = 2 AS all_there FROM job_definitions WHERE job_type IN ('jobs.p1', 'jobs.p2')")
def _(l):
    return integrity.all_there(l["job_definitions"], "job_type", ["jobs.p1", "jobs.p2"])


@query("x21_defer_poisoned", "job_queue", f"SELECT id, status, CASE WHEN status = 'LEASED' AND lease_expires_at < {NOW} AND id % 2 = 0 THEN {NOW} + INTERVAL '30' SECOND ELSE lease_expires_at END AS lease_expires_at FROM job_queue WHERE lease_expires_at IS NOT NULL")
def _(l):
    errors = l["job_queue"].where("id % 2 = 0").select("id", F.lit("bad row").alias("error"))
    after = lifecycle.defer_poisoned(l["job_queue"], errors, AS_OF).apply({"job_queue": l["job_queue"]})
    return after["job_queue"].where("lease_expires_at IS NOT NULL").select("id", "status", "lease_expires_at")


@query("x25_patch_step_and_job", "workflow_steps job_queue", """
    WITH o AS (SELECT s.id, s.job_id, s.payload, CASE WHEN q.id IS NULL THEN 'NO_JOB' WHEN q.status <> 'PENDING' THEN 'NOT_PENDING' WHEN q.attempt > 0 THEN 'ALREADY_CLAIMED' ELSE 'UPDATED' END AS outcome FROM workflow_steps s LEFT JOIN job_queue q ON q.id = s.job_id)
    SELECT 'outcome' AS tbl, id, outcome AS v FROM o UNION ALL SELECT 'step', id, CASE WHEN outcome = 'UPDATED' THEN '{}' ELSE payload END FROM o
    UNION ALL SELECT 'job', q.id, CASE WHEN o.outcome = 'UPDATED' THEN '{}' ELSE q.payload END FROM job_queue q LEFT JOIN o ON o.job_id = q.id""")
def _(l):
    change = lifecycle.patch_step_and_job(l["workflow_steps"], l["job_queue"], l["workflow_steps"].select("id", F.lit("{}").alias("new_payload")))
    after = change.apply({"workflow_steps": l["workflow_steps"], "job_queue": l["job_queue"]})
    row = lambda frame, name, value: frame.select(F.lit(name).alias("tbl"), "id", F.col(value).alias("v"))
    return row(change.outcomes, "outcome", "outcome").unionByName(row(after["workflow_steps"], "step", "payload")).unionByName(row(after["job_queue"], "job", "payload"))


@query("x26_add_logs", "job_queue job_logs", "SELECT level, count(*) AS entries FROM (SELECT level FROM job_logs UNION ALL SELECT 'error' FROM job_queue WHERE status = 'DEAD_LETTERED') GROUP BY level")
def _(l):
    entries = l["job_queue"].where("status = 'DEAD_LETTERED'").select((F.col("id") + 1_000_000_000).alias("id"), F.col("id").alias("job_id"), F.lit("error").alias("level"), F.lit("gave up").alias("message"))
    unknown = l.spark.sql("SELECT -1L, -1L, 'error', 'no such job'")
    return lifecycle.add_logs(l["job_queue"], entries.union(unknown)).apply({"job_logs": l["job_logs"]})["job_logs"].groupBy("level").agg(F.count(F.lit(1)).alias("entries"))


@query("x27_upsert_definitions", "job_definitions", f"""
    SELECT job_type, CASE WHEN job_type = 'jobs.p1' THEN 11 ELSE max_attempts END AS max_attempts, is_enabled, CASE WHEN job_type = 'jobs.p1' THEN {NOW} ELSE created_at END AS created_at FROM job_definitions
    UNION ALL SELECT 'jobs.new', 4, true, {NOW}""")
def _(l):
    from jobloom.functions.predicates import instant
    from jobloom.operators.changes import upsert_if_changed

    base = l["job_definitions"].select("job_type", "max_attempts", "is_enabled", "created_at")
    same = base.where("job_type = 'jobs.p2'")
    changed = base.where("job_type = 'jobs.p1'").withColumn("max_attempts", F.lit(11)).unionByName(l.spark.sql("SELECT 'jobs.new' AS job_type, 4 AS max_attempts, true AS is_enabled, CAST(NULL AS TIMESTAMP_NTZ) AS created_at"))
    return upsert_if_changed(base, same.unionByName(changed), ["job_type"], ["max_attempts", "is_enabled"], ("created_at", instant(AS_OF)))


@query("h1_sync_schedules", "job_schedules", """
    SELECT id, name, CASE WHEN id % 2 = 0 THEN '0 0 * * * *' ELSE cron_expr END AS cron_expr, is_active, CASE WHEN id % 2 = 0 AND cron_expr <> '0 0 * * * *' THEN CAST('2024-03-01 00:00:00' AS TIMESTAMP) ELSE next_fire_at END AS next_fire_at FROM job_schedules
    UNION ALL SELECT -1, 'new', '0 0 * * * *', true, CAST('2024-03-01 00:00:00' AS TIMESTAMP)""")
def _(l):
    from jobloom.functions.predicates import instant

    base = l["job_schedules"].select("id", "name", "cron_expr", "is_active", "next_fire_at")
    fire = {"next_fire_at": instant("2024-03-01 00:00:00"), "is_active": F.lit(True)}
    catalogue = base.where("id % 2 = 0").withColumns({"cron_expr": F.lit("0 0 * * * *"), **fire}).unionByName(base.where("id % 2 = 1").withColumns(fire)).unionByName(l.spark.sql("SELECT -1L AS id, 'new' AS name, '0 0 * * * *' AS cron_expr").withColumns(fire))
    return schedules.sync(base, catalogue)


@query("h2_set_schedules", "job_schedules", "SELECT id, CASE WHEN id % 3 = 0 THEN false ELSE is_active END AS is_active, CASE WHEN id % 5 = 0 THEN NULL ELSE next_fire_at END AS next_fire_at FROM job_schedules")
def _(l):
    table = l["job_schedules"]
    off = schedules.set_active(table, table.where("id % 3 = 0").select("name", F.lit(False).alias("is_active")))
    return schedules.set_next_fire(off, table.where("id % 5 = 0").select("name", F.lit(None).cast("timestamp_ntz").alias("next_fire_at"))).select("id", "is_active", "next_fire_at")


@query("h10_runtime_configs", "job_runtime_configs", "SELECT job_type, CASE WHEN job_type = 'jobs.p1' THEN 7 ELSE schema_version END AS schema_version FROM job_runtime_configs UNION ALL SELECT 'jobs.new', 1")
def _(l):
    from jobloom.operators.changes import KEYS, upsert

    base = l["job_runtime_configs"].select("job_type", "schema_version")
    return upsert(base, l.spark.sql("SELECT 'jobs.p1' AS job_type, 7 AS schema_version UNION ALL SELECT 'jobs.new', 1"), KEYS["job_runtime_configs"])


# ---------------------------------------------------------------- a ledger that lasts

@query("snk_merge", "job_queue job_attempts job_execution_resource_claims job_dead_letters job_events", f"""
    WITH ran AS (SELECT DISTINCT job_id, run_number, attempt FROM job_events WHERE event_type = 'STAGE_CHANGED' AND stage = 'running'),
    s AS (SELECT q.*, a.claim_origin = 'PRESTART' AND a.execution_started_persisted_at IS NULL AND r.job_id IS NULL AS unstarted FROM job_queue q
        LEFT JOIN job_attempts a ON a.job_id = q.id AND a.run_number = q.run_number AND a.attempt = q.attempt LEFT JOIN ran r ON r.job_id = q.id AND r.run_number = q.run_number AND r.attempt = q.attempt),
    t AS (SELECT *, CASE WHEN status = 'PENDING' THEN 'cancel' WHEN status = 'LEASED' AND lease_expires_at > {NOW} THEN CASE WHEN worker_id = 'worker-1' THEN 'succeed' WHEN id % 3 = 0 OR attempt >= max_attempts THEN 'die' ELSE 'retry' END
        WHEN status = 'LEASED' AND lease_expires_at < {NOW} THEN CASE WHEN coalesce(unstarted, false) THEN 'release' WHEN attempt >= max_attempts THEN 'expire' ELSE 'again' END ELSE 'stay' END AS act FROM s),
    u AS (SELECT *, CASE act WHEN 'cancel' THEN 'CANCELED' WHEN 'succeed' THEN 'SUCCEEDED' WHEN 'die' THEN 'DEAD_LETTERED' WHEN 'expire' THEN 'DEAD_LETTERED' WHEN 'stay' THEN status ELSE 'PENDING' END AS new_status,
        CASE WHEN act = 'release' THEN attempt - 1 ELSE attempt END AS new_attempt, CASE WHEN act IN ('stay') THEN worker_id END AS new_worker,
        CASE act WHEN 'succeed' THEN 'completed' WHEN 'die' THEN 'completed' WHEN 'retry' THEN 'queued' ELSE stage END AS new_stage, CASE WHEN act IN ('stay', 'cancel') THEN lease_expires_at END AS new_lease,
        CASE act WHEN 'retry' THEN {NOW} + greatest(1000, least(5000 * CAST(pow(2, least(greatest(attempt, 1), 10)) AS BIGINT), 300000) + id % 1000 - 500) * INTERVAL '1' MILLISECOND WHEN 'again' THEN {NOW} + INTERVAL '30' SECOND ELSE next_run_at END AS new_next,
        act NOT IN ('stay', 'cancel') AS ended FROM t)
    SELECT 'job_queue' AS tbl, CAST(id AS VARCHAR) AS k, concat_ws('|', new_status, CAST(run_number AS VARCHAR), CAST(new_attempt AS VARCHAR), coalesce(new_worker, '-'), coalesce(new_stage, '-'), coalesce(CAST(new_lease AS VARCHAR), '-'), coalesce(CAST(new_next AS VARCHAR), '-')) AS v FROM u
    UNION ALL SELECT 'job_attempts', concat_ws(':', a.job_id, a.run_number, a.attempt), concat_ws('|', coalesce(a.worker_id, '-'), coalesce(CAST(a.started_at AS VARCHAR), '-'),
            coalesce(CAST(CASE WHEN ended THEN {NOW} ELSE a.finished_at END AS VARCHAR), '-'), coalesce(CASE act WHEN 'succeed' THEN NULL WHEN 'die' THEN CASE WHEN u.id % 3 = 0 THEN 'TERMINAL' ELSE 'RETRYABLE' END WHEN 'retry' THEN 'RETRYABLE' WHEN 'again' THEN 'LEASE_EXPIRED' WHEN 'expire' THEN 'LEASE_EXPIRED' ELSE a.outcome END, '-'))
        FROM job_attempts a LEFT JOIN u ON u.id = a.job_id AND u.run_number = a.run_number AND u.attempt = a.attempt WHERE coalesce(act, 'stay') <> 'release'
    UNION ALL SELECT 'job_execution_resource_claims', c.resource_key, concat_ws('|', CAST(c.job_id AS VARCHAR), CAST(c.lease_expires_at AS VARCHAR)) FROM job_execution_resource_claims c LEFT JOIN u ON u.id = c.job_id AND u.execution_resource_key = c.resource_key WHERE NOT coalesce(ended, false)
    UNION ALL SELECT 'job_dead_letters', concat_ws(':', job_id, run_number), concat_ws('|', attempt, error_code) FROM job_dead_letters
    UNION ALL SELECT 'job_dead_letters', concat_ws(':', id, run_number), concat_ws('|', attempt, CASE act WHEN 'die' THEN 'e' ELSE 'job.lease_expired' END) FROM u WHERE act IN ('die', 'expire')
    UNION ALL SELECT 'job_events', event_type, CAST(count(*) AS VARCHAR) FROM (SELECT event_type FROM job_events UNION ALL SELECT unnest(CASE act WHEN 'cancel' THEN ['CANCELED'] WHEN 'succeed' THEN ['SUCCEEDED'] WHEN 'die' THEN ['FAILED', 'DEAD_LETTERED'] WHEN 'retry' THEN ['FAILED', 'RETRY_SCHEDULED']
        WHEN 'again' THEN ['LEASE_EXPIRED', 'RETRY_SCHEDULED'] WHEN 'expire' THEN ['LEASE_EXPIRED', 'DEAD_LETTERED'] ELSE [] END) FROM u) GROUP BY event_type""")
def _(l):
    """Four batches written to a ledger that lasts, one of them twice, each decided from the snapshot before it."""
    store = LedgerStore(l.spark, shared_path(l.spark, "ledger"))
    store.create(_touched(l), buckets=8)
    fence = lambda now, condition: by_key(_fence(now, condition))  # noqa: E731  as many commands as the ledger has such jobs
    kind = {"kind": F.when(F.col("id") % 3 == 0, "TERMINAL").otherwise("RETRYABLE"), "error_code": F.lit("e"), "not_before": F.lit(None).cast("timestamp_ntz")}
    batches = [
        (1, lambda now: lifecycle.cancel(now["job_queue"], by_key(now["job_queue"].where("status = 'PENDING'").select("id")), AS_OF)),
        (2, lambda now: lifecycle.succeed(now["job_queue"], fence(now, "worker_id = 'worker-1'"), AS_OF)),
        (3, lambda now: lifecycle.fail(now["job_queue"], fence(now, "worker_id <> 'worker-1'").withColumns(kind), AS_OF)),
        (3, lambda now: lifecycle.cancel(now["job_queue"], by_key(now["job_queue"].select("id")), AS_OF)),  # this number is there: nothing happens
        (4, lambda now: lifecycle.reap(now["job_queue"], now["job_attempts"], now["job_events"], AS_OF, None)),
    ]
    for number, decide in batches:
        store.apply(number, decide(store.read()))
    return _snapshot(store.read())


def _finishing(base: str, into: str, place: int, prefix: str, waves: int = 11) -> str:
    """Steps of one place finish as the ledger has it; waves settle the others."""
    sql = f"""{into}0 AS MATERIALIZED (SELECT b.id, b.workflow_run_id, b.execution_kind, CASE WHEN b.status IN ('ENQUEUED', 'WAITING_FOR_EXTERNAL') AND s.step_key = 'step-{place}' AND s.status IN ('SUCCEEDED', 'FAILED', 'CANCELED') THEN s.status ELSE b.status END AS status FROM {base} b JOIN workflow_steps s USING (id))"""
    for k in range(1, waves + 1):
        sql += f""", {prefix}{k} AS (SELECT e.dependent_step_id AS id, count(*) FILTER (WHERE s.status NOT IN ('SUCCEEDED', 'FAILED', 'CANCELED')) AS pending, count(*) FILTER (WHERE s.status IN ('FAILED', 'CANCELED') AND e.release_mode = 'ON_SUCCESS') AS unsatisfied
                FROM workflow_step_dependencies e JOIN {into}{k - 1} s ON s.id = e.prerequisite_step_id GROUP BY 1),
            {into}{k} AS MATERIALIZED (SELECT w.id, workflow_run_id, execution_kind, CASE WHEN status <> 'BLOCKED' OR coalesce(pending, 0) > 0 THEN status WHEN coalesce(unsatisfied, 0) > 0 THEN 'CANCELED' WHEN execution_kind = 'EXTERNAL' THEN 'WAITING_FOR_EXTERNAL' ELSE 'ENQUEUED' END AS status FROM {into}{k - 1} w LEFT JOIN {prefix}{k} USING (id))"""
    return sql


@query("d9_incremental", "workflow_steps workflow_step_dependencies", f"""
    WITH fresh AS (SELECT id, workflow_run_id, execution_kind, CASE WHEN id IN (SELECT dependent_step_id FROM workflow_step_dependencies) THEN 'BLOCKED' WHEN execution_kind = 'EXTERNAL' THEN 'WAITING_FOR_EXTERNAL' ELSE 'ENQUEUED' END AS status FROM workflow_steps),
    {_finishing("fresh", "a", 0, "ap")}, {_finishing("a11", "b", 1, "bp")}, {_finishing("b11", "c", 2, "cp")},
    n AS (SELECT e.dependent_step_id AS id, count(*) FILTER (WHERE s.status NOT IN ('SUCCEEDED', 'FAILED', 'CANCELED')) AS pending, count(*) FILTER (WHERE s.status IN ('FAILED', 'CANCELED') AND e.release_mode = 'ON_SUCCESS') AS unsatisfied
        FROM workflow_step_dependencies e JOIN c11 s ON s.id = e.prerequisite_step_id GROUP BY 1)
    SELECT 'step' AS tbl, id, status || '|' || CAST(coalesce(pending, 0) AS VARCHAR) || '|' || CAST(coalesce(unsatisfied, 0) AS VARCHAR) AS v FROM c11 LEFT JOIN n USING (id)
    UNION ALL SELECT 'run', workflow_run_id, CASE WHEN bool_or(status IN ('ENQUEUED', 'RUNNING', 'BLOCKED')) THEN 'RUNNING' WHEN bool_or(status = 'WAITING_FOR_EXTERNAL') THEN 'WAITING_FOR_EXTERNAL'
        WHEN bool_or(status IN ('FAILED', 'CANCELED')) THEN 'COMPLETED_WITH_ERRORS' ELSE 'SUCCEEDED' END FROM c11 GROUP BY 2""")
def _(l):
    """All graphs begun anew in a ledger that lasts; then, place by place, steps that are ready finish as the ledger has it, once more each."""
    total = l["workflow_step_dependencies"].groupBy(F.col("dependent_step_id").alias("id")).agg(F.count(F.lit(1)).alias("pending"))
    status = F.when(F.col("pending") > 0, "BLOCKED").when(F.col("execution_kind") == "EXTERNAL", "WAITING_FOR_EXTERNAL").otherwise("ENQUEUED")
    fresh = l["workflow_steps"].drop("status", "job_id").join(total, "id", "left").withColumns({"pending": F.coalesce("pending", F.lit(0).cast("long")), "unsatisfied": F.lit(0).cast("long"), "job_id": F.lit(None).cast("long")}).withColumn("status", status)
    store = LedgerStore(l.spark, shared_path(l.spark, "ledger"))
    runs = l["workflow_runs"].withColumn("status", F.lit("RUNNING"))
    begun = workflow.run_status(fresh, runs).select("id", "status")
    store.create({"workflow_steps": fresh, "workflow_step_dependencies": l["workflow_step_dependencies"], "workflow_runs": runs.drop("status").join(begun, "id"), "job_definitions": l["job_definitions"], "job_queue": l["job_queue"].where("false"), "job_events": l["job_events"].where("false")}, buckets=8)
    for place in range(3):
        ends = l["workflow_steps"].where((F.col("step_key") == f"step-{place}") & F.col("status").isin(*workflow.TERMINAL)).select("id", "status")
        store.apply(place + 1, workflow_writes.finish_steps(store.read(), ends.unionByName(ends), AS_OF, 3_000_000))
    after = store.read()
    text = F.concat_ws("|", "status", F.col("pending").cast("string"), F.col("unsatisfied").cast("string"))
    return after["workflow_steps"].select(F.lit("step").alias("tbl"), "id", text.alias("v")).unionByName(after["workflow_runs"].select(F.lit("run").alias("tbl"), "id", F.col("status").alias("v")))


@query("d15_recover", "workflow_runs workflow_steps workflow_step_dependencies job_definitions", """
    WITH s AS (SELECT *, CAST(id % 10 AS INT) AS place, CASE WHEN execution_kind = 'JOB' THEN CASE WHEN workflow_run_id % 17 = 0 THEN 'jobs.p4' ELSE 'jobs.p' || CAST(1 + id % 10 % 3 AS VARCHAR) END END AS kind FROM workflow_steps),
    r AS (SELECT *, EXISTS (SELECT 1 FROM s WHERE s.workflow_run_id = r.id AND kind = 'jobs.p4') AS unknown FROM workflow_runs r),
    c AS (SELECT id, 10 * id + n AS ordinal, n, CASE WHEN n = 2 THEN 'other' ELSE 'why' END AS reason, CASE WHEN n = 3 THEN -1 ELSE organization_id END AS asked_by FROM r, (VALUES (0), (1), (2), (3)) AS t(n) UNION ALL SELECT -1, -5, 0, 'why', NULL),
    o AS (SELECT c.ordinal, c.id, c.n, CASE WHEN r.id IS NULL OR c.asked_by IS DISTINCT FROM r.organization_id THEN 'NOT_FOUND' WHEN r.status NOT IN ('SUCCEEDED', 'COMPLETED_WITH_ERRORS', 'CANCELED') THEN 'NOT_TERMINAL' WHEN r.id % 7 = 3 THEN 'SNAPSHOT_MISSING'
        WHEN r.id % 7 = 4 THEN 'UNSAFE_SNAPSHOT' WHEN unknown THEN 'NO_ENABLED_DEFINITION' WHEN n = 0 THEN 'INSERTED' WHEN n = 1 THEN 'EXISTING' ELSE 'CONFLICT' END AS outcome FROM c LEFT JOIN r ON r.id = c.id),
    new AS (SELECT o.ordinal, s.*, (SELECT count(*) FROM workflow_step_dependencies e WHERE e.dependent_step_id = s.id) AS total FROM s JOIN o ON o.id = s.workflow_run_id AND outcome = 'INSERTED'),
    born AS (SELECT *, CASE WHEN total > 0 THEN 'BLOCKED' WHEN execution_kind = 'EXTERNAL' THEN 'WAITING_FOR_EXTERNAL' ELSE 'ENQUEUED' END AS now FROM new)
    SELECT 'outcome' AS tbl, CAST(ordinal AS VARCHAR) AS k, outcome || '|' || CASE WHEN outcome = 'INSERTED' THEN CAST(1000000 + ordinal AS VARCHAR) WHEN outcome = 'EXISTING' THEN CAST(1000000 + ordinal - 1 AS VARCHAR) ELSE '-' END AS v FROM o
    UNION ALL SELECT 'run', CAST(1000000 + ordinal AS VARCHAR), any_value(r.workflow_type) || '|' || coalesce(CAST(any_value(r.organization_id) AS VARCHAR), '-') || '|' || CASE WHEN bool_or(now IN ('BLOCKED', 'ENQUEUED')) THEN 'RUNNING' ELSE 'WAITING_FOR_EXTERNAL' END FROM born JOIN r ON r.id = workflow_run_id GROUP BY ordinal
    UNION ALL SELECT 'step', CAST(1000000 + ordinal AS VARCHAR) || '.' || step_key, now || '|' || CAST(total AS VARCHAR) || '|' || coalesce(kind, '-') || '|' || '{"late":' || CAST(place AS VARCHAR) || '}' FROM born
    UNION ALL SELECT 'edge', CAST(1000000 + ordinal AS VARCHAR) || '.' || d.step_key || '.' || p.step_key, release_mode FROM workflow_step_dependencies e JOIN o ON o.id = e.workflow_run_id AND outcome = 'INSERTED' JOIN s d ON d.id = e.dependent_step_id JOIN s p ON p.id = e.prerequisite_step_id
    UNION ALL SELECT 'job', CAST(1000000 + ordinal AS VARCHAR) || '.' || step_key, kind || '|' || CAST(default_priority AS VARCHAR) || '|' || CAST(max_attempts AS VARCHAR) || '|{"late":' || CAST(place AS VARCHAR) || '}' FROM born JOIN job_definitions d ON d.job_type = kind WHERE now = 'ENQUEUED'
    UNION ALL SELECT 'lineage', CAST(1000000 + ordinal AS VARCHAR), CAST(id AS VARCHAR) || '|k|FULL|why' FROM o WHERE outcome = 'INSERTED'""")
def _(l):
    """Every run asked for four times: once, again, with another reason, and by a stranger. Steps from the eighth place on were appended; payloads were changed since; some requests are gone or of an unknown form."""
    _, steps, edges = _declared(l)
    late = lambda key: F.substring(key, -1, 1).cast("int") >= 7
    first = workflow_writes.declared(steps.where(~late("step_key")), edges.where(~late("dependent_key"))).select(F.col("ordinal").alias("id"), "request")
    more = workflow_writes.declared(steps.where(late("step_key")), edges.where(late("dependent_key"))).select(F.col("ordinal").alias("workflow_run_id"), F.lit(1).cast("long").alias("id"), F.lit("APPEND_STEPS").alias("mutation_kind"), "request")
    request = F.when(F.col("id") % 7 == 3, None).when(F.col("id") % 7 == 4, F.concat(F.lit('{"from":"elsewhere",'), F.substring("request", 2, 1 << 30))).otherwise(F.col("request"))
    runs = l["workflow_runs"].drop("enqueue_request").join(by_key(first), "id").withColumn("enqueue_request", request).drop("request")
    own = l["workflow_steps"].drop("payload").withColumn("payload", F.concat(F.lit('{"late":'), (F.col("id") % 10).cast("string"), F.lit("}")))
    ledger = {"workflow_runs": runs, "workflow_steps": own, "job_definitions": l["job_definitions"], "workflow_run_mutations": more, "workflow_recoveries": l.spark.createDataFrame([], "recovery_run_id long, source_run_id long, source_step_id long, request_key string, mode string, reason string")}
    n = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")
    asked = l["workflow_runs"].select(F.col("id").alias("source_run_id"), "organization_id", n).select(
        (10 * F.col("source_run_id") + F.col("n")).alias("ordinal"), "source_run_id", F.when(F.col("n") == 3, -1).otherwise(F.col("organization_id")).alias("organization_id"), F.lit(None).cast("long").alias("source_step_id"),
        F.lit("k").alias("request_key"), F.lit("FULL").alias("mode"), F.when(F.col("n") == 2, "other").otherwise("why").alias("reason"))
    stranger = l.spark.sql("SELECT -5L AS ordinal, -1L AS source_run_id, CAST(NULL AS BIGINT) AS organization_id, CAST(NULL AS BIGINT) AS source_step_id, 'k' AS request_key, 'FULL' AS mode, 'why' AS reason")
    change = recovery.recover(ledger, asked.unionByName(stranger), AS_OF, 1_000_000, 1_000_000_000, 3_000_000)
    made = change.upserts
    text = lambda *columns: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    row = lambda frame, name, key, value: frame.select(F.lit(name).alias("tbl"), key.cast("string").alias("k"), value.alias("v"))
    new = stored(made["workflow_steps"])
    at = lambda side: new.select(F.col("id").alias(f"{side}_step_id"), F.col("step_key").alias(side))
    named = new.select((F.lit(3_000_000) + F.col("id")).alias("id"), F.concat_ws(".", F.col("workflow_run_id").cast("string"), "step_key").alias("at"))
    linked = made["workflow_step_dependencies"].join(by_key(at("dependent")), "dependent_step_id").join(by_key(at("prerequisite")), "prerequisite_step_id")
    return (
        row(change.outcomes, "outcome", F.col("ordinal"), text("outcome", "run_id")).unionByName(row(made["workflow_runs"], "run", F.col("id"), text("workflow_type", "organization_id", "status")))
        .unionByName(row(new, "step", F.concat_ws(".", F.col("workflow_run_id").cast("string"), "step_key"), text("status", "total", "job_type", "payload")))
        .unionByName(row(linked, "edge", F.concat_ws(".", F.col("workflow_run_id").cast("string"), "dependent", "prerequisite"), F.col("release_mode")))
        .unionByName(row(made["job_queue"].join(by_key(named), "id"), "job", F.col("at"), text("job_type", "priority", "max_attempts", "payload")))
        .unionByName(row(change.appends["workflow_recoveries"], "lineage", F.col("recovery_run_id"), text("source_run_id", "request_key", "mode", "reason")))
    )


# ---------------------------------------------------------------- layouts

@query("q7_page_by_layout", "job_queue", "SELECT id, job_type, status, created_at FROM job_queue WHERE status <> 'PENDING' AND (created_at, id) < (CAST('2024-01-12 00:00:00' AS TIMESTAMP), 700) ORDER BY created_at DESC, id DESC LIMIT 500")
def _(l):
    """A page far down a table that is laid out in the order of its pages."""
    path = shared_path(l.spark, "pages")
    clustered.write(l["job_queue"], path, slice_rows=4096)
    return clustered.page(l.spark, path, F.col("status") != "PENDING", ("2024-01-12 00:00:00", 700), 500).select("id", "job_type", "status", "created_at")


@query("q24_keyed_detail")
def _(l):
    """Job details over tables in buckets by job: no exchange."""
    name = f"keyed_{uuid.uuid4().hex}"
    keyed.write_keyed(l, l.spark, name, buckets=8)
    return reads.job_detail(keyed.read_keyed(l.spark, name))


_ORACLES["q24_keyed_detail"] = _ORACLES["q24_job_detail"]


@query("a3_exact_percentiles", "job_attempts job_queue", """
    SELECT kind, CAST(round(quantile_cont(ms, 0.5), 3) AS DOUBLE) AS p50, CAST(round(quantile_cont(ms, 0.95), 3) AS DOUBLE) AS p95, CAST(round(quantile_cont(ms, 0.999), 3) AS DOUBLE) AS p999
    FROM (SELECT unnest([CASE WHEN a.attempt < 3 THEN 'early' ELSE coalesce(CAST(q.organization_id AS VARCHAR), '-') END, 'all']) AS kind, (epoch_us(finished_at) - epoch_us(q.created_at)) / 1000.0::DOUBLE AS ms FROM job_attempts a JOIN job_queue q ON q.id = a.job_id WHERE finished_at IS NOT NULL) GROUP BY kind""")
def _(l):
    """How long after their job's creation attempts ended; one group has all of them."""
    joined = l["job_attempts"].where("finished_at IS NOT NULL").join(l["job_queue"].select(F.col("id").alias("job_id"), "organization_id", F.col("created_at").alias("begun")), "job_id")
    kind = F.when(F.col("attempt") < 3, "early").otherwise(F.coalesce(F.col("organization_id").cast("string"), F.lit("-")))
    rows = joined.select(F.explode(F.array(kind, F.lit("all"))).alias("kind"), (F.expr("timestampdiff(MICROSECOND, begun, finished_at)") / 1000.0).alias("ms"))
    found = exact_percentiles(rows, ["kind"], "ms", {"p50": 0.5, "p95": 0.95, "p999": 0.999})
    return found.select("kind", *(F.round(c, 3).alias(c) for c in ("p50", "p95", "p999")))


# ---------------------------------------------------------------- lineage, arrays, cancellations, starts

@query("j18_lineage", "job_queue", """
    WITH r AS (SELECT q.id AS replay_job_id, s.id AS source_job_id, s.run_number, s.organization_id, q.status, q.run_number AS replay_run FROM job_queue s JOIN job_queue q ON q.id = s.id + 1 WHERE s.status = 'SUCCEEDED')
    SELECT source_job_id AS ordinal, replay_job_id, 'why' AS replay_reason, CASE WHEN source_job_id % 4 <> 0 THEN status END AS replay_status, CASE WHEN source_job_id % 4 <> 0 THEN replay_run END AS replay_run_number FROM r WHERE source_job_id % 5 <> 0""")
def _(l):
    """Each succeeded job's replay (the job after it), asked for by every job: some with another reason, some for another organization."""
    jobs = l["job_queue"]
    source = jobs.where("status = 'SUCCEEDED'").select(F.col("id").alias("source_job_id"), F.col("run_number").alias("source_run_number"), (F.col("id") + 1).alias("replay_job_id"))
    replays = source.join(jobs.select(F.col("id").alias("replay_job_id")), "replay_job_id").withColumns({"replay_request_key": F.lit("k"), "reason": F.lit("why")})
    reason = F.when(F.col("id") % 4 == 0, "other").otherwise("why").alias("reason")
    asked = jobs.select(F.col("id").alias("ordinal"), F.col("id").alias("source_job_id"), F.col("run_number").alias("source_run_number"), F.lit("k").alias("replay_request_key"), F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("organization_id")).alias("organization_id"), reason)
    return reads.replay_lineage(jobs, replays, asked)


@query("src4_parallel_arrays", "workflow_steps workflow_step_dependencies", """
    SELECT e.dependent_step_id AS id, count(*) AS ended, count(*) FILTER (WHERE e.release_mode = 'ON_SUCCESS' AND s.status <> 'SUCCEEDED') AS unsatisfied
    FROM workflow_step_dependencies e JOIN workflow_steps s ON s.id = e.prerequisite_step_id WHERE s.status IN ('SUCCEEDED', 'FAILED', 'CANCELED') GROUP BY 1""")
def _(l):
    """Updates of dependents, sent as two arrays side by side for each step that is over."""
    over = l["workflow_steps"].where(F.col("status").isin(*workflow.TERMINAL)).select(F.col("id").alias("prerequisite_step_id"), "status")
    flagged = l["workflow_step_dependencies"].join(over, "prerequisite_step_id").withColumn("fails", (F.col("release_mode") == "ON_SUCCESS") & (F.col("status") != "SUCCEEDED"))
    sent = flagged.groupBy("prerequisite_step_id").agg(F.collect_list(F.struct("dependent_step_id", "fails")).alias("u")).select("prerequisite_step_id", F.col("u.dependent_step_id").alias("ids"), F.col("u.fails").alias("flags"))
    return changes.rows_from_arrays(sent, [], {"ids": "id", "flags": "fails"}).groupBy("id").agg(F.count(F.lit(1)).alias("ended"), F.count_if("fails").alias("unsatisfied"))


@query("d14_cancel_changes", "workflow_runs workflow_steps job_queue job_execution_resource_claims", f"""
    WITH hit AS (SELECT id FROM workflow_runs WHERE status NOT IN ('SUCCEEDED', 'COMPLETED_WITH_ERRORS', 'CANCELED')),
    s AS (SELECT w.*, q.status AS job_status, w.workflow_run_id IN (SELECT id FROM hit) AND w.status NOT IN ('SUCCEEDED', 'FAILED', 'CANCELED') AS hit FROM workflow_steps w LEFT JOIN job_queue q ON q.id = w.job_id),
    j AS (SELECT q.*, q.status IN ('PENDING', 'LEASED') AND q.id IN (SELECT job_id FROM s WHERE hit AND job_id IS NOT NULL) AS hit FROM job_queue q)
    SELECT 'outcome' AS tbl, CAST(id AS VARCHAR) AS k, CASE WHEN id IN (SELECT id FROM hit) THEN 'CANCELED' ELSE 'ALREADY_OVER' END AS v FROM workflow_runs UNION ALL SELECT 'outcome', '-1', 'NOT_FOUND'
    UNION ALL SELECT 'run', CAST(id AS VARCHAR), CASE WHEN id IN (SELECT id FROM hit) THEN 'CANCELED' ELSE status END FROM workflow_runs
    UNION ALL SELECT 'step', CAST(id AS VARCHAR), CASE WHEN hit THEN CASE job_status WHEN 'SUCCEEDED' THEN 'SUCCEEDED' WHEN 'DEAD_LETTERED' THEN 'FAILED' ELSE 'CANCELED' END ELSE status END FROM s
    UNION ALL SELECT 'job', CAST(id AS VARCHAR), concat_ws('|', CASE WHEN hit THEN 'CANCELED' ELSE status END, coalesce(CASE WHEN NOT hit THEN worker_id END, '-'), coalesce(CAST(lease_expires_at AS VARCHAR), '-')) FROM j
    UNION ALL SELECT 'claim', c.resource_key, CAST(c.job_id AS VARCHAR) FROM job_execution_resource_claims c LEFT JOIN j ON j.id = c.job_id WHERE NOT coalesce(j.hit AND j.status = 'LEASED' AND j.execution_resource_key = c.resource_key AND NOT coalesce(j.lease_expires_at > {NOW}, false), false)
    UNION ALL SELECT 'events', 'CANCELED', CAST(count(*) AS VARCHAR) FROM j WHERE hit""")
def _(l):
    asked = l["workflow_runs"].select("id").unionByName(l["workflow_runs"].select("id")).unionByName(l.spark.sql("SELECT -1L AS id"))
    tables = {name: l[name] for name in ("workflow_runs", "workflow_steps", "job_queue", "job_execution_resource_claims")} | {"job_events": l["job_events"].where("false")}
    change = workflow_writes.cancel_runs(tables, asked, AS_OF)
    after = change.apply(tables)
    text = lambda *columns: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    row = lambda frame, name, key, value: frame.select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("k"), value.alias("v"))
    return (
        row(change.outcomes, "outcome", "id", F.col("outcome")).unionByName(row(after["workflow_runs"], "run", "id", F.col("status"))).unionByName(row(after["workflow_steps"], "step", "id", F.col("status")))
        .unionByName(row(after["job_queue"], "job", "id", text("status", "worker_id", "lease_expires_at"))).unionByName(row(after["job_execution_resource_claims"], "claim", "resource_key", text("job_id")))
        .unionByName(row(after["job_events"].groupBy("event_type").count(), "events", "event_type", text("count")))
    )


@query("x7_mark_running", "job_queue job_attempts", f"""
    SELECT 'job' AS tbl, CAST(id AS VARCHAR) AS k, CASE WHEN {_LIVE} THEN 'running' ELSE stage END AS v FROM job_queue
    UNION ALL SELECT 'attempt', concat_ws(':', a.job_id, a.run_number, a.attempt), coalesce(CAST(CASE WHEN a.execution_started_persisted_at IS NULL AND {_LIVE.replace("status", "q.status").replace("lease_", "q.lease_")} THEN {NOW} ELSE a.execution_started_persisted_at END AS VARCHAR), '-')
        FROM job_attempts a LEFT JOIN job_queue q ON q.id = a.job_id AND q.run_number = a.run_number AND q.attempt = a.attempt
    UNION ALL SELECT 'events', 'STAGE_CHANGED:running', CAST(count(*) AS VARCHAR) FROM job_queue WHERE {_LIVE}""")
def _(l):
    jobs = l["job_queue"].withColumn("stage", F.when(F.col("status") == "LEASED", "queued").otherwise(F.col("stage")))
    tables = {"job_queue": jobs, "job_attempts": l["job_attempts"], "job_events": l["job_events"].where("false")}
    fence = _fence(l, "true")
    after = lifecycle.mark_running(jobs, fence.unionByName(fence), AS_OF, l["job_attempts"]).apply(tables)
    stage = F.when((F.col("status") == "LEASED") & (F.col("stage") == "queued"), "running").otherwise(F.col("stage"))  # those that weren't held keep theirs
    none = F.coalesce(F.col("execution_started_persisted_at").cast("string"), F.lit("-"))
    row = lambda frame, name, key, value: frame.select(F.lit(name).alias("tbl"), key.cast("string").alias("k"), value.alias("v"))
    return (
        row(after["job_queue"], "job", F.col("id"), stage).unionByName(row(after["job_attempts"], "attempt", F.concat_ws(":", "job_id", "run_number", "attempt"), none))
        .unionByName(row(after["job_events"].groupBy("event_type", "stage").count(), "events", F.concat_ws(":", "event_type", "stage"), F.col("count").cast("string")))
    )


@query("x8_progress", "job_queue", f"""
    WITH t AS (SELECT *, coalesce({_LIVE}, false) AS held, CASE WHEN id % 3 <> 0 THEN id % 120 END AS new_done, CASE WHEN id % 4 <> 0 THEN 60 END AS new_total FROM job_queue),
    u AS (SELECT *, coalesce(new_done, progress_done) AS done, coalesce(new_total, progress_total) AS total FROM t), v AS (SELECT *, coalesce(done >= 0 AND total >= 0 AND done <= total, true) AS fits FROM u)
    SELECT 'job' AS tbl, id, concat_ws('|', coalesce(CAST(CASE WHEN held AND fits THEN done ELSE progress_done END AS VARCHAR), '-'), coalesce(CAST(CASE WHEN held AND fits THEN total ELSE progress_total END AS VARCHAR), '-')) AS v FROM v
    UNION ALL SELECT 'outcome', id, CASE WHEN fits THEN 'UPDATED' ELSE 'INVALID' END FROM v WHERE held
    UNION ALL SELECT 'events', 0, CAST(count(*) AS VARCHAR) FROM v WHERE held AND fits""")
def _(l):
    given = {"new_done": F.when(F.col("id") % 3 != 0, F.col("id") % 120), "new_total": F.when(F.col("id") % 4 != 0, F.lit(60).cast("long")), "new_stage": F.lit(None).cast("string")}
    change = lifecycle.progress(l["job_queue"], _fence(l, "true").withColumns(given), AS_OF)
    after = change.apply({"job_queue": l["job_queue"], "job_events": l["job_events"].where("false")})
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("progress_done", "progress_total")))
    row = lambda frame, name, value: frame.select(F.lit(name).alias("tbl"), "id", value.alias("v"))
    events = after["job_events"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("events").alias("tbl"), F.lit(0).cast("long").alias("id"), F.col("n").cast("string").alias("v"))
    return row(after["job_queue"], "job", text).unionByName(row(change.outcomes, "outcome", F.col("outcome"))).unionByName(events)


@query("ud5_completion", "job_queue", f"""
    WITH t AS (SELECT *, coalesce({_LIVE}, false) AS held, CASE WHEN id % 3 <> 0 THEN id % 120 END AS new_done FROM job_queue),
    v AS (SELECT *, coalesce(coalesce(new_done, progress_done) BETWEEN 0 AND progress_total, true) AS fits FROM t)
    SELECT id, CASE WHEN held AND fits THEN concat_ws('|', 'SUCCEEDED', coalesce(CAST(coalesce(new_done, progress_done) AS VARCHAR), '-'), '{{"at":' || CAST(id AS VARCHAR) || '}}') ELSE concat_ws('|', status, coalesce(CAST(progress_done AS VARCHAR), '-'), '-') END AS v,
        CASE WHEN held THEN CASE WHEN fits THEN 'COMPLETED' ELSE 'INVALID_PROGRESS' END ELSE '-' END AS outcome FROM v""")
def _(l):
    jobs = l["job_queue"].withColumn("output", F.lit(None).cast("string"))
    given = {"new_done": F.when(F.col("id") % 3 != 0, F.col("id") % 120), "new_output": F.concat(F.lit('{"at":'), F.col("id").cast("string"), F.lit("}"))}
    change = lifecycle.succeed(jobs, _fence(l, "true").withColumns(given), AS_OF)
    after = changes.upsert(jobs, change.upserts["job_queue"], ["id"]).join(change.outcomes, "id", "left")
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return after.select("id", F.concat_ws("|", "status", none("progress_done"), none("output")).alias("v"), none("outcome").alias("outcome"))


@query("d1_stuck_steps", "workflow_step_dependencies", """
    SELECT * FROM (WITH RECURSIVE e AS (SELECT workflow_run_id, prerequisite_step_id AS a, dependent_step_id AS b FROM workflow_step_dependencies UNION SELECT workflow_run_id, dependent_step_id, prerequisite_step_id FROM workflow_step_dependencies WHERE workflow_run_id % 7 = 0 AND dependent_step_id % 10 = 5),
    back AS (SELECT DISTINCT workflow_run_id, b AS id FROM e WHERE workflow_run_id % 7 = 0 AND (b, a) IN (SELECT (a, b) FROM e)),
    stuck AS (SELECT workflow_run_id, id FROM back UNION SELECT e.workflow_run_id, e.b FROM stuck s JOIN e ON e.a = s.id)
    SELECT workflow_run_id, CAST(id AS VARCHAR) AS step_key FROM stuck)""")
def _(l):
    """Every seventh run's sixth step is needed by the steps that it needs: these, and all after them, can't be placed."""
    there = l["workflow_step_dependencies"].select("workflow_run_id", F.col("prerequisite_step_id").alias("a"), F.col("dependent_step_id").alias("b"))
    back = there.where("workflow_run_id % 7 = 0 AND b % 10 = 5").select("workflow_run_id", F.col("b").alias("a"), F.col("a").alias("b"))
    edges = there.unionByName(back).select("workflow_run_id", F.col("a").cast("string").alias("prerequisite_key"), F.col("b").cast("string").alias("dependent_key"))
    return workflow.cycles(edges)


@query("x28_catalogue_sync", "job_queue job_definitions", """
    WITH c AS (SELECT DISTINCT job_type || CASE WHEN organization_id = 3 THEN '.new' ELSE '' END AS job_type FROM job_queue WHERE job_type <> 'jobs.p3'), d AS (SELECT job_type, is_enabled FROM job_definitions)
    SELECT mode, job_type, action FROM (SELECT unnest(['exact', 'additive']) AS mode, job_type, 'INSERT' AS action FROM c WHERE job_type NOT IN (SELECT job_type FROM d)
    UNION ALL SELECT 'exact', job_type, 'DISABLE' FROM d WHERE is_enabled AND job_type NOT IN (SELECT job_type FROM c) AND job_type LIKE 'jobs.p%')""")
def _(l):
    """A catalogue of the types that jobs have, some renamed."""
    named = l["job_queue"].where("job_type <> 'jobs.p3'").select(F.concat("job_type", F.when(F.col("organization_id") == 3, ".new").otherwise("")).alias("job_type"))
    scope = l["job_definitions"].where("job_type LIKE 'jobs.p%'")
    return reduce(DataFrame.unionByName, [integrity.catalogue_changes(l["job_definitions"], named, scope, exact).select(F.lit(mode).alias("mode"), "job_type", "action") for mode, exact in (("exact", True), ("additive", False))])


@query("i3_promoted", "job_enqueue_intents job_queue job_definitions", f"""
    WITH b AS (SELECT * FROM job_enqueue_intents WHERE status = 'PENDING' AND next_promotion_at <= {NOW} AND job_type IN ('jobs.p1', 'jobs.p2', 'jobs.p3', 'jobs.p5') AND job_type IN (SELECT job_type FROM job_definitions WHERE is_enabled) ORDER BY next_promotion_at, created_at, id LIMIT 24),
    m AS (SELECT b.*, q.id AS there_id, q.enqueue_request AS there, row_number() OVER w AS nth, first_value(b.id) OVER w AS lead FROM b LEFT JOIN job_queue q ON q.job_type = b.job_type AND q.organization_id IS NOT DISTINCT FROM b.organization_id AND q.idempotency_key = b.idempotency_key
        WINDOW w AS (PARTITION BY b.job_type, b.organization_id, b.idempotency_key ORDER BY b.created_at, b.id)),
    o AS (SELECT *, CASE WHEN there_id IS NOT NULL AND there IS DISTINCT FROM enqueue_request THEN 'DEFERRED' WHEN there_id IS NOT NULL OR nth > 1 THEN 'EXISTING' ELSE 'PROMOTED' END AS outcome FROM m)
    SELECT 'intent' AS tbl, id, concat_ws('|', CASE WHEN outcome = 'DEFERRED' THEN 'PENDING' ELSE 'PROMOTED' END, coalesce(CAST(CASE WHEN outcome <> 'DEFERRED' THEN coalesce(there_id, 10000000 + lead) END AS VARCHAR), '-'), CAST(promotion_attempts + 1 AS VARCHAR)) AS v FROM o
    UNION ALL SELECT 'job', 10000000 + id, concat_ws('|', o.job_type, idempotency_key, CAST(default_priority AS VARCHAR)) FROM o JOIN job_definitions d ON d.job_type = o.job_type WHERE outcome = 'PROMOTED'""")
def _(l):
    change = intents.promote(l["job_enqueue_intents"], l["job_queue"], l["job_definitions"], ["jobs.p1", "jobs.p2", "jobs.p3", "jobs.p5"], AS_OF, 10_000_000)
    text = lambda *columns: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    row = lambda frame, name, value: frame.select(F.lit(name).alias("tbl"), "id", value.alias("v"))
    return row(change.upserts["job_enqueue_intents"], "intent", text("status", "promoted_job_id", "promotion_attempts")).unionByName(row(change.upserts["job_queue"], "job", text("job_type", "idempotency_key", "priority")))


# ---------------------------------------------------------------- rows that result, on real conditions

_TEXT = lambda *columns: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))


@query("u1_all_metric_keys", "job_queue job_attempts job_dead_letters job_events", f"""
    SELECT {ORG}, job_type FROM (SELECT organization_id, job_type FROM job_queue WHERE job_type <> 'jobs.p2' OR organization_id = 1
    UNION SELECT q.organization_id, q.job_type FROM job_attempts a JOIN job_queue q ON q.id = a.job_id WHERE a.created_at >= {DAY} AND a.finished_at IS NOT NULL AND (job_type <> 'jobs.p2' OR organization_id = 1)
    UNION SELECT organization_id, job_type FROM job_dead_letters WHERE failed_at >= {DAY} UNION SELECT q.organization_id, q.job_type FROM job_events e JOIN job_queue q ON q.id = e.job_id WHERE e.event_type = 'SUCCEEDED' AND e.occurred_at >= {DAY} AND (job_type <> 'jobs.p2' OR organization_id = 1))""")
def _(l):
    """One type's jobs are gone but for an organization: only letters, which carry their own key, still tell of the others."""
    tables = {"job_queue": l["job_queue"].where("job_type <> 'jobs.p2' OR organization_id = 1"), "job_attempts": l["job_attempts"], "job_dead_letters": l["job_dead_letters"], "job_events": l["job_events"]}
    return metrics.metric_keys(tables, AS_OF).select(org(), "job_type")


@query("x12_retry_hints", "job_queue", f"""
    WITH t AS (SELECT *, CASE WHEN id % 4 = 0 THEN NULL ELSE (id * 7919) % 400000000 END AS delay_us, greatest(1000, least(5000 * CAST(pow(2, least(greatest(attempt, 1), 10)) AS BIGINT), 300000) + id % 1000 - 500) AS policy FROM job_queue WHERE {_LIVE} AND attempt < max_attempts),
    h AS (SELECT *, CASE WHEN delay_us > 0 THEN CAST(ceil(delay_us / 1000.0) AS BIGINT) END AS hint FROM t)
    SELECT id, {NOW} + CASE WHEN coalesce(hint > policy, false) THEN hint ELSE policy END * INTERVAL '1' MILLISECOND AS next_run_at, CASE WHEN coalesce(hint > policy, false) THEN 'HANDLER' ELSE 'POLICY' END AS source FROM h""")
def _(l):
    """Failures with hints of up to 400 seconds: the later of policy and hint, and whose it was, as the event has it."""
    from jobloom.functions.predicates import instant
    from jobloom.functions.timing import hint_after

    delay = F.when(F.col("id") % 4 != 0, F.col("id") * 7919 % 400_000_000)
    change = lifecycle.fail(l["job_queue"], _fence(l, "true").withColumns({"kind": F.lit("RETRYABLE"), "error_code": F.lit("e"), "not_before": hint_after(instant(AS_OF), delay)}), AS_OF)
    said = change.appends["job_events"].where("event_type = 'RETRY_SCHEDULED'").select(F.col("job_id").alias("id"), F.get_json_object("payload", "$.retry_timing_source").alias("source"))
    return change.upserts["job_queue"].where("status = 'PENDING'").select("id", "next_run_at").join(said, "id")


@query("x15_letters", "job_queue", f"""
    SELECT id AS job_id, CASE WHEN {_LIVE} THEN concat_ws('|', CAST(run_number AS VARCHAR), 'new') ELSE '0|old' END AS v FROM job_queue WHERE status = 'LEASED'""")
def _(l):
    """All leased jobs died in an earlier run; those whose lease is live die again, by two commands each: one letter a job, the last one."""
    old = l["job_queue"].where("status = 'LEASED'").select(F.col("id").alias("job_id"), "job_type", "organization_id", F.lit(0).alias("run_number"), "attempt", F.lit("old").alias("error_code"), F.col("payload").alias("payload_snapshot"), F.col("created_at").alias("failed_at"))
    commands = _fence(l, "true").withColumns({"kind": F.lit("TERMINAL"), "error_code": F.lit("new"), "not_before": F.lit(None).cast("timestamp_ntz")})
    change = lifecycle.fail(l["job_queue"], commands.unionByName(commands.withColumn("error_code", F.lit("newer"))), AS_OF)
    after = change.apply({"job_queue": l["job_queue"], "job_attempts": l["job_attempts"], "job_execution_resource_claims": l["job_execution_resource_claims"], "job_events": l["job_events"], "job_dead_letters": old})
    return after["job_dead_letters"].select("job_id", _TEXT("run_number", "error_code").alias("v"))


@query("x18_requeue_rows", "job_queue", f"""
    WITH t AS (SELECT *, status IN ('CANCELED', 'DEAD_LETTERED') AND run_number = 2 AND id % 3 <> 0 AND NOT (status = 'CANCELED' AND coalesce(lease_expires_at > {NOW}, false)) AS hit FROM job_queue)
    SELECT 'job' AS tbl, id, CASE WHEN hit THEN concat_ws('|', 'PENDING', '3', '0', 'queued', CAST({NOW} AS VARCHAR)) ELSE concat_ws('|', status, CAST(run_number AS VARCHAR), CAST(attempt AS VARCHAR), stage, CAST(next_run_at AS VARCHAR)) END AS v FROM t
    UNION ALL SELECT 'event', id, 'REQUEUED|2' FROM t WHERE hit
    UNION ALL SELECT 'duplicates', 0, CAST(count(*) AS VARCHAR) FROM t""")
def _(l):
    """Every job asked for twice, of which steps have a third: the rows that result."""
    jobs = l["job_queue"]
    steps = jobs.where("id % 3 = 0").select(F.col("id").alias("job_id"))
    ask = jobs.select("id", F.when(F.col("status") == "DEAD_LETTERED", "DEAD_LETTERED").otherwise("CANCELED").alias("expected_status"), F.lit(2).alias("expected_run"))
    change = lifecycle.compare_and_requeue(jobs, steps, ask.unionByName(ask), AS_OF)
    after = change.apply({"job_queue": jobs, "job_events": l["job_events"].where("false")})
    row = lambda frame, name, key, value: frame.select(F.lit(name).alias("tbl"), F.col(key).alias("id"), value.alias("v"))
    twice = change.outcomes.where("outcome = 'DUPLICATE'").agg(F.count(F.lit(1)).alias("n")).withColumn("zero", F.lit(0).cast("long"))
    return row(after["job_queue"], "job", "id", _TEXT("status", "run_number", "attempt", "stage", "next_run_at")).unionByName(row(after["job_events"], "event", "job_id", _TEXT("event_type", "run_number"))).unionByName(row(twice, "duplicates", "zero", F.col("n").cast("string")))


@query("x24_patch_rows", "job_queue", """
    SELECT id, CASE WHEN status = 'PENDING' AND attempt = 0 AND idempotency_key IS NULL AND id % 3 <> 0 THEN left(payload, length(payload) - 1) || ',"tags":["a"]}' ELSE payload END AS payload FROM job_queue""")
def _(l):
    """A field set in every payload that may be, by two commands each."""
    jobs = l["job_queue"]
    ask = jobs.select("id", F.lit("tags").alias("field"), F.lit('["a"]').alias("value"))
    change = lifecycle.patch_payload(jobs, jobs.where("id % 3 = 0").select(F.col("id").alias("job_id")), ask.unionByName(ask.withColumn("value", F.lit('["b"]'))))
    return change.apply({"job_queue": jobs})["job_queue"].select("id", "payload")


@query("x19_replay_rows", "job_queue", f"""
    WITH hit AS (SELECT * FROM job_queue WHERE status = 'SUCCEEDED' AND run_number = 1)
    SELECT 'job' AS tbl, 10000000 + 3 * id AS id, concat_ws('|', job_type, coalesce(CAST(organization_id AS VARCHAR), '-'), payload, 'PENDING', '1', '0', 'queued', CAST({NOW} AS VARCHAR), '-') AS v FROM hit
    UNION ALL SELECT 'lineage', 10000000 + 3 * id, concat_ws('|', CAST(id AS VARCHAR), '1', 'k', 'why') FROM hit
    UNION ALL SELECT 'outcome', 3 * id, 'REPLAYED' FROM hit UNION ALL SELECT 'outcome', 3 * id + 1, 'EXISTING' FROM hit UNION ALL SELECT 'outcome', 3 * id + 2, 'CONFLICT' FROM hit
    UNION ALL SELECT 'outcome', 3 * id + n, 'EXPECTATION_MISMATCH' FROM job_queue, (VALUES (0), (1), (2)) AS t(n) WHERE NOT (status = 'SUCCEEDED' AND run_number = 1)""")
def _(l):
    """Every job asked for three times, the last time for another reason: new jobs, their lineage and the outcomes."""
    jobs = l["job_queue"]
    ask = jobs.select("id", F.explode(F.array(*map(F.lit, range(3)))).alias("n")).select((3 * F.col("id") + F.col("n")).alias("ordinal"), F.col("id").alias("source_job_id"), F.lit(1).alias("source_run_number"), F.lit("k").alias("replay_request_key"), F.when(F.col("n") == 2, "other").otherwise("why").alias("reason"))
    done = l.spark.createDataFrame([], "replay_job_id long, source_job_id long, source_run_number int, replay_request_key string, reason string")
    change = lifecycle.replay(jobs, done, ask, AS_OF, 10_000_000)
    row = lambda frame, name, key, value: frame.select(F.lit(name).alias("tbl"), F.col(key).alias("id"), value.alias("v"))
    new = change.upserts["job_queue"]
    return (
        row(new, "job", "id", _TEXT("job_type", "organization_id", "payload", "status", "run_number", "attempt", "stage", "next_run_at", "idempotency_key"))
        .unionByName(row(change.appends["job_replays"], "lineage", "replay_job_id", _TEXT("source_job_id", "source_run_number", "replay_request_key", "reason"))).unionByName(row(change.outcomes, "outcome", "ordinal", F.col("outcome")))
    )


@query("x4_resource_keys", "job_queue job_definitions", """
    SELECT id AS ordinal, CASE WHEN id % 5 IN (0, 1) THEN 'INVALID_RESOURCE' WHEN id % 5 = 2 AND id % 7 = 0 THEN 'INVALID_RESOURCE' WHEN job_type IN (SELECT job_type FROM job_definitions WHERE is_enabled) THEN 'INSERTED' ELSE 'NO_ENABLED_DEFINITION' END AS outcome FROM job_queue""")
def _(l):
    """Every job enqueued anew with resource keys of all kinds: empty, blank by a space that isn't ASCII, just too long, long enough, and none."""
    place = F.col("id") % 5
    key = F.when(place == 0, "").when(place == 1, "\u2003 \u3000").when(place == 2, F.when(F.col("id") % 7 == 0, "é" * 257).otherwise("é" * 256)).when(place == 3, F.concat(F.lit("r"), F.col("id").cast("string")))
    none = lambda kind: F.lit(None).cast(kind)
    commands = l["job_queue"].select(F.col("id").alias("ordinal"), "job_type", "organization_id", "payload", none("int").alias("priority"), none("int").alias("max_attempts"), none("timestamp_ntz").alias("next_run_at"), none("string").alias("idempotency_key"), none("string").alias("stage"), key.alias("execution_resource_key"))
    return lifecycle.enqueue(l["job_queue"], l["job_definitions"], commands, AS_OF, 10_000_000).outcomes.select("ordinal", "outcome")


@query("a10_eligible_types", "job_enqueue_intents job_definitions", f"""
    SELECT job_type, EXISTS (SELECT 1 FROM job_enqueue_intents i WHERE i.job_type = d.job_type AND status = 'PENDING' AND next_promotion_at <= {NOW}) AND is_enabled AS eligible FROM job_definitions d""")
def _(l):
    types = [r[0] for r in l["job_definitions"].select("job_type").collect()]  # a catalogue of some types
    return l.spark.createDataFrame([(t, intents.has_eligible(l["job_enqueue_intents"], l["job_definitions"], [t], AS_OF)) for t in types], "job_type string, eligible boolean")


@query("src3_steps_from_json", "workflow_steps", "SELECT workflow_run_id, step_key, execution_kind, coalesce(job_id, -1) AS job_id FROM workflow_steps")
def _(l):
    """Each run's steps sent as one JSON array of records and taken apart again."""
    sent = l["workflow_steps"].groupBy("workflow_run_id").agg(F.to_json(F.collect_list(F.struct("step_key", "execution_kind", "job_id"))).alias("records"))
    rows = sent.select("workflow_run_id", F.inline(changes.rows_from_json("records", "step_key string, execution_kind string, job_id bigint")))
    return rows.withColumn("job_id", F.coalesce("job_id", F.lit(-1).cast("long")))


@query("d17_same_append", "workflow_steps workflow_step_dependencies", """
    SELECT DISTINCT workflow_run_id AS ordinal, workflow_run_id % 3 <> 1 AS same FROM workflow_steps""")
def _(l):
    """Each run's declaration as a stored append, against itself in another order and spelling; every third one with another payload."""
    _, steps, edges = _declared(l)
    known = workflow_writes.declared(steps, edges).select("ordinal", "request")
    other = F.when(F.col("ordinal") % 3 == 1, F.concat(F.lit('{"other":'), F.col("step_ordinal").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit(' { "step" : '), (F.col("step_ordinal") % 10).cast("string"), F.lit(".0 } ")))
    return workflow_writes.same_append(known, steps.orderBy(F.desc("step_key")).withColumn("payload", other), edges.orderBy(F.desc("prerequisite_key")))


@query("t8_dashboard_order", _ALL, f"""WITH {_Q_ROLLUP}, {_BY_DEFINITION}
    SELECT job_type, row_number() OVER (ORDER BY pending_count + leased_count DESC, job_type) AS place FROM metrics""")
def _(l):
    """The places that the dashboard's own order gives."""
    return metrics.dashboard(l, AS_OF).coalesce(1).select("job_type", (F.monotonically_increasing_id() + 1).alias("place"))


@query("j13_claimed_heads", "job_queue job_execution_resource_claims", f"""WITH {_ELIGIBLE}
    SELECT q.id, q.execution_resource_key, q.priority FROM job_queue q WHERE q.id IN (SELECT id FROM heads)""")
def _(l):
    """Whole rows of the jobs that are the first of their resource."""
    heads = claims.resource_heads(l["job_queue"], l["job_execution_resource_claims"], AS_OF, 50).select("id")
    return l["job_queue"].join(heads, "id", "left_semi").select("id", "execution_resource_key", "priority")


@query("x2_enqueue_rows", "job_queue job_definitions", f"""
    WITH c AS (SELECT id, n, job_type, organization_id, 'new-' || CAST(id // 2 AS VARCHAR) AS key, CASE WHEN n = 1 AND id % 3 = 0 THEN '{{"n":0}}' ELSE payload END AS payload, 4 * id + n AS ordinal FROM job_queue, (VALUES (0), (1)) AS t(n) WHERE id % 2 = 0
        UNION ALL SELECT id, 2, job_type, organization_id, NULL, payload, 4 * id + 2 FROM job_queue WHERE id % 2 = 0),
    o AS (SELECT *, CASE WHEN job_type NOT IN (SELECT job_type FROM job_definitions WHERE is_enabled) THEN 'NO_ENABLED_DEFINITION' WHEN n <> 1 THEN 'INSERTED' WHEN id % 3 = 0 THEN 'CONFLICT' ELSE 'EXISTING' END AS outcome FROM c)
    SELECT 'outcome' AS tbl, ordinal AS id, outcome || '|' || CASE outcome WHEN 'INSERTED' THEN CAST(10000000 + ordinal AS VARCHAR) WHEN 'EXISTING' THEN CAST(10000000 + ordinal - 1 AS VARCHAR) ELSE '-' END AS v FROM o WHERE outcome <> 'CONFLICT'
    UNION ALL SELECT 'outcome', ordinal, 'CONFLICT' FROM o WHERE outcome = 'CONFLICT'
    UNION ALL SELECT 'job', 10000000 + ordinal, concat_ws('|', o.job_type, coalesce(CAST(organization_id AS VARCHAR), '-'), payload, 'PENDING', CAST(default_priority AS VARCHAR), '1', '0', CAST(d.max_attempts AS VARCHAR), CAST({NOW} AS VARCHAR), 'queued', coalesce(key, '-')) FROM o JOIN job_definitions d ON d.job_type = o.job_type WHERE outcome = 'INSERTED'""")
def _(l):
    """Every second job enqueued anew, by three commands: under a key, under it again in another spelling (a third of these with another payload), and without."""
    none = lambda kind: F.lit(None).cast(kind)
    n = F.explode(F.array(*map(F.lit, range(3)))).alias("n")
    each = l["job_queue"].where("id % 2 = 0").select("id", "job_type", "organization_id", "payload", n)
    payload = F.when((F.col("n") == 1) & (F.col("id") % 3 == 0), '{"n":0}').otherwise(F.col("payload"))
    key = F.when(F.col("n") < 2, F.concat(F.lit("new-"), F.floor(F.col("id") / 2).cast("string")))
    commands = each.select((4 * F.col("id") + F.col("n")).alias("ordinal"), "job_type", "organization_id", payload.alias("payload"), none("int").alias("priority"), none("int").alias("max_attempts"), none("timestamp_ntz").alias("next_run_at"), key.alias("idempotency_key"), none("string").alias("stage"))
    change = lifecycle.enqueue(l["job_queue"].where("false"), l["job_definitions"], commands, AS_OF, 10_000_000)
    row = lambda frame, name, key, value: frame.select(F.lit(name).alias("tbl"), F.col(key).alias("id"), value.alias("v"))
    said = F.when(F.col("outcome") == "CONFLICT", F.col("outcome")).otherwise(_TEXT("outcome", "job_id"))
    return row(change.outcomes, "outcome", "ordinal", said).unionByName(row(change.upserts["job_queue"], "job", "id", _TEXT("job_type", "organization_id", "payload", "status", "priority", "run_number", "attempt", "max_attempts", "next_run_at", "stage", "idempotency_key")))


@query("i4_failure_classes", "job_enqueue_intents job_definitions", f"""
    WITH b AS (SELECT * FROM job_enqueue_intents WHERE status = 'PENDING' AND next_promotion_at <= {NOW} AND job_type IN ('jobs.p1', 'jobs.p2') ORDER BY next_promotion_at, created_at, id LIMIT 24)
    SELECT id, CASE WHEN id % 6 IN (0, 1, 2, 3) THEN 'CONFLICTED' ELSE 'PROMOTED' END AS status FROM b""")
def _(l):
    """The next batch with requests that no job can be made of: not JSON, no object, a blank resource key, a stage that isn't one."""
    kinds = ("nope", "[1]", '{"execution_resource_key":" "}', '{"stage":"late"}', '{"stage":"queued"}', '{"execution_resource_key":"r"}')
    wrong = F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % 6 + 1).cast("int"))
    table = l["job_enqueue_intents"].withColumns({"enqueue_request": wrong, "idempotency_key": F.concat(F.lit("own-"), F.col("id").cast("string"))})
    return intents.promote(table, l["job_queue"], l["job_definitions"], ["jobs.p1", "jobs.p2"], AS_OF, 10_000_000).upserts["job_enqueue_intents"].select("id", "status")
