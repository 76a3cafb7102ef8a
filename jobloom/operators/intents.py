"""The outbox: recorded intents to enqueue, their promotion and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.json_text import canonical_json
from jobloom.functions.predicates import among, due, instant
from jobloom.functions.timing import deferral_ms, plus_ms
from jobloom.operators.changes import Change, delete_oldest, event

MOST_PROMOTED = 24
#: A job's stages, and what is blank.
STAGES = ("queued", "scheduled", "running", "completed")
BLANK = r"(?U)^\s*\z"
#: Error codes of requests that can never be promoted.
CONFLICTS = ("job.intent_invalid_persisted_row", "job.invalid_job_type", "job.invalid_execution_resource_key", "job.invalid_stage")


def record(intents: DataFrame, commands: DataFrame, as_of: str, first_id: int) -> Change:
    """Records intents (ordinal, job_type, organization_id, idempotency_key, enqueue_request), once per key.

    The same request again is the existing intent; another one is a conflict.
    """
    key = ["job_type", "organization_id", "idempotency_key"]
    asked = commands.withColumn("request", canonical_json("enqueue_request"))
    there = intents.select(*(F.col(c).alias(f"_{c}") for c in key), canonical_json("enqueue_request").alias("there"))
    match = (F.col("job_type") == F.col("_job_type")) & F.col("organization_id").eqNullSafe(F.col("_organization_id")) & (F.col("idempotency_key") == F.col("_idempotency_key"))
    lead = Window.partitionBy(*key).orderBy("ordinal")
    joined = asked.withColumns({"nth": F.row_number().over(lead), "lead": F.first("request").over(lead)}).join(there, match, "left")
    outcome = F.when(F.coalesce("there", F.when(F.col("nth") > 1, F.col("lead"))).isNull(), "INSERTED").when(F.coalesce("there", "lead") == F.col("request"), "EXISTING").otherwise("CONFLICT")
    decided = joined.withColumn("outcome", outcome)
    new = decided.where("outcome = 'INSERTED'").select((F.lit(first_id) + F.col("ordinal")).cast("long").alias("id"), *key, "enqueue_request", F.lit("PENDING").alias("status"), F.lit(0).alias("promotion_attempts"), instant(as_of).alias("next_promotion_at"), instant(as_of).alias("created_at"))
    return Change({"job_enqueue_intents": new}, outcomes=decided.select("ordinal", "outcome"))


def eligible(intents: DataFrame, definitions: DataFrame, types: list[str], as_of: str) -> DataFrame:
    """Pending intents that are due, of allowed types with an enabled definition."""
    known = definitions.where("is_enabled").select("job_type")
    return intents.where((F.col("status") == "PENDING") & due(as_of, "next_promotion_at") & among("job_type", types)).join(known, "job_type", "left_semi")


def has_eligible(intents: DataFrame, definitions: DataFrame, types: list[str], as_of: str) -> bool:
    return not eligible(intents, definitions, types, as_of).isEmpty()


def batch(intents: DataFrame, definitions: DataFrame, types: list[str], as_of: str, limit: int = MOST_PROMOTED) -> DataFrame:
    """The next intents to promote, oldest first."""
    return eligible(intents, definitions, types, as_of).orderBy("next_promotion_at", "created_at", "id").limit(min(limit, MOST_PROMOTED))


def failure_class(code: Column) -> Column:
    """Whether a failed promotion settles the intent or puts it off."""
    return F.when(code.isin(*CONFLICTS), "CONFLICTED").otherwise("DEFERRED")


def promote(intents: DataFrame, jobs: DataFrame, definitions: DataFrame, types: list[str], as_of: str, first_id: int, limit: int = MOST_PROMOTED, share: Column | None = None) -> Change:
    """Turns a batch into jobs. One whose key a job has already converges on it if the requests are equal.

    One that can never be promoted (its request is no JSON object, or its type, resource key or stage is none) is settled as a
    conflict; any other failure, such as a key taken by another request, is put off. Outcomes are counted by kind.
    """
    now = instant(as_of)
    chosen = batch(intents, definitions, types, as_of, limit)
    key = ["job_type", "organization_id", "idempotency_key"]
    there = jobs.where("idempotency_key IS NOT NULL").select(*(F.col(c).alias(f"_{c}") for c in key), F.col("id").alias("there_id"), F.coalesce("enqueue_request", F.lit("null")).alias("there"))
    match = (F.col("job_type") == F.col("_job_type")) & F.col("organization_id").eqNullSafe(F.col("_organization_id")) & (F.col("idempotency_key") == F.col("_idempotency_key"))
    lead = Window.partitionBy(*key).orderBy("created_at", "id")
    joined = chosen.withColumns({"nth": F.row_number().over(lead), "lead": F.first("id").over(lead), "request": canonical_json("enqueue_request")}).join(there, match, "left")
    taken = F.col("there_id").isNotNull() & ~F.col("request").eqNullSafe(canonical_json("there"))
    asked = lambda name: F.get_json_object("enqueue_request", f"$.{name}")
    resource = asked("execution_resource_key")
    code = (
        F.when(F.col("request").isNull() | ~F.col("request").startswith("{"), "job.intent_invalid_persisted_row").when(F.col("job_type").rlike(BLANK), "job.invalid_job_type")
        .when(resource.rlike(BLANK) | (F.octet_length(resource) > 512), "job.invalid_execution_resource_key").when(~asked("stage").isin(*STAGES), "job.invalid_stage").when(taken, "job.idempotency_conflict")
    )
    outcome = F.when(code.isNotNull(), failure_class(code)).when(F.col("there_id").isNotNull() | (F.col("nth") > 1), "EXISTING").otherwise("PROMOTED")
    decided = joined.withColumn("outcome", outcome)
    job_id = F.coalesce("there_id", (F.lit(first_id) + F.col("lead")).cast("long"))
    is_done, is_conflict = F.col("outcome").isin("PROMOTED", "EXISTING"), F.col("outcome") == "CONFLICTED"
    put_off = plus_ms(now, deferral_ms(F.col("promotion_attempts"), F.lit(0.0) if share is None else share))
    done = decided.withColumns({
        "status": F.when(is_conflict, "CONFLICTED").when(is_done, "PROMOTED").otherwise("PENDING"), "promotion_attempts": F.col("promotion_attempts") + 1,
        "promoted_job_id": F.when(is_done, job_id), "promoted_at": F.when(is_done, now), "conflicted_at": F.when(is_conflict, now), "next_promotion_at": F.when(F.col("outcome") == "DEFERRED", put_off).otherwise(F.col("next_promotion_at")),
    }).select(*intents.columns)
    new = decided.where("outcome = 'PROMOTED'").join(definitions.select("job_type", "default_priority", "max_attempts"), "job_type").select(
        job_id.alias("id"), *key, "enqueue_request", F.lit("PENDING").alias("status"), F.col("default_priority").alias("priority"), "max_attempts", F.lit(1).alias("run_number"), F.lit(0).alias("attempt"), F.lit("queued").alias("stage"), now.alias("next_run_at"), now.alias("created_at")
    )
    return Change({"job_enqueue_intents": done, "job_queue": new}, {"job_events": event(new, "ENQUEUED", now)}, outcomes=decided.groupBy("outcome").count())


def deferred(intents: DataFrame, as_of: str, share: Column) -> DataFrame:
    """Intents put off from an instant by the attempts they have had; ``share`` spreads them (0 to 1)."""
    return intents.withColumns({"next_promotion_at": plus_ms(instant(as_of), deferral_ms(F.col("promotion_attempts"), share)), "promotion_attempts": F.col("promotion_attempts") + 1})


def delete_promoted_before(intents: DataFrame, cutoff: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Drops promoted intents from before an instant, oldest first; the rest, and the ids of those that went."""
    return delete_oldest(intents, (F.col("status") == "PROMOTED") & (F.col("promoted_at") < instant(cutoff)), [F.asc("promoted_at"), F.asc("id")], limit)


def delete_promoted_for(intents: DataFrame, job_ids: list[int]) -> DataFrame:
    """Drops the promoted intents of given jobs, 1000 at most."""
    if len(job_ids) > 1000:
        raise ValueError("at most 1000 jobs")
    return intents.where(~((F.col("status") == "PROMOTED") & F.coalesce(among("promoted_job_id", job_ids), F.lit(False))))
