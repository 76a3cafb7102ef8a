"""Schedules: cron fires with jitter, due claims, materialised jobs, catalogue sync."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, TimestampNTZType

from jobloom.functions.predicates import among, instant
from jobloom.operators.changes import set_columns, upsert

# Fields of a cron expression with seconds, their ranges and names.
FIELDS = (("second", 0, 59), ("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 1, 7))
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "sun mon tue wed thu fri sat".split()
RETRY_SECONDS = 30


def parse_cron(text: str) -> list[set[int]]:
    """The values that each field of ``second minute hour day month weekday`` allows; Sunday is 1."""
    parts = text.split()
    if len(parts) != 6:
        raise ValueError("a cron expression has six fields")
    found = []
    for part, (name, low, high) in zip(parts, FIELDS):
        names = {"month": MONTHS, "weekday": WEEKDAYS}.get(name, [])
        number = lambda t: names.index(t.lower()[:3]) + 1 if t.isalpha() else int(t)  # noqa: B023, E731
        values: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            if span in ("*", "?"):
                first, last = low, high
            elif "-" in span:
                first, last = map(number, span.split("-"))
            else:
                first = number(span)
                last = high if step else first
            values.update(range(first, last + 1, int(step or 1)))
        if not values or min(values) < low or max(values) > high:
            raise ValueError(f"{name} out of range")
        found.append(values)
    return found


def next_fire(cron: list[set[int]], after: datetime) -> datetime | None:
    """The first instant after ``after`` that meets all fields, within eight years."""
    seconds, minutes, hours, days, months, weekdays = cron
    at = after.replace(microsecond=0) + timedelta(seconds=1)
    end = after + timedelta(days=8 * 366)
    while at < end:
        if at.month not in months:
            at = (at.replace(day=1, hour=0, minute=0, second=0) + timedelta(days=32)).replace(day=1)
        elif at.day not in days or at.isoweekday() % 7 + 1 not in weekdays:
            at = at.replace(hour=0, minute=0, second=0) + timedelta(days=1)
        elif at.hour not in hours:
            at = at.replace(minute=0, second=0) + timedelta(hours=1)
        elif at.minute not in minutes:
            at = at.replace(second=0) + timedelta(minutes=1)
        elif at.second not in seconds:
            at += timedelta(seconds=1)
        else:
            return at
    return None


def jitter_seconds(schedule_id: int, fire_at: datetime, most: int) -> int:
    """A schedule's own spread of a fire: its 128-bit id and the fire's milliseconds, mixed, modulo."""
    ms = int(fire_at.replace(tzinfo=timezone.utc).timestamp() * 1000)
    return (schedule_id ^ ms) % (most + 1) if most > 0 else 0


def _number(schedule_id) -> int:
    return uuid.UUID(schedule_id).int if isinstance(schedule_id, str) and "-" in schedule_id else int(schedule_id)


def next_fire_coalesced(cron_text: str, scheduled_for: datetime, now: datetime, schedule_id, most: int) -> datetime | None:
    """The jittered fire after the one that was due; if that is past too, the earliest one after now.

    Fires missed meanwhile count as the one that is being made.
    """
    cron, number = parse_cron(cron_text), _number(schedule_id)
    spread = lambda base: base + timedelta(seconds=jitter_seconds(number, base, most))
    base = next_fire(cron, scheduled_for)
    if base is None or spread(base) > now:
        return base and spread(base)
    best, base = None, now - timedelta(seconds=most + 1 if most > 0 else 0)  # what lies before can't land after now
    while (base := next_fire(cron, base)) is not None and (best is None or base < best):
        if spread(base) > now:
            best = min(best or spread(base), spread(base))
    return best


def next_fires(schedules: DataFrame, as_of: str) -> DataFrame:
    """Each schedule (id, cron_expr, next_fire_at, max_jitter_seconds) with the fire after the one that is due; null where the expression is bad."""
    now = datetime.fromisoformat(as_of)

    @pandas_udf(TimestampNTZType())
    def fire(ids: pd.Series, crons: pd.Series, at: pd.Series, most: pd.Series) -> pd.Series:
        out = []
        for i, c, a, m in zip(ids, crons, at, most):
            try:
                out.append(next_fire_coalesced(c, pd.Timestamp(a).to_pydatetime(), now, i, int(m)))
            except ValueError:
                out.append(None)
        return pd.Series(pd.to_datetime(out))

    return schedules.withColumn("following_fire_at", fire("id", "cron_expr", "next_fire_at", "max_jitter_seconds"))


def due_schedules(schedules: DataFrame, as_of: str, limit: int) -> DataFrame:
    """Active schedules that are due, oldest first."""
    return schedules.where(F.col("is_active") & (F.col("next_fire_at") <= instant(as_of))).orderBy("next_fire_at", "id").limit(limit)


@pandas_udf(StringType())
def with_schedule(payloads: pd.Series, ids: pd.Series, names: pd.Series, fires: pd.Series) -> pd.Series:
    """Payloads with the schedule's particulars: a member of an object, else beside the value."""
    out = []
    for payload, i, name, at in zip(payloads, ids, names, fires):
        value = json.loads(payload) if payload is not None else None
        note = {"id": str(i), "name": name, "scheduled_for": pd.Timestamp(at).isoformat() + "Z"}
        out.append(json.dumps({**value, "_schedule": note} if isinstance(value, dict) else {"payload": value, "_schedule": note}, separators=(",", ":")))
    return pd.Series(out)


def materialise(schedules: DataFrame, definitions: DataFrame, as_of: str, limit: int) -> DataFrame:
    """The jobs that due schedules make: type, payload, stage, next_run_at; a type without enabled definition is put off."""
    fired = due_schedules(schedules, as_of, limit).join(definitions.where("is_enabled").select("job_type", F.lit(True).alias("defined")), "job_type", "left")
    retry = instant(as_of) + F.expr(f"INTERVAL '{RETRY_SECONDS}' SECOND")
    return fired.select("id", "job_type", F.when(F.col("defined"), with_schedule("payload_template", "id", "name", "next_fire_at")).alias("payload"), F.lit("scheduled").alias("stage"), F.when(F.col("defined"), instant(as_of)).otherwise(retry).alias("next_run_at"), F.coalesce("defined", F.lit(False)).alias("enqueued"))


def sync(schedules: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Schedules with those of a catalogue (same columns) put in; the next fire is reset only where the cron changed, activity stays."""
    old = schedules.select("name", F.col("id").alias("old_id"), F.col("cron_expr").alias("old_cron"), F.col("next_fire_at").alias("old_fire"), F.col("is_active").alias("old_active"))
    same = F.col("old_cron").eqNullSafe(F.col("cron_expr"))
    new = catalogue.join(old, "name", "left").withColumns({"id": F.coalesce("old_id", "id"), "next_fire_at": F.when(same, F.col("old_fire")).otherwise(F.col("next_fire_at")), "is_active": F.coalesce("old_active", "is_active")})
    return upsert(schedules, new.select(*schedules.columns), ["name"])


def to_deactivate(schedules: DataFrame, scope: list[str], present: list[str]) -> DataFrame:
    """Active schedules of a scope of names that a catalogue lacks, sorted."""
    return schedules.where(F.col("is_active") & among("name", scope) & ~among("name", present)).select("name").orderBy("name")


def set_active(schedules: DataFrame, commands: DataFrame) -> DataFrame:
    """Schedules with activity set by name (name, is_active); names that aren't there do nothing."""
    return set_columns(schedules, commands, ["name"])


def set_next_fire(schedules: DataFrame, commands: DataFrame) -> DataFrame:
    """Schedules with their next fire set by name (name, next_fire_at)."""
    return set_columns(schedules, commands, ["name"])
