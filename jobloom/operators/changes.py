"""Snapshots and what changes them: upserts, inserts, updates and deletes as joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The natural key of each ledger table that changes.
KEYS = {
    "job_queue": ["id"], "job_attempts": ["job_id", "run_number", "attempt"], "job_dead_letters": ["job_id"], "job_replays": ["replay_job_id"],
    "job_execution_resource_claims": ["resource_key"], "job_enqueue_intents": ["id"], "job_schedules": ["id"], "job_definitions": ["job_type"], "job_runtime_configs": ["job_type"],
    "workflow_runs": ["id"], "workflow_steps": ["id"], "workflow_step_dependencies": ["prerequisite_step_id", "dependent_step_id"],
}
#: What tells the rows of a table that ``updates`` means, where its key isn't enough: a claim that its job still holds.
OWNED = KEYS | {"job_execution_resource_claims": ["resource_key", "job_id"]}


@dataclass
class Change:
    """What a transition does, by table: rows that are new or replace those of the same key, columns set in rows that are there, rows appended to logs, rows deleted."""

    upserts: dict[str, DataFrame] = field(default_factory=dict)
    appends: dict[str, DataFrame] = field(default_factory=dict)
    deletes: dict[str, DataFrame] = field(default_factory=dict)
    outcomes: DataFrame | None = None
    updates: dict[str, DataFrame] = field(default_factory=dict)

    def apply(self, ledger: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The next snapshot. One writer applies changes; that replaces row locks.

        Deletes come first, then updates, upserts and appends. ``updates`` never adds a row, and leaves
        columns that it doesn't have; ``deletes`` names rows by any of their columns.
        """
        after = dict(ledger)
        now = lambda name: after.get(name, ledger[name])
        for name, rows in self.deletes.items():
            after[name] = now(name).join(rows, rows.columns, "left_anti")
        for name, rows in self.updates.items():
            after[name] = set_columns(now(name), rows, OWNED[name])
        for name, rows in self.upserts.items():
            after[name] = upsert(now(name), rows, KEYS[name])
        for name, rows in self.appends.items():
            after[name] = now(name).unionByName(rows.select(*[c for c in rows.columns if c in now(name).columns]), allowMissingColumns=True)
        return after


def one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: that of the lowest ``ordinal``, if there is one, then the smallest by its other columns in order; the same whatever the partitions."""
    rest = sorted((c for c in rows.columns if c not in keys), key=lambda c: c != "ordinal")
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_least")).select(*keys, "_least.*").select(*rows.columns)


def nth_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_nth``, their number among those of the same key, in the order of ``one_each``."""
    rest = sorted((c for c in rows.columns if c not in keys), key=lambda c: c != "ordinal")
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*(rest or keys))))


def set_columns(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the columns of ``rows`` besides its keys set in the rows that it names, to null as well; columns that base lacks are ignored.

    Of rows that share a key, one counts (``one_each``), so no row of ``base`` is doubled.
    """
    columns = [c for c in rows.columns if c not in keys and c in base.columns]
    rows = one_each(rows.select(*keys, *columns), keys)
    new = rows.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_named"))
    joined = base.join(new, keys, "left")
    return joined.select(*(F.when(F.col("_named"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def upsert(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with rows replaced by those of ``rows`` that have their key, and the others added; of rows that share a key, one counts (``one_each``)."""
    kept = base.join(rows.select(*keys), keys, "left_anti")
    return kept.unionByName(one_each(rows.select(*[c for c in base.columns if c in rows.columns]), keys), allowMissingColumns=True)


def upsert_if_changed(base: DataFrame, rows: DataFrame, keys: list[str], compared: list[str], stamp: tuple[str, Column]) -> DataFrame:
    """As ``upsert``, but rows whose compared columns are the same stay as they are; changed and new ones are stamped."""
    old = base.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in compared), F.lit(True).alias("_there"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    changed = rows.join(old, keys, "left").where(F.col("_there").isNull() | ~same).select(*rows.columns).withColumn(*stamp)
    return upsert(base, changed, keys)


def insert_missing(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and those of ``rows`` whose key it lacks; a null in a key equals a null."""
    match = F.lit(True)
    for k in keys:
        match = match & rows[k].eqNullSafe(base[k])
    return base.unionByName(rows.join(base, match, "left_anti"), allowMissingColumns=True)


def update_from(base: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``base`` with columns taken from ``rows`` where there is one and it has a value."""
    new = rows.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = base.join(new, keys, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def delete_oldest(base: DataFrame, condition: Column, order: list[Column], limit: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """``base`` without the first ``limit`` rows that meet a condition, and those rows' keys."""
    gone = base.where(condition).orderBy(*order).limit(limit).select(key)
    return base.join(gone, key, "left_anti"), gone


def rows_from_json(column: str, schema: str) -> Column:
    """A JSON array's records as an array of structs; a JSON null is a null field."""
    return F.from_json(column, f"array<struct<{schema}>>")


def rows_from_arrays(rows: DataFrame, keep: list[str], arrays: dict[str, str]) -> DataFrame:
    """A row for each place of arrays that go side by side, under the names given: columns of ``keep`` and one for each array.

    Shorter arrays give nulls where others go on; null and empty ones have no places.
    """
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    zipped = F.arrays_zip(*(empty(c).alias(c) for c in arrays))
    return rows.select(*keep, F.explode(zipped).alias("_at")).select(*keep, *(F.col("_at")[c].alias(name) for c, name in arrays.items()))


def event(rows: DataFrame, kind: str, as_of: Column, payload: Column | None = None, stage: Column | None = None) -> DataFrame:
    """A ledger event for each row (id, run_number, attempt)."""
    return rows.select(
        F.col("id").alias("job_id"), "run_number", "attempt", F.lit(kind).alias("event_type"),
        (stage if stage is not None else F.lit(None).cast("string")).alias("stage"), (payload if payload is not None else F.lit("{}")).alias("payload"), as_of.alias("occurred_at"),
    )
