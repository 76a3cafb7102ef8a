"""Workflow declarations built in Python, checked before any Spark job, and given as the frames that ``enqueue_runs`` takes."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

LONGEST_KEY = 512


class BuildError(ValueError):
    """What is wrong with a declaration: ``code`` names it, ``at`` the step, if it is one's."""

    def __init__(self, code: str, at: str | None = None):
        super().__init__(code if at is None else f"{code}: {at}")
        self.code, self.at = code, at


@dataclass(frozen=True)
class Step:
    """A step: a job of a type, or an external one without."""

    key: str
    job_type: str | None = None
    payload: object = None
    priority: int | None = None
    max_attempts: int | None = None
    timeout_seconds: int | None = None
    stage: str | None = None


@dataclass(frozen=True)
class Run:
    """A workflow run to enqueue. Each method gives another run and leaves this one as it is."""

    workflow_type: str
    organization_id: int | None = None
    idempotency_key: str | None = None
    active_key: str | None = None
    result_step_key: str | None = None
    steps: tuple[Step, ...] = ()
    edges: tuple[tuple[str, str, str], ...] = field(default=())

    def of(self, **settings) -> Run:
        """With organization_id, idempotency_key, active_key or result_step_key set; None clears one."""
        return replace(self, **settings)

    def job(self, key: str, job_type: str, payload: object = None, **settings) -> Run:
        return replace(self, steps=(*self.steps, Step(key, job_type or "", payload, **settings)))

    def external(self, key: str, payload: object = None) -> Run:
        return replace(self, steps=(*self.steps, Step(key, None, payload)))

    def after_success(self, key: str, *prerequisites: str) -> Run:
        """``key`` goes on only if these succeed."""
        return replace(self, edges=self.edges + tuple((p, key, "ON_SUCCESS") for p in prerequisites))

    def after_end(self, key: str, *prerequisites: str) -> Run:
        """``key`` goes on once these are over, however."""
        return replace(self, edges=self.edges + tuple((p, key, "ON_TERMINAL") for p in prerequisites))

    def checked(self) -> Run:
        """This run, or the first thing wrong with it as a ``BuildError``."""
        blank = lambda text: not (text or "").strip()
        if blank(self.workflow_type):
            raise BuildError("BLANK_WORKFLOW_TYPE")
        if not self.steps:
            raise BuildError("EMPTY_STEPS")
        if self.idempotency_key is not None and blank(self.idempotency_key):
            raise BuildError("BLANK_IDEMPOTENCY_KEY")
        if self.active_key is not None and blank(self.active_key):
            raise BuildError("BLANK_ACTIVE_KEY")
        if self.active_key is not None and len(self.active_key.encode()) > LONGEST_KEY:
            raise BuildError("ACTIVE_KEY_TOO_LONG")
        keys: set[str] = set()
        for step in self.steps:
            if blank(step.key):
                raise BuildError("BLANK_KEY", step.key)
            if step.key in keys:
                raise BuildError("DUPLICATE_KEY", step.key)
            keys.add(step.key)
            if step.job_type is not None and blank(step.job_type):
                raise BuildError("BLANK_JOB_TYPE", step.key)
            for name in ("max_attempts", "timeout_seconds"):
                value = getattr(step, name)
                if value is not None and value <= 0:
                    raise BuildError(f"NON_POSITIVE_{name.upper()}", step.key)
        if self.result_step_key is not None and self.result_step_key not in keys:
            raise BuildError("BLANK_RESULT_STEP_KEY" if blank(self.result_step_key) else "UNKNOWN_RESULT_STEP_KEY", self.result_step_key)
        seen: set[tuple[str, str]] = set()
        needs: dict[str, set[str]] = {}
        for before, key, _ in self.edges:
            if key not in keys:
                raise BuildError("UNKNOWN_STEP", key)
            if before not in keys:
                raise BuildError("MISSING_PREREQUISITE", key)
            if before == key:
                raise BuildError("SELF_DEPENDENCY", key)
            if (before, key) in seen:
                raise BuildError("DUPLICATE_DEPENDENCY", key)
            seen.add((before, key))
            needs.setdefault(key, set()).add(before)
        ready = [k for k in keys if k not in needs]
        then: dict[str, list[str]] = {}
        for before, key in seen:
            then.setdefault(before, []).append(key)
        while ready:
            for key in then.get(done := ready.pop(), ()):
                needs[key].discard(done)
                if not needs[key]:
                    del needs[key]
                    ready.append(key)
        if needs:
            raise BuildError("CYCLE", min(needs))
        return self


def frames(spark: SparkSession, runs: Iterable[Run] | Mapping[int, Run]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The runs, steps and edges frames of ``enqueue_runs``; every run is checked first. Runs are numbered from 1, unless a mapping gives their ordinals."""
    numbered = {n: r.checked() for n, r in (runs.items() if isinstance(runs, Mapping) else enumerate(runs, 1))}
    text = lambda value: None if value is None else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    first, steps = 0, []
    for n, run in numbered.items():
        steps += [(n, first + k, s.key, "EXTERNAL" if s.job_type is None else "JOB", s.job_type, text(s.payload), s.priority, s.max_attempts, s.timeout_seconds, s.stage) for k, s in enumerate(run.steps)]
        first += len(run.steps)
    edges = [(n, *e) for n, run in numbered.items() for e in run.edges]
    made = [(n, r.workflow_type, r.organization_id, r.idempotency_key, r.result_step_key, r.active_key) for n, r in numbered.items()]
    return (
        spark.createDataFrame(made, "ordinal long, workflow_type string, organization_id long, idempotency_key string, result_step_key string, active_key string"),
        spark.createDataFrame(steps, "ordinal long, step_ordinal long, step_key string, execution_kind string, job_type string, payload string, priority int, max_attempts int, timeout_seconds int, stage string"),
        spark.createDataFrame(edges, "ordinal long, prerequisite_key string, dependent_key string, release_mode string"),
    )
