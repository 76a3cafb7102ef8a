"""Delays and instants: retries, deferrals, leases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the retry policy.
RETRY_STEP_MS, RETRY_MOST_MS, RETRY_LEAST_MS = 5_000, 300_000, 1_000


def retry_delay_ms(attempt: Column, job_id: Column) -> Column:
    """The policy's delay before another attempt: doubling to a limit, spread by the job's id."""
    doubled = F.lit(RETRY_STEP_MS) * F.pow(F.lit(2), F.least(F.greatest(attempt, F.lit(1)), F.lit(10))).cast("long")
    return F.greatest(F.lit(RETRY_LEAST_MS).cast("long"), F.least(doubled, F.lit(RETRY_MOST_MS).cast("long")) + job_id % 1000 - 500)


def deferral_ms(attempts: Column, share: Column) -> Column:
    """How long a promotion is put off: doubling to four minutes, and ``share`` (0 to 1) of a quarter of that."""
    power = F.pow(F.lit(2.0), F.least(attempts, F.lit(9)))
    return F.least(F.lit(240_000.0), power * 1000) + share * F.least(F.lit(60_000.0), power * 250)


def plus_ms(at: Column, ms: Column) -> Column:
    return at + F.make_dt_interval(secs=(ms / 1000.0).cast("decimal(18,6)"))


def failure_outcome(kind: Column, attempt: Column, most: Column) -> Column:
    """What a failure leads to."""
    return F.when(kind.isin("TERMINAL", "PANICKED"), "DEAD_LETTER").when(attempt >= most, "DEAD_LETTER").otherwise("RETRY")


def hint_after(failed_at: Column, delay_us: Column) -> Column:
    """The instant that a handler asks for by a delay: whole milliseconds, rounded up; no delay is no hint."""
    return F.when(delay_us > 0, plus_ms(failed_at, F.ceil(delay_us / 1000)))


def retry_at(failed_at: Column, policy_ms: Column, hint: Column) -> tuple[Column, Column]:
    """The next attempt's instant and whose it is: the later of the policy's and a handler's hint, the policy's if equal."""
    policy = plus_ms(failed_at, policy_ms)
    later = F.coalesce(hint > policy, F.lit(False))
    return F.when(later, hint).otherwise(policy), F.when(later, "HANDLER").otherwise("POLICY")
