"""Leases that end by themselves: a timer in event time for each job of a stream of its events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "job_id long, run_number int, attempt int, worker_id string, event_type string, occurred_at timestamp"
_STATE = "run_number int, attempt int, worker_id string, until long"
#: Events that begin or extend a lease; all others of the same run and attempt end it.
_HOLDS = ("LEASED", "HEARTBEAT")


class _Leases(StatefulProcessor):
    """The lease of one job, and a timer at its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.lease.get() if self.lease.exists() else None
        late = []
        for e in pd.concat(list(rows)).sort_values(["occurred_at", "id"]).itertuples():
            place = (int(e.run_number), int(e.attempt))
            if held is not None and place < (held[0], held[1]):
                continue  # of an earlier holder
            if e.event_type in _HOLDS:
                until = int(pd.Timestamp(e.lease_expires_at).value // 1_000_000)
                if until <= timerValues.getCurrentWatermarkInMs():
                    late.append((*place, e.worker_id, until))  # its end lies behind already: no timer would come
                    held = None
                else:
                    held = (*place, e.worker_id, until)
                    late = [x for x in late if x[:2] != place]
            else:
                held, late = None, [x for x in late if x[:2] != place]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.lease.clear()
        else:
            self.lease.update(held)
            self.handle.registerTimer(held[3])
        yield _expired(key[0], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.lease.get() if self.lease.exists() else None
        self.lease.clear()
        yield _expired(key[0], [] if held is None else [held])

    def close(self) -> None:
        pass


def _expired(job_id: int, leases: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({
        "job_id": pd.Series([job_id] * len(leases), dtype="int64"), "run_number": pd.Series([x[0] for x in leases], dtype="int32"), "attempt": pd.Series([x[1] for x in leases], dtype="int32"),
        "worker_id": pd.Series([x[2] for x in leases], dtype="object"), "event_type": pd.Series(["LEASE_EXPIRED"] * len(leases), dtype="object"), "occurred_at": pd.to_datetime(pd.Series([x[3] for x in leases], dtype="int64"), unit="ms"),
    })


def expired_leases(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """A stream of events (id, job_id, run_number, attempt, worker_id, event_type, occurred_at, lease_expires_at) as the stream of leases that ended without a word of their holder.

    LEASED and HEARTBEAT hold a lease until lease_expires_at; any other event of its run and attempt ends it in time; events of earlier holders count for nothing. A
    lease expires once, when the watermark, ``delay`` behind the latest event, passes its end. The session's state store must be the RocksDB one. Times are of the zoned type, as watermarks need it.
    """
    timed = events.withWatermark("occurred_at", delay)
    return timed.groupBy("job_id").transformWithStateInPandas(statefulProcessor=_Leases(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")
