"""Keyed state of jobs over the stream of their events.

The state of a job has its run; events of earlier runs are stale and only counted, as a stale
holder's writes are rejected in the ledger. The state has no end of life, since keys stay unique for good.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobloom.sources.storage import shared_path

OUTPUT = "job_id long, run_number int, events long, stale_events long, last_event string, version long"
STATE = "run_number int, events long, stale_events long, last_event string, version long"


def advance(state: tuple | None, runs: list[int], kinds: list[str]) -> tuple:
    """The state after events in order."""
    run, events, stale, last, version = state or (0, 0, 0, None, 0)
    for number, kind in zip(runs, kinds):
        if number < run:
            stale += 1
        else:
            run, events, last = number, events + 1, kind
    return run, events, stale, last, version + 1


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job that a batch of the event stream changes. Events of a batch are taken in their order in time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["occurred_at", "id"])
        new = advance(state.get if state.exists else None, rows["run_number"].tolist(), rows["event_type"].tolist())
        state.update(new)
        yield pd.DataFrame({"job_id": [key[0]], "run_number": [new[0]], "events": [new[1]], "stale_events": [new[2]], "last_event": pd.Series([new[3]], dtype="object"), "version": [new[4]]})

    return events.groupBy("job_id").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def drain(events: DataFrame, files_at_once: int = 1000) -> DataFrame:
    """Runs the stream over all events there are (in a folder of their own), and gives the last state of each job."""
    spark = events.sparkSession
    source, sink, checkpoint = (shared_path(spark, x) for x in ("events", "states", "stream"))
    events.select("id", "job_id", "run_number", "event_type", "occurred_at").write.parquet(source)
    stream = spark.readStream.schema("id long, job_id long, run_number int, event_type string, occurred_at timestamp_ntz").option("maxFilesPerTrigger", files_at_once).parquet(source)
    save = lambda batch, n: batch.write.mode("append").parquet(sink)
    job_states(stream).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    best = spark.read.schema(OUTPUT).parquet(sink).groupBy("job_id").agg(F.max_by(F.struct("run_number", "events", "stale_events", "last_event"), "version").alias("s"))
    return best.select("job_id", "s.run_number", "s.stale_events", "s.events", "s.last_event")


def terminal_runs(runs: DataFrame) -> DataFrame:
    """The runs of a stream that are over: what a waiting caller is told."""
    return runs.where(F.col("status").isin("SUCCEEDED", "COMPLETED_WITH_ERRORS", "CANCELED")).select("id", "status")


def drain_terminal_runs(runs: DataFrame) -> DataFrame:
    """Runs that change feed over all runs there are."""
    spark = runs.sparkSession
    source, sink, checkpoint = (shared_path(spark, x) for x in ("runs", "terminal", "stream"))
    runs.select("id", "status").write.parquet(source)
    stream = terminal_runs(spark.readStream.schema("id long, status string").parquet(source))
    stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id long, status string").parquet(sink)


def without_repeats(commands: DataFrame, within: str = "1 hour") -> DataFrame:
    """A stream of enqueue commands (job_type, organization_id, idempotency_key, at) without those that repeat a key within a time.

    It only spares work: keys stay unique for good by the join with the ledger, which has no end in time.
    """
    return commands.withWatermark("at", within).dropDuplicatesWithinWatermark(["job_type", "organization_id", "idempotency_key"])
