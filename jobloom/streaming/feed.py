"""Streams into a ledger that lasts, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from jobloom.operators.changes import Change
from jobloom.sources.store import LedgerStore

Decide = Callable[[DataFrame, dict[str, DataFrame]], Change]


def write_batches(stream: DataFrame, store: LedgerStore, decide: Decide, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Starts a stream of commands whose every batch becomes one batch of the ledger: ``decide`` gives its change from the batch and the snapshot before it.

    The ledger's manifest keeps the number of the last batch that it has, in the same rename that makes its rows visible. A batch that a restarted stream
    runs again is left out there, so each takes effect once, wherever the writer was killed. Batches are numbered by the stream's checkpoint: a ledger
    belongs to one checkpoint. As ``decide`` sees the whole snapshot, keys are unique for good, not for a time of the stream.
    """

    def write(batch: DataFrame, number: int) -> None:
        if store.manifest()["batch"] <= number:
            store.apply(number + 1, decide(batch, store.read()))

    started = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if available_now else started).start()


def changes_since(store: LedgerStore, table: str, version: int, columns: list[str]) -> DataFrame:
    """Rows of a keyed table whose ``columns`` differ from a version's, as they are now; new rows too. Only buckets that were written since are read.

    A reader that keeps the version it has seen gets each change once.
    """
    then, now = store.manifest(version)["tables"][table], store.manifest()["tables"][table]
    moved = [b for b, p in now["buckets"].items() if then["buckets"].get(b) != p]
    after = store._frame(now["schema"], [now["buckets"][b] for b in moved]).select(*columns)
    before = store._frame(then["schema"], [then["buckets"][b] for b in moved if b in then["buckets"]]).select(*columns)
    return after.exceptAll(before)
