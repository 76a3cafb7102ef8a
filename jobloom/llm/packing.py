"""Packing of documents into fixed-length token sequences.

Shortest-pack-first over the length histogram: only the histogram of piece lengths (at most
``capacity`` rows) comes to the driver. Lengths are placed longest first, each into the packs
that hold least so far, many at once; that gives packing patterns with counts. Pieces get a
rank among those of their length, and a join with the pattern table turns rank into sequence
and offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import stored, text_of
from jobloom.llm.tokens import default_path, encoder

PIECE = "id {}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocab: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document's ids: ``capacity`` ids each, and what is left at its end."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocab)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("row", "start", "length", "crc", "total")}
            whole, counts = codec.column(batch.column(1), end_id)
            for k, (end, n) in enumerate(zip(np.cumsum(counts).tolist(), counts.tolist())):
                ids = whole[end - n : end].astype("<u4", copy=False)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    for name, value in zip(rows, (k, start, len(piece), zlib.crc32(piece), len(ids))):
                        rows[name].append(value)
            own = batch.column(0).take(pa.array(rows["row"], pa.int64()))
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([own, *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc", "total"))], names)

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(cut, PIECE.format(kind))


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first on a histogram: (how many packs, their runs of (length, times)).

    Each length splits at most one group of equal packs and opens at most one, so there are
    at most two groups a length; a pack has fewer than sqrt(2 * capacity) different lengths.
    """
    room: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    top = 0  # no group has more room than this
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[int, int, list[tuple[int, int]]]] = []
        while left:
            while top and not room[top]:
                top -= 1
            if top < length:
                # open as many packs as the rest needs, filled evenly
                each = capacity // length
                packs = -(-left // each)
                more = left - packs * (left // packs)
                for count, times in ((more, left // packs + 1), (packs - more, left // packs)):
                    if count:
                        placed.append((capacity - times * length, count, [(length, times)]))
                break
            count, pack = room[top].pop()
            each = min(top // length, max(1, left // count))
            used = min(count, left // each)
            if used < count:
                room[top].append((count - used, pack))
            placed.append((top - each * length, used, [*pack, (length, each)]))
            left -= used * each
        for space, count, pack in placed:
            room[space].append((count, pack))
            top = max(top, space)
    return [group for groups in room for group in groups]


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, times) for each run of each pattern."""
    rows, taken, sequence = [], {}, 0
    for count, pack in found:
        offset = 0
        for length, times in pack:
            low = taken.get(length, 0)
            taken[length] = low + count * times
            rows.append((length, low, taken[length], sequence, offset, times))
            offset += length * times
        sequence += count
    return rows


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text", rows_a_block: int = 50_000) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    A document is the ids of its text and then ``end_id``; one of more than ``capacity`` ids
    is cut into pieces of that many. Returns per piece: id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset. Null text is empty: one piece of one id. Rows that
    share an id are documents of their own; a null id is kept. An empty table gives an empty
    result; other columns are ignored.

    Texts are encoded once; the pieces' figures (not their ids) are stored in the shared
    folder. A rank counts within blocks of about ``rows_a_block`` pieces, so a length that
    most pieces have isn't one task's work.
    """
    spark = docs.sparkSession
    table = stored(pieces(docs, vocab or default_path(), capacity, end_id, id_col, text_col))
    counts = {r[0]: r[1] for r in table.groupBy("length").count().collect()}  # at most `capacity` rows
    found = slots(patterns(counts, capacity))
    blocks = max(64, -(-sum(counts.values()) // rows_a_block))
    plan = spark.createDataFrame(found, "length long, low long, high long, sequence long, at long, times long")
    dealt = table.withColumn("block", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(blocks)))
    before = (
        dealt.groupBy("length", "block").count()
        .select("length", "block", (F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count")).alias("before"))
    )
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("inside"))
    # at most 2 * capacity patterns of fewer than sqrt(2 * capacity) runs, whatever the input
    plan = F.broadcast(plan.withColumnRenamed("length", "of"))
    nth = F.col("rank") - F.col("low")
    return ranked.join(plan, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("times")) * F.col("length")).alias("offset"),
    )
