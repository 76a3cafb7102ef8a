"""Token-id files: fixed-size blocks of ids as byte or bit planes, each compressed.

A file is a Parquet table of chunks, so that Spark's committers write it and any store
holds it. A chunk has the ids of whole documents. They are cut into blocks of ``block`` ids
(the last one filled with zeros); each block is transposed, so that the k-th plane of a
chunk has the k-th byte (or bit) of every id; each plane is a zstandard frame. The chunk's other columns are the chunk
index: shard, number in the shard, ids before it in the shard, ids, documents. Reading only
these columns reads no plane.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.llm.common import text_of
from jobloom.llm.tokens import default_path, encoder

CHUNK = "shard int, chunk int, at long, n_ids long, n_docs long, kind string, block int, doc_ids array<{}>, doc_lengths array<long>, planes array<binary>"
ID_BYTES = 4


def shuffled(ids: np.ndarray, block: int, kind: str = "byte", level: int = 3) -> list[bytes]:
    """The compressed planes of ``ids``."""
    padded = np.zeros(-(-len(ids) // block) * block, "<u4")
    padded[: len(ids)] = ids
    cells = padded.view(np.uint8).reshape(-1, block, ID_BYTES)
    if kind == "bit":
        cells = np.unpackbits(cells, axis=2, bitorder="little")
    planes = cells.transpose(2, 0, 1)
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack((np.packbits(p, axis=1, bitorder="little") if kind == "bit" else np.ascontiguousarray(p)).tobytes()) for p in planes]


def unshuffled(planes: list[bytes], n_ids: int, block: int, kind: str = "byte") -> np.ndarray:
    """The ids from their compressed planes."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes]) if n_ids else np.zeros((len(planes), 0), np.uint8)
    if kind == "bit":
        bits = np.unpackbits(rows.reshape(len(planes), -1, -(-block // 8)), axis=2, bitorder="little")[:, :, :block]
        cells = np.packbits(bits.reshape(len(planes), -1).T, axis=1, bitorder="little")
    else:
        cells = rows.T
    return np.ascontiguousarray(cells).view("<u4").ravel()[:n_ids]


def write_ids(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", kind: str = "byte", block: int = 4096, chunk_ids: int = 1 << 16) -> None:
    """Encodes all texts and writes their ids to ``path`` in ascending id order.

    Null text is empty and has ``end_id`` alone. A null id sorts first; rows that share an
    id follow one another, ordered by text. An empty table writes an empty file. Ids must fit 32 bits.
    """
    vocab = vocab or default_path()
    if block % 8:
        raise ValueError("block must be a multiple of 8")
    id_kind = docs.schema[id_col].dataType.simpleString()
    schema = CHUNK.format(id_kind)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, shard = encoder(vocab), TaskContext.get().partitionId()
        names = [x.split()[0] for x in schema.split(", ")]
        own, lengths, held, n_held, at, number, id_type = [], [], [], 0, 0, 0, None

        def done() -> pa.RecordBatch:
            ids = np.concatenate(held)
            cells = [shard, number, at, len(ids), len(own), kind, block, own, lengths, shuffled(ids, block, kind)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names)

        for batch in batches:
            id_type = batch.column(0).type
            ids, counts = codec.column(batch.column(1), end_id)
            for doc, end, n in zip(batch.column(0).to_pylist(), np.cumsum(counts).tolist(), counts.tolist()):
                own.append(doc)
                lengths.append(n)
                held.append(ids[end - n : end])
                n_held += n
                if n_held >= chunk_ids:
                    yield done()
                    at, number = at + n_held, number + 1
                    own, lengths, held, n_held = [], [], [], 0
        if own:
            yield done()

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # by the text's beginning too, so that rows that share an id, or have none, are spread
    ordered = rows.repartitionByRange(F.col("id"), F.substring("text", 1, 64)).sortWithinPartitions("id", "text")
    ordered.mapInArrow(chunks, schema).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """A row per document of a file: id, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    ``ids`` are little-endian unsigned 32-bit integers. Each chunk is decoded on its own;
    only the number of ids in each shard, a row per write task, is gathered.
    """
    table = spark.read.parquet(path)
    totals = table.groupBy("shard").agg(F.sum("n_ids").alias("in_shard"))
    starts = totals.select("shard", (F.sum("in_shard").over(Window.orderBy("shard")) - F.col("in_shard")).alias("shard_at"))
    id_kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"{id_col} {id_kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row: Callable = lambda name: batch.column(batch.schema.get_field_index(name))[k].as_py()
                lengths = np.asarray(row("doc_lengths"), np.int64)
                ends = np.cumsum(lengths)
                data = unshuffled(row("planes"), row("n_ids"), row("block"), row("kind")).tobytes()
                own = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                first = row("at") + row("shard_at")
                columns = [batch.column(batch.schema.get_field_index("doc_ids"))[k].values, pa.array(first + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, [x.split()[0] for x in schema.split(", ")])

    return table.join(F.broadcast(starts), "shard").mapInArrow(decode, schema)
