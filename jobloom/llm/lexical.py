"""Ranked lexical search: posting lists in blocks of variable size with score bounds, and exact search that skips blocks.

``index`` cuts the documents into shards of bounded size as tasks read them, and writes each shard's inverted
lists: document numbers, each posting's weight before the term's own, and blocks. Dynamic programming chooses the ends of a
list's blocks so that the sum of (block's maximum - posting) and a price for each block is least. ``search`` reads only lists of terms
that items have; in each shard it bounds all stretches between block ends by the sum of the blocks' maxima, scores
the most promising ones first, and skips every stretch whose bound is under the k-th best score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import LOWER, stored

#: Bytes that no term has become spaces, A-Z a-z; digits, letters and all bytes of other characters stay.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).translate(LOWER)
#: Postings between possible ends of blocks, most of these in a block, and what a block costs in units of a list's mean weight.
STEP, LONGEST, PRICE = 16, 16, 12.0
#: A shard's documents (their numbers fit 16 bits) and words, at most, but for one document alone.
SHARD_DOCS, SHARD_WORDS = 1 << 14, 1 << 22
ITEMS_AT_ONCE = 256

LISTS = "shard long, term binary, df long, docs binary, weights binary, block_ends binary, block_tops binary"
Lists = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: what lies between ASCII characters that are neither letters nor digits, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split()


def _texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def corpus_size(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and all terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for text in batch.column("text"):
                size = len(terms_of(text.as_py()))
                n, total = n + (size > 0), total + size
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    row = _texts(docs, id_col, text_col).select("text").mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def part_of_score(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A posting's score for a term of weight 1, in whole numbers."""
    m = 75 + (25 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def blocks(lists: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ends and the maxima of each list's blocks.

    A block ends after a multiple of ``STEP`` postings or at the list's end, and has at most ``LONGEST`` steps. Among these, the least
    sum over blocks of size * maximum - sum of postings, plus ``PRICE`` times the list's mean a block, is found for all lists at
    once: best[j] = min over i of best[i] + cost(i, j).
    """
    sizes = np.array([len(x) for x in lists], np.int64)
    order = np.argsort(-sizes, kind="stable")
    found: list = [None] * len(lists)
    done = 0
    while done < len(lists):  # lists of about the same length together, in tables of at most 2^19 cells or of one list
        part = order[done : done + max(1, (1 << 19) // (int(sizes[order[done]]) // STEP + 2))]
        for n, one in zip(part.tolist(), _blocks([lists[n] for n in part]), strict=True):
            found[n] = one
        done += len(part)
    return found


def _blocks(lists: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``blocks`` of lists that become shorter."""
    sizes = np.array([len(x) for x in lists])
    steps = -(-sizes // STEP)
    most = int(steps.max())
    tops, totals = np.zeros((len(lists), most)), np.zeros((len(lists), most + 1))
    price = np.empty(len(lists))
    for k, x in enumerate(lists):
        at = np.arange(0, len(x), STEP)
        tops[k, : len(at)] = np.maximum.reduceat(x, at)
        totals[k, 1 : len(at) + 1] = np.cumsum(np.add.reduceat(x, at))
        price[k] = PRICE * x.mean()
    ends = np.minimum(np.arange(most + 1) * STEP, sizes[:, None])
    best, back = np.zeros((len(lists), most + 1)), np.zeros((len(lists), most + 1), np.int32)
    alive = np.searchsorted(-steps, -np.arange(1, most + 1), side="right")  # how many have a step j
    for j in range(1, most + 1):
        n, first = int(alive[j - 1]), max(0, j - LONGEST)
        top = np.maximum.accumulate(tops[:n, first:j][:, ::-1], axis=1)[:, ::-1]  # of steps i..j
        cost = best[:n, first:j] + top * (ends[:n, j : j + 1] - ends[:n, first:j]) - (totals[:n, j : j + 1] - totals[:n, first:j]) + price[:n, None]
        pick = cost.argmin(axis=1)
        back[:n, j] = first + pick
        best[:n, j] = cost[np.arange(n), pick]
    found = []
    for k, x in enumerate(lists):
        cuts = [int(steps[k])]
        while cuts[-1]:
            cuts.append(int(back[k, cuts[-1]]))
        bounds = ends[k, cuts[::-1]]
        found.append((bounds[1:].astype(np.int32), np.maximum.reduceat(x, bounds[:-1])))
    return found


def index(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted lists of ``docs``, stored: (shard, term, df, docs, weights, block_ends, block_tops).

    Each shard has one row more without a term, whose ``docs`` is its documents' ids as 64-bit integers, in the order that its postings count them by
    (ascending, nulls last as the largest value); documents without a term are in no shard.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        held, names, words = [], _Numbers(), 0
        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                if held and (len(held) == SHARD_DOCS or words + len(terms) > SHARD_WORDS):
                    yield from _shard_rows(shard, held, names, n_docs, n_terms)
                    held, names, words, shard = [], _Numbers(), 0, shard + 1
                distinct, tf = np.unique(np.fromiter(map(names.__getitem__, terms), np.int32, len(terms)), return_counts=True)
                held.append((_NULL if key.as_py() is None else key.as_py(), len(terms), distinct, tf.astype(np.int32)))
                words += len(terms)
        if held:
            yield from _shard_rows(shard, held, names, n_docs, n_terms)

    return stored(_texts(docs, id_col, text_col).mapInArrow(build, LISTS))


_NULL = (1 << 63) - 1


class _Numbers(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def _shard_rows(shard: int, held: list[tuple[int, int, np.ndarray, np.ndarray]], names: dict[bytes, int], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard's lists, from its documents' id, length, different terms and their occurrences."""
    held = sorted(held, key=lambda d: d[0])
    pairs = np.concatenate([(distinct.astype(np.int64) << 16) | n for n, (_, _, distinct, _) in enumerate(held)])
    order = np.argsort(pairs, kind="stable")
    pairs, tf = pairs[order], np.concatenate([d[3] for d in held])[order].astype(np.int64)
    of, doc = pairs >> 16, pairs & 0xFFFF
    weights = part_of_score(tf, np.array([d[1] for d in held], np.int64)[doc], n_docs, n_terms)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    ends = np.append(starts[1:], len(of))
    yield pa.RecordBatch.from_pydict({"shard": [shard], "term": [None], "df": [len(held)], "docs": [np.array([d[0] for d in held], np.int64).tobytes()], "weights": [None], "block_ends": [None], "block_tops": [None]}, schema=_LISTS)
    long_ones = np.flatnonzero(ends - starts > STEP)
    cut = blocks([weights[starts[k] : ends[k]] for k in long_ones])
    n_blocks = np.ones(len(starts), np.int64)  # a short list is one block
    n_blocks[long_ones] = [len(at) for at, _ in cut]
    firsts = np.concatenate(([0], np.cumsum(n_blocks)))
    block_ends, block_tops = np.repeat(ends - starts, n_blocks).astype(np.int32), np.repeat(np.maximum.reduceat(weights, starts), n_blocks).astype(np.int32)
    for k, (at, tops) in zip(long_ones.tolist(), cut, strict=True):
        block_ends[firsts[k] : firsts[k + 1]], block_tops[firsts[k] : firsts[k + 1]] = at, tops
    bounds = np.append(starts, len(of))
    columns = [
        pa.array(np.full(len(starts), shard, np.int64)), pa.array(list(names), pa.binary()), pa.array((ends - starts).astype(np.int64)), _slices(doc.astype(np.uint16), bounds),
        _slices(weights.astype(np.int32), bounds), _slices(block_ends, firsts), _slices(block_tops, firsts),
    ]
    lists = pa.RecordBatch.from_arrays(columns, schema=_LISTS)
    for first in range(0, len(starts), 1 << 14):
        yield lists.slice(first, 1 << 14)


def _slices(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """``values`` as bytes, cut at ``bounds``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


_LISTS = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("docs", pa.binary()), ("weights", pa.binary()), ("block_ends", pa.binary()), ("block_tops", pa.binary())])


def top_documents(query: list[tuple[int, Lists]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best documents of a shard (numbers, scores above 0), equal ones by number: for a query's lists with their factors.

    Stretches between the ends of all lists' blocks are bounded by the sum of the blocks' maxima; the best bounded are scored first,
    in growing groups, until no other stretch's bound reaches the k-th best score.
    """
    lasts = [x[1][x[3] - 1].astype(np.int64) for _, x in query]  # the last document of each block
    edges = np.unique(np.concatenate([*(a + 1 for a in lasts), *(x[1][np.concatenate(([0], x[3][:-1]))].astype(np.int64) for _, x in query)]))
    if len(edges) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bound = np.zeros(len(edges) - 1, np.int64)
    for (factor, x), last in zip(query, lasts, strict=True):
        at = np.searchsorted(last, edges[:-1])  # the block that may hold a stretch's documents: the first that ends there or later
        firsts = x[1][np.concatenate(([0], x[3][:-1]))].astype(np.int64)
        inside = at < len(last)
        inside[inside] = firsts[at[inside]] < edges[1:][inside]
        bound[inside] += factor * x[4][at[inside]].astype(np.int64)
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    docs = scores = np.zeros(0, np.int64)
    done, group = 0, 32
    while done < len(order) and (len(scores) < k or bound[order[done]] >= scores[-1]):
        now = np.sort(order[done : done + group])
        if len(scores) == k:
            now = now[bound[now] >= scores[-1]]
        done, group = done + group, group * 2
        total = np.zeros(n_docs, np.int64)
        for factor, x in query:
            low, high = np.searchsorted(x[1], edges[now]), np.searchsorted(x[1], edges[now + 1])
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())  # its postings in these stretches alone
            total[x[1][at]] += factor * x[2][at].astype(np.int64)  # a list has a document once
        new = np.flatnonzero(total)
        docs, scores = np.concatenate((docs, new)), np.concatenate((scores, total[new]))
        best = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[best], scores[best]
    return docs, scores


def search(lists: DataFrame, items: DataFrame, n_docs: int, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each row of ``items``: item, rank (from 1), doc_id, score above 0; equal scores by ascending id.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), df being its lists' lengths over all shards. Items go in blocks of
    ``ITEMS_AT_ONCE``, and each shard meets each block once with the lists of the block's terms alone. Items that share an id are items of their own.
    """
    item_type = items.schema[id_col].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            terms = [terms_of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(range(place, place + len(terms)), pa.int64()), pa.array(terms, pa.list_(pa.binary()))], ["item", "row", "terms"])
            place += len(terms)

    asked = stored(_texts(items, id_col, text_col).mapInArrow(parsed, f"item {item_type}, row long, terms array<binary>").where(F.size("terms") > 0))
    n_blocks = -(-asked.count() // ITEMS_AT_ONCE)
    block = F.pmod(F.xxhash64("row"), F.lit(max(1, n_blocks))).cast("int")
    used = asked.select(block.alias("block"), F.explode("terms").alias("term")).distinct()
    frequency = lists.join(used.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = (2.0 * F.lit(n_docs) + 2.0) / (2.0 * F.col("df") + 1.0)
    weighted = stored(used.join(frequency.select("term", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("weight")), "term"))

    columns = ["block", "shard", "term", "weight", "docs", "weights", "block_ends", "block_tops"]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    ids = lists.where("term IS NULL")
    numbers = F.sequence(F.lit(0), F.lit(max(1, n_blocks) - 1))
    found = lists.join(weighted, "term").select(*columns)
    heads = ids.select(F.explode(numbers).alias("block"), "shard", none("binary", "term"), none("bigint", "weight"), "docs", "weights", "block_ends", "block_tops")
    packed = asked.select(block.alias("block"), F.struct("row", "terms").alias("item")).groupBy("block").agg(F.collect_list("item").alias("items"))  # about ITEMS_AT_ONCE
    heads = heads.join(packed, "block")
    rows = found.withColumn("items", F.lit(None).cast(packed.schema["items"].dataType)).unionByName(heads)

    def best(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        asked_here = next(x for x in frame["items"] if x is not None)
        doc_ids, known = np.zeros(0, np.int64), {}
        for term, weight, docs, weights, ends, tops in zip(*(frame[c] for c in columns[2:]), strict=True):
            if term is None:
                doc_ids = np.frombuffer(docs, np.int64)
            elif weight > 0:
                known[bytes(term)] = (int(weight), np.frombuffer(docs, np.uint16), np.frombuffer(weights, np.int32), np.frombuffer(ends, np.int32), np.frombuffer(tops, np.int32))
        out = []
        for item in asked_here:
            factors: dict[bytes, int] = {}
            for t in map(bytes, item["terms"]):
                if t in known:
                    factors[t] = factors.get(t, 0) + known[t][0]
            if factors:
                docs, scores = top_documents([(f, known[t]) for t, f in factors.items()], len(doc_ids), k)
                out.append(pd.DataFrame({"row": item["row"], "doc": doc_ids[docs], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "doc": [], "score": []}).astype("int64")

    candidates = rows.groupBy("block", "shard").applyInPandas(best, "row long, doc long, score long")
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "doc"))
    ranked = candidates.withColumn("rank", nth).where(F.col("rank") <= k)  # a task cuts what it has to k an item before the shuffle
    doc = F.when(F.col("doc") != _NULL, F.col("doc"))
    return ranked.join(asked.select("row", "item"), "row").select(F.col("item").alias(id_col), "rank", doc.alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``search`` over an index of ``docs`` (doc_id, text) for ``items`` (item_id, text): item_id, rank, doc_id, score.

    Null, empty texts and those without a term match nothing; repeated rows are ranked each; an empty table on either side gives no rows.
    """
    n_docs, n_terms = corpus_size(docs)
    return search(index(docs, n_docs, max(n_terms, 1)), items, n_docs, k)
