"""Periodic runs: stretches of words that repeat at a period, found by a suffix automaton.

A run is a stretch with smallest period q and at least max(``least``, 2 q) words that no neighbouring word
extends at that period. Each document's words make an automaton of all their stretches; the end
positions of its states are ordered sets, merged from the longest states to the shorter ones, the smaller set into the
larger. Two ends that become neighbours at a distance that the state's length reaches are a square, which is extended to its run.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Run = tuple[int, int, int]
#: Odd factors of the hash of a few words that follow one another.
_FACTORS = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def periodic_runs(docs: DataFrame, key: Column | None = None, words_of: Callable[[bytes, int], list[bytes]] | None = None, least: int = 12) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``runs``, an array of (start, length, period) by start and period, and ``collapsed``.

    Words are what ASCII white space parts; ``words_of`` may make others from the text's bytes and the row's
    ``key`` (a long). ``collapsed`` is the text without the words that a run has after its first period, joined by
    one space. A null, empty or blank text has no words, no runs and an empty ``collapsed``; every row gives
    one row, repeated ones too, whatever its id; other columns are left out. A document is worked on in memory that grows with its own words alone.
    """
    rows = docs.select("doc_id", (key if key is not None else F.lit(0)).cast("long").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for first in range(0, batch.num_rows, 256):  # so that what is made stays as small as a few documents
                found, texts = [], []
                for k, text in zip(keys[first : first + 256], batch.column("text").slice(first, 256), strict=False):
                    words = text.as_py().split() if words_of is None else words_of(text.as_py(), k)
                    runs = runs_of(words, least)
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    texts.append(b" ".join(without_repeats(words, runs)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, 256), pa.array(found, _RUNS), pa.array(texts, pa.binary())], ["doc_id", "runs", "collapsed"]
                )

    made = rows.mapInArrow(work, f"doc_id {id_type}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` but for those that a run has after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def runs_of(words: list[bytes], least: int = 12) -> list[Run]:
    """All runs (start, length, period) of a list of words, by start and period."""
    if len(words) < least:
        return []
    ids: dict[bytes, int] = {}
    numbers = np.fromiter(map(ids.setdefault, words, count()), np.int64, len(words))
    found = [(start + s, n, q) for start, end in _repetitive(numbers, least) for s, n, q in _runs(numbers[start:end].tolist(), least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _repetitive(numbers: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches (start, end) outside which there is no run, most often none.

    In a run of n words at period q, the first n - q and the last n - q words are equal and together all of it, and n - q
    is at least half of ``least``: each word is in a short sequence that the same stretch has twice. Stretches of such words are cut
    again until they stay as they are. Hashes of sequences decide, so a collision only keeps a stretch longer.
    """
    width = (least + 1) // 2
    done, todo = [], [(0, len(numbers))]
    while todo:
        start, end = todo.pop()
        n = end - start - width + 1
        mixed = numbers[start:end].astype(np.uint64)
        mixed = (mixed + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        hashes = np.zeros(n, np.uint64)
        for k in range(width):
            hashes += mixed[k : k + n] * _FACTORS[k % 64]
        order = np.sort(hashes)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            continue
        at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
        edge = np.zeros(end - start + 1, np.int64)
        begins = np.flatnonzero(twice[at] == hashes)
        edge[begins] += 1
        edge[begins + width] -= 1
        inside = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
        steps = np.flatnonzero(np.diff(inside))
        for a, b in zip(steps[::2].tolist(), steps[1::2].tolist(), strict=True):
            if b - a == end - start:
                done.append((start, end))
            elif b - a >= least:
                todo.append((start + a, start + b))
    return done


def _automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of ``word``: by state its length, its suffix link, and the end of the prefix it is (-1: none)."""
    length, link, end = [0], [-1], [-1]
    key, to = [-1], [0]  # each state's first transition; the others, if any, are in ``more``
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(word):
        now = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        key.append(-1)
        to.append(0)
        p, q = last, -1
        while p >= 0:
            if key[p] == c:
                q = to[p]
                break
            if key[p] < 0:
                key[p], to[p] = c, now
            elif p not in more:
                more[p] = {c: now}
            elif c in more[p]:
                q = more[p][c]
                break
            else:
                more[p][c] = now
            p = link[p]
        last = now
        if q < 0:
            continue
        if length[p] + 1 == length[q]:
            link[now] = q
            continue
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        end.append(-1)
        key.append(key[q])
        to.append(to[q])
        if q in more:
            more[copy] = dict(more[q])
        while p >= 0:
            if key[p] == c:
                if to[p] != q:
                    break
                to[p] = copy
            elif p in more and more[p].get(c) == q:
                more[p][c] = copy
            else:
                break
            p = link[p]
        link[now] = link[q] = copy
    return length, link, end


def _runs(word: list[int], least: int) -> list[Run]:
    """All runs of ``word``.

    Sets hold negated ends, so that in a periodic text, whose ends come in falling order, each new one goes last.
    """
    length, link, end = _automaton(word)
    n = len(word)
    sets: list[list[int] | None] = [None if e < 0 else [-e] for e in end]
    known: dict[int, list[tuple[int, int]]] = {}  # by period: runs (start, end) found so far, in order

    def square(left: int, period: int, reach: int) -> None:
        """Extends the two ends ``left`` and ``left + period`` with ``reach`` equal words before each."""
        have = known.get(period)
        if have is None:
            have = known[period] = []
        at = bisect_right(have, (left - period + 1, n)) - 1
        if at >= 0 and have[at][1] > left + period:
            return
        start, stop = left - reach + 1, left + period + 1
        while start and word[start - 1] == word[start - 1 + period]:
            start -= 1
        while stop < n and word[stop] == word[stop - period]:
            stop += 1
        insort(have, (start, stop))

    for v in np.argsort(-np.array(length), kind="stable").tolist():
        u = link[v]
        if u <= 0:
            sets[v] = None
            continue
        reach, few, many = length[u], sets[v], sets[u]
        sets[v] = None
        if many is None:
            sets[u] = few
            continue
        if len(few) > len(many):
            few, many = many, few
        for x in few:
            k = bisect_left(many, x)
            if k and x - many[k - 1] <= reach:
                square(-x, x - many[k - 1], reach)
            if k < len(many):
                if many[k] - x <= reach:
                    square(-many[k], many[k] - x, reach)
                many.insert(k, x)
            else:
                many.append(x)
        sets[u] = many
    shortest: dict[tuple[int, int], int] = {}
    for period in sorted(known, reverse=True):
        for run in known[period]:
            if run[1] - run[0] >= least:
                shortest[run] = period
    return [(start, stop - start, period) for (start, stop), period in shortest.items()]
