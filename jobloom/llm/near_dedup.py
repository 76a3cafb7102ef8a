"""MinHash near-duplicate detection by bottom-k sketches from one hash function.

A document's word shingles are hashed by one function; the ``k`` smallest values are its
sketch. Documents with equal sets are one class from the start. Inverted lists of retained
values generate overlaps: a class is listed under each three values that follow one another in
its sketch. Two sets at the threshold share four fifths of the smallest values of their union, and
but for a chance of about 2e-8 three of the first 50 in a row, which then follow one another
in both sketches. Common shingles alone bring no two documents together: their
values hardly ever meet without another one between. All parts of lists with the same largest member
are one cluster, in which every linked pair meets. There, sketches filter; exact Jaccard on
the full shingle sets of the texts verifies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import LOWER, among, discard, stored, text_of, with_values
from jobloom.llm.components import components

#: Values of a sketch that runs are taken from, and how many make a run.
LISTED, RUN = 50, 3
#: Bits of the filters that keep lists of two, and documents without a partner, out of shuffles: 8 MB.
FILTER_BITS = 1 << 26

_words: dict[bytes, int] = {}


def words_of(text: str) -> list[bytes]:
    """The words of a text after lower-casing A-Z; white space is space and tab to carriage return."""
    return text.encode().translate(LOWER).split()


def shingle_set(text: str, size: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text; with fewer words, the whole sequence as one; without words, none."""
    words = words_of(text)
    return set(zip(*(words[i:] for i in range(min(size, len(words)))))) if words else set()


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64)
    known = _words
    if len(known) > 500_000:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh3_64_intdigest(word)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    mixed = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ h[i : len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(id, key, n, set, sketch) of each (id, key, text): set is a 128-bit digest of all hashes, sketch the k smallest, eight bytes each."""
    kind = docs.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(text, size) for text in batch.column(2).to_pylist()]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([s[:k].tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n", "set", "sketch"])

    return docs.mapInArrow(sketch, f"id {kind}, key binary, n long, set binary, sketch binary")


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of sketches, and how many each sketch has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.int64), np.array([len(x) // 8 for x in parts], np.int64)


def _rank(counts: np.ndarray) -> np.ndarray:
    """Places within parts of so many entries each: 0, 1, ... for each part."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def runs(values: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each ``length`` values in a row of sketches that have so many values each, and the sketch it is of."""
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(counts, counts) - _rank(counts)
    starts = np.flatnonzero(left >= length)
    mixed = np.full(len(starts), length, np.uint64)
    for i in range(length):
        mixed = (mixed ^ values[starts + i].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64), owner[starts]


def _listed(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, short, own): the runs of its ``k`` smallest values under which a class (n, short, sketch) is listed.

    Runs have ``RUN`` values. A union of up to five shingles may have none of these in common, so sets of up to five
    have their single values too, as have all sets under a lower threshold than 80 percent. ``own`` is the class of size.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, short = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values, counts = _values(batch.column(2))
            values, counts = values[_rank(counts) < k], np.minimum(counts, k)
            single = (n <= 5) | (percent < 80)
            ones = np.repeat(single, counts)
            few = np.flatnonzero(single)
            keys, of = runs(values, counts, RUN)
            alone, alone_of = runs(values[ones], counts[few], 1)
            of = np.concatenate([of, few[alone_of]])
            own = (np.log(np.maximum(n, 1)) / np.log(100.01 / percent)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys, alone])), pa.array(short[of]), pa.array(own[of])], ["key", "short", "own"])

    return classes.select("n", "short", "sketch").mapInArrow(deal, "key long, short long, own int")


def _clusters(listed: DataFrame) -> DataFrame:
    """(centre, short): of each list of two or more, its members under its largest one.

    A list of more than two is split by size: a set stands in the part of its own class of size and in that of the
    next, so any two whose sizes allow a link stand in one part together.
    """
    lists = stored(listed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("short").alias("centre"), F.min("short").alias("low")).where("members > 1"))
    two = lists.where("members = 2").select("centre", F.explode(F.array("centre", "low")).alias("short"))
    longer = lists.where("members > 2").select("key", "members")
    kept = stored(with_values(among(listed, longer, "key", FILTER_BITS), longer, "key", "members"))
    own = F.col("own")
    parts = kept.withColumn("part", F.explode(F.array(own, own + 1))).select(F.xxhash64("key", "part").alias("list"), "short")
    several = stored(parts.groupBy("list").agg(F.count(F.lit(1)).alias("members"), F.max("short").alias("centre")).where("members > 1"))
    clusters = stored(with_values(parts, several, "list", "members").select("centre", "short").unionByName(two).distinct())
    discard(lists, kept, several)
    return clusters


def _weigh(rows: DataFrame, members: int, shingles: int, *by: str) -> DataFrame:
    """How many rows each group has, and how many blocks of ``members`` sets or ``shingles`` shingles they make; of these, those that no leader has joined (``rest``), and the others (``tied``)."""
    blocks = lambda some: F.ceil(F.greatest(F.count_if(some) / members, F.sum(F.when(some, F.col("n")).otherwise(0)) / shingles)).cast("int")
    tied = F.col("joined") if "joined" in rows.columns else F.lit(False)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), blocks(F.lit(True)).alias("blocks"), blocks(~tied).alias("rest"), blocks(tied).alias("tied"))


def _led(large: DataFrame, keyed: DataFrame, size: int, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of large clusters' members (centre, short, set, of, at, n, cells, blocks) with their centre, and the members (centre, short) that have one. Both are stored.

    Each block of members meets the centre alone, so a cluster costs as many rows as it has members and blocks.
    """
    lead = F.col("short") == F.col("centre")
    place = F.when(lead, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("short"), F.col("blocks")).cast("int")))
    dealt = large.select("centre", F.lit(-1).alias("part"), F.explode(place).alias("i"), F.lit(0).alias("j"), "short", "set", "of", "at", "n", "cells", lead.alias("joined"))
    near = stored(_promising(dealt, k, percent, led=True))
    links = stored(_links(_with_texts(keyed, near, "joined"), size, k, percent, led=True))
    ends = links.select(F.col("a").alias("set")).unionByName(links.select(F.col("b").alias("set"))).distinct()
    joined = stored(near.select("centre", "short", "set").distinct().join(ends, "set", "left_semi").select("centre", "short"))
    discard(near)
    return links, joined


def _with_texts(keyed: DataFrame, place: DataFrame, *more: str) -> DataFrame:
    """Rows of ``place`` with their texts, read only of documents that a filter of fixed size lets through."""
    texts = among(keyed, place.select(F.xxhash64("of", "at").alias("place")), "place", FILTER_BITS).join(place, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("at")))
    return texts.select(*GROUP, "set", "score", "text", *more)


def _spread(clusters: DataFrame, members: int, shingles: int, percent: int, lead: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows of clusters (centre, n, ...) dealt to groups (centre, part, i, j) of bounded size that together hold each pair that can tell more than ``lead`` does; and the links that it gave.

    Also the stored tables that this reads.

    Members of a cluster of more than ``members`` sets or ``shingles`` shingles first meet its centre. Those that are linked with it are connected, and needn't meet each
    other. The cluster is split by size: a set stands in the part of its own class of size and in that of the next, so any two whose sizes
    allow a link stand in one part together. A part is cut into blocks of those that are connected and of the rest, and each block of the
    rest makes a group with each other block. So a family of near copies is dealt about as many rows as it has members.
    """
    sizes = stored(_weigh(clusters, members, shingles, "centre"))
    sized = stored(with_values(clusters, sizes.select("centre", "rows", "blocks"), "centre", "rows"))
    discard(sizes)
    own = F.floor(F.log("n") / F.log(F.lit(100.01 / percent))).cast("int")
    whole = sized.where("blocks = 1").withColumns({"part": F.lit(0), "i": F.lit(0), "j": F.lit(0), "joined": F.lit(False)}).drop("blocks")
    links, joined = lead(sized.where("blocks > 1"))
    told = sized.where("blocks > 1").drop("blocks").join(joined.withColumn("joined", F.lit(True)), ["centre", "short"], "left").withColumn("joined", F.coalesce("joined", F.lit(False)))
    parts = stored(told.withColumn("part", F.explode(F.array(own, own + 1))).withColumn("both", F.xxhash64("centre", "part")))
    cut = stored(_weigh(parts, members, shingles, "both").where("rows > 1 AND rest > 0").select("both", "rows", "rest", "tied"))
    dealt = with_values(parts, cut, "both", "rows").drop("both")
    block = lambda n: F.pmod(F.xxhash64("short"), F.col(n)).cast("int")
    each = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    # groups of two blocks of the rest have j >= i >= 0; of a block of the rest and one of the connected, j < 0
    pair = F.when(F.col("joined"), F.transform(each("rest"), lambda r: F.struct(r.alias("i"), (-1 - block("tied")).alias("j")))).otherwise(
        F.concat(F.transform(each("rest"), lambda r: F.struct(F.least(block("rest"), r).alias("i"), F.greatest(block("rest"), r).alias("j"))), F.transform(each("tied"), lambda t: F.struct(block("rest").alias("i"), (-1 - t).alias("j"))))
    )
    blocks = dealt.withColumn("pair", F.explode(pair)).withColumns({"i": F.col("pair.i"), "j": F.col("pair.j")}).drop("pair", "rest", "tied")
    return whole.unionByName(blocks), links, [sized, joined, parts, cut]


GROUP = ("centre", "part", "i", "j")


def _promising(members: DataFrame, k: int, percent: int, led: bool = False) -> DataFrame:
    """(*GROUP, set, of, at, score): the rows of groups that some other row's sketch is alike; score: how many others. ``led``: only those of the rows ``joined`` count.

    Sketches are compared all at once, as counts of values in 2048 cells: values that fall
    together can only make two sketches more alike, so no link is lost. ``cells`` has two bytes a value.
    """

    def choose(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        first = group.column("joined").to_numpy(zero_copy_only=False) if led else None
        parts = group.column("cells").to_pylist()
        owner = np.repeat(np.arange(len(n)), [len(x) // 2 for x in parts])
        flat = owner * 2048 + np.frombuffer(b"".join(parts), np.uint16)
        cells = np.bincount(flat, minlength=len(n) * 2048).astype(np.float32).reshape(len(n), 2048)
        need = np.where(100 * n <= k * percent, -(-n * percent // 100), k // 2)
        by = np.argsort(n, kind="stable")
        n, need, cells = n[by], need[by], cells[by]
        score = np.zeros(len(n), np.int64)
        for at in range(0, len(n), 256):
            part = slice(at, min(at + 256, len(n)))
            near = slice(np.searchsorted(n, -(-n[at] * percent // 100)), np.searchsorted(n, n[part][-1] * 100 // percent, "right"))
            pairs = cells[part] @ cells[near].T >= np.minimum(need[part, None], need[near])
            pairs &= 100 * np.minimum(n[part, None], n[near]) >= percent * np.maximum(n[part, None], n[near])
            if led:
                pairs &= first[by[part]][:, None] | first[by[near]]
            score[by[part]] = pairs.sum(axis=1) - (first[by[part]] if led else 1)  # without itself
        return group.drop_columns(["cells", "n"]).append_column("score", pa.array(score)).filter(pa.array(score > 0))

    fields = members.drop("cells", "n").schema.add("score", "long")
    return members.groupBy(*GROUP).applyInArrow(choose, fields)


def _union_shared(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of the k smallest values of the union of ``one`` and each other sketch of k values are in both."""
    k = len(one)
    both = np.sort(np.concatenate([np.broadcast_to(one, others.shape), others], axis=1), axis=1)
    again = both[:, 1:] == both[:, :-1]
    distinct = np.arange(2, 2 * k + 1) - np.cumsum(again, axis=1)
    return (again & (distinct <= k)).sum(axis=1)


def spanning_links(sets: list[np.ndarray], order: list[int], k: int, percent: int, joined: np.ndarray | None = None, led: bool = False) -> list[tuple[int, int]]:
    """Links that connect what all links among ``sets`` (sorted hashes) connect, those that are ``joined`` being connected already; ``led``: only links with the first in order.

    Members take turns, in ``order``, to be compared with all later ones that aren't
    connected with them yet. A pair is passed over where its sizes, the triangle inequality
    of the Jaccard distance (to the first member, whose distances are all known), or the
    sketch of the union, of which both share less than half, rule a link out; else its
    intersection is counted.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    component = np.arange(m)
    if joined is not None and joined.any():
        component[joined] = np.flatnonzero(joined)[0]
    elements, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    sketch = np.stack([np.pad(s[:k], (0, max(0, k - len(s))), constant_values=-(2**63) + 1) for s in sets])
    far = None
    found = []

    def shared(p: int, rows: np.ndarray) -> np.ndarray:
        if len(rows) == m:
            some, of = elements, owner
        else:
            some = np.concatenate([sets[x] for x in rows])
            of = np.repeat(np.arange(len(rows)), sizes[rows])
        own = sets[p]
        at = np.minimum(np.searchsorted(own, some), len(own) - 1)
        return np.bincount(of, own[at] == some, len(rows)).astype(np.int64)

    for p in order[:1] if led else order:
        open_ = (component != component[p]) & (rank > rank[p]) & (100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p]))
        if far is not None:
            open_ &= np.abs(far - far[p]) <= 1 - percent / 100 + 1e-9
        rows = np.flatnonzero(open_) if far is not None else np.arange(m)
        if not len(rows):
            continue
        if far is not None and 100 * sizes[p] > k * percent:
            own = np.sort(sketch[p])
            at = np.minimum(np.searchsorted(own, sketch[rows]), k - 1)
            alike = (own[at] == sketch[rows]).sum(axis=1)
            rows = rows[(2 * alike >= k) | (100 * sizes[rows] <= k * percent)]
            if sizes[p] >= k:
                full = sizes[rows] >= k
                rows = np.concatenate([rows[~full], rows[full][2 * _union_shared(sketch[p], sketch[rows[full]]) >= k]])
            if not len(rows):
                continue
        common = shared(p, rows)
        union = sizes[rows] + sizes[p] - common
        if far is None:
            far = 1 - common / union
        near = (100 * common >= percent * union) & open_[rows]
        for x in rows[near].tolist():
            if component[x] != component[p]:
                found.append((x, p))
                component[component == component[x]] = component[p]
    return found


def _links(groups: DataFrame, size: int, k: int, percent: int, led: bool = False) -> DataFrame:
    """(a, b): links that connect each group (*GROUP, set, score, text, joined), confirmed on the shingles' words; stars about the least member.

    Members that are ``joined`` are connected already. ``led``: one is, the leader, and only links with it count.
    """

    def link(group: pa.Table) -> pa.Table:
        names, texts = group.column("set").to_pylist(), group.column("text").to_pylist()
        score = group.column("score").to_pylist()
        joined = group.column("joined").to_numpy(zero_copy_only=False)
        order = sorted(range(len(names)), key=lambda x: (led and not joined[x], -score[x], names[x]))
        if led and not joined.any():
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        pairs = spanning_links([shingle_hashes(t, size) for t in texts], order, k, percent, joined, led)
        words: dict[int, set] = {}
        top = list(range(len(names)))
        for a, b in pairs:
            if b not in words:
                words = {b: shingle_set(texts[b], size)}
            other = shingle_set(texts[a], size)
            common = len(words[b] & other)
            if 100 * common >= percent * (len(words[b]) + len(other) - common):
                low, high = sorted((_top(top, a), _top(top, b)), key=names.__getitem__)
                top[high] = low
        sure = [(names[x], names[y]) for x in range(len(names)) if (y := _top(top, x)) != x]
        return pa.table({"a": pa.array([a for a, _ in sure], pa.binary()), "b": pa.array([b for _, b in sure], pa.binary())})

    return groups.groupBy(*GROUP).applyInArrow(link, "a binary, b binary")


def _top(top: list[int], x: int) -> int:
    """The least member that ``x`` is connected with, the way there made short."""
    while top[x] != x:
        top[x] = top[top[x]]
        x = top[x]
    return x


def near_groups(docs: DataFrame, size: int = 2, percent: int = 80, k: int = 64, id_col: str = "doc_id", text_col: str = "text", members: int = 1024, shingles: int = 1_500_000) -> DataFrame:
    """Every row of ``docs`` with its group of near-duplicates.

    Documents are linked when 100 * intersection >= percent * union of their sets of word
    shingles; a group is what links connect. Returns one row per document row: id, n_shingles,
    component_id (the smallest id of its group), kept. Null text has no words; documents
    without words are linked with nothing and kept. Rows that share an id are documents of
    their own; a null id never wins over another one. An empty table gives an empty result. Other columns are ignored.

    ``members`` and ``shingles`` bound what one task holds at a time, not what is compared.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", F.unhex(F.md5("text")).alias("key"), "text")
    rows = stored(sketches(base, size, k))
    # classes: the row whose text stands for them, their smallest id, how many rows they have
    classes = stored(
        rows.where("n > 0").groupBy("set")
        .agg(F.min(F.struct("id", "key")).alias("first"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("short", F.xxhash64("set"))
    )
    clusters = _clusters(_listed(classes, min(k, LISTED), percent))
    met = clusters.join(_cells(classes), "short")
    keyed = base.withColumn("place", F.xxhash64("id", "key"))
    dealt, stars, read = _spread(met, members, shingles, percent, lambda large: _led(large, keyed, size, k, percent))
    place = stored(_promising(dealt, k, percent))
    discard(clusters, *read)
    links = stored(_links(_with_texts(keyed, place, "joined"), size, k, percent).unionByName(stars))
    discard(place, stars)
    return _result(rows, classes, components(links), id_col)


def _cells(classes: DataFrame) -> DataFrame:
    """(short, set, of, at, n, cells) of each class; cells: the lowest 11 bits of the sketch's values, two bytes each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts = _values(batch.column(batch.num_columns - 1))
            data = (values & 2047).astype(np.uint16).tobytes()
            ends = np.cumsum(counts) * 2
            cells = pa.array([data[e - 2 * c : e] for e, c in zip(ends.tolist(), counts.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], cells], [*batch.schema.names[:-1], "cells"])

    plain = classes.select("short", "set", F.col("first.id").alias("of"), F.col("first.key").alias("at"), "n", F.col("sketch").alias("cells"))
    return plain.mapInArrow(cut, plain.schema)


def _result(rows: DataFrame, classes: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    named = stored(classes.join(labels.withColumnRenamed("node", "set"), "set", "left").select("set", "least", "copies", F.coalesce("component", "set").alias("component")))
    least = stored(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets")))
    of_sets = stored(with_values(named, least, "component", "sets").select("set", "component_id", "copies"))
    discard(classes, named, least)
    with_words = with_values(rows.where("n > 0").select("id", "n", "set"), of_sets, "set", "copies").select("id", "n", "component_id")
    found = with_words.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, size: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; all columns are returned.

    Null texts and those without words are in no group and stay. Rows that share an id are one document here and stay or go alike; a null id goes where its group has another one.
    """
    keep = near_groups(docs, size, percent, id_col=id_col, text_col=text_col).where("kept").select(F.col(id_col).alias("kept_id"))
    return docs.join(keep, docs[id_col].eqNullSafe(keep["kept_id"]), "left_semi")
