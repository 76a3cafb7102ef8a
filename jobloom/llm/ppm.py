"""Language-model scoring by prediction by partial matching over bytes.

The trie of byte contexts has every context of up to ``order`` bytes with the counts of the
bytes that followed. Escapes are estimated by method C (as many as a context has different
symbols), and symbols that a longer context has are excluded from the shorter ones.

The contexts of up to two bytes, ``ORDER``, unfold into a table with a row for each one seen:
at most 65,793 rows of 256 values (67 MB), held by ``Model``. Longer ones are Spark tables keyed
by context, which grow with the corpus: ``gram_scores`` joins each context with its suffixes and
gives every different (context, symbol) of the documents its score, and these are joined to
the documents. A context's symbols are among its suffix's, so one exclusion holds for all longer ones.

A text's end is a symbol too: the byte 0xFF, which UTF-8 never has. It also stands before
a text, where contexts are shorter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import LOWER, stored, text_of

END = 255
ORDER = 2
#: Words whose scores go to all tasks; the others' are joined.
MOST_IN_MEMORY = 300_000
#: Codes (contexts with a symbol) of more than ORDER bytes whose scores go to all tasks; the others' are joined.
MOST_CODES = 1_000_000
#: The longest contexts whose codes, a byte longer, fit into a long.
MOST_ORDER = 6
_CHUNK = 1 << 20


def joined(texts: list[str]) -> np.ndarray:
    """The lower-cased bytes of all texts, each followed by END."""
    return np.frombuffer(b"".join(t.encode().translate(LOWER) + b"\xff" for t in texts), np.uint8)


def contexts(data: np.ndarray) -> np.ndarray:
    """The two bytes before each one, as a number; END stands for those before a text's first."""
    one = np.empty(len(data), np.uint32)
    one[0], one[1:] = END, data[:-1]
    two = np.empty(len(data), np.uint32)
    two[:2], two[2:] = END, data[:-2]
    two[one == END] = END
    return (two << np.uint32(8)) | one


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Each byte and the ``order`` before it, as a number, the byte itself lowest; END stands for those before a text's first."""
    code = data.astype(np.int64)
    outside = np.zeros(len(data), bool)
    for i in range(1, order + 1):
        before = np.full(len(data), END, np.uint8)
        before[i:] = data[:-i]
        before[outside] = END
        outside = before == END
        code |= before.astype(np.int64) << (8 * i)
    return code


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in lists of about ``_CHUNK`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def context_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): how often each byte followed each two bytes. code: the three bytes as a number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << 16, 256), np.int64)  # memory is taken for the contexts that occur
        place = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for texts in _chunks(batch.column(0).to_pylist()):
                data = joined(texts)
                before = contexts(data)
                seen = np.flatnonzero(np.bincount(before, minlength=1 << 16))
                place[seen] = np.arange(len(seen)) * 256
                total[seen] += np.bincount(place[before] + data, minlength=len(seen) * 256).reshape(-1, 256)
        used = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(used), 500):
            rows, symbols = np.nonzero(total[used[i : i + 500]])
            codes = used[i : i + 500][rows] * 256 + symbols
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total.ravel()[codes])], ["code", "n"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(code, n, times): how often each code of ``grams`` occurs in training texts, and in all. docs: text, held_out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            codes, place = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            return codes, *(np.bincount(place, np.concatenate([x[k] for x in parts]), len(codes)).astype(np.int64) for k in (1, 2))

        def out() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(parts[0][0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in parts[0]], ["code", "n", "times"])

        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for training in (True, False):
                for texts in _chunks([text for text, held_out in rows if (held_out is False) == training]):
                    codes, times = np.unique(grams(joined(texts), order), return_counts=True)
                    parts.append((codes, times if training else np.zeros_like(times), times))
                    if sum(len(x[0]) for x in parts) > 3_000_000:
                        parts[:] = [merged()]
                        if len(parts[0][0]) > 1_500_000:
                            yield from out()
                            parts.clear()
        if parts:
            parts[:] = [merged()]
            yield from out()

    return docs.select("text", "held_out").mapInArrow(count, "code long, n long, times long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def gram_scores(docs: DataFrame, order: int) -> DataFrame:
    """(code, times, p): each code of the documents' texts, how often it occurs, and its log10 probability by the training texts.

    From the longest contexts to those of three bytes: codes whose context has their symbol are
    done; the others escape to the suffix, without the symbols that the context has. What is
    left ends at ``Model``. docs: text, held_out.
    """
    spark = docs.sparkSession
    bits = lambda c, n: c.bitwiseAND(F.lit((1 << 8 * n) - 1))
    inside = lambda k: bits(F.shiftright("code", 8 * k), 1) != END  # noqa: E731  # the text has k bytes before the symbol
    found = stored(gram_counts(docs, order))
    seen = {k: stored(found.where(inside(k) & (F.col("n") > 0)).groupBy(bits(F.col("code"), k + 1).alias("gram")).agg(F.sum("n").alias("n"))) for k in range(ORDER, order + 1)}
    node = lambda k: seen[k].groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("different"))
    low = found.where("n > 0").groupBy(bits(F.col("code"), ORDER + 1).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    sent = spark.sparkContext.broadcast(Model(low.column("code").to_numpy(), low.column("n").to_numpy()))

    left = found.select("code", "times", F.lit(0.0).alias("escaped"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("kinds"))
    done = []
    for k in range(order, ORDER, -1):
        # what the suffix counted of other symbols than this context's, and how many others it has
        taken = seen[k].select(F.shiftright("gram", 8).alias("context"), "n", bits(F.col("gram"), k).alias("suffix")).join(seen[k - 1].select(F.col("gram").alias("suffix"), F.col("n").alias("below")), "suffix")
        own = taken.groupBy("context").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("different"), F.sum("below").alias("below")).withColumn("suffix", bits(F.col("context"), k - 1))
        under = node(k - 1).select(F.col("context").alias("suffix"), F.col("all").alias("all_below"), F.col("different").alias("different_below"))
        nodes = own.join(under, "suffix").select("context", "all", "different", (F.col("all_below") - F.col("below")).alias("all_other"), (F.col("different_below") - F.col("different")).alias("different_other"))
        keyed = left.withColumns({"context": F.when(inside(k), bits(F.shiftright("code", 8), k)), "gram": F.when(inside(k), bits(F.col("code"), k + 1))})
        both = keyed.join(nodes, "context", "left").join(seen[k], "gram", "left")
        total, kinds = F.coalesce("total", "all"), F.coalesce("kinds", "different")
        step = stored(both.select(
            "code", "times",
            F.when(F.col("n").isNotNull(), F.col("escaped") + F.log10(F.col("n") / (total + kinds))).alias("p"),
            F.when(kinds > 0, F.col("escaped") + F.log10(kinds / (total + kinds))).otherwise(F.col("escaped")).alias("escaped"),
            F.col("all_other").alias("total"), F.col("different_other").alias("kinds"),
        ))
        done.append(step.where("p is not null").select("code", "times", "p"))
        left = step.where("p is null").drop("p")

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            code = batch.column(0).to_numpy()
            total, kinds = (batch.column(k).fill_null(-1).to_numpy() for k in (3, 4))
            p = batch.column(2).to_numpy() + model.ends(code & (1 << 24) - 1, total, kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], ["code", "times", "p"])

    result = left.select("code", "times", "escaped", "total", "kinds").mapInArrow(lowest, "code long, times long, p double")
    for part in done:
        result = result.unionByName(part)
    return stored(result)


class Frequent:
    """Scores by code: a hash table, a quarter full at most, that has all codes given, each at the first free slot from its own on."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(codes) - 1).bit_length()) if len(codes) else 4
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        self.probes = 0
        while len(codes):
            at = self._slots(codes, self.probes)
            free = np.flatnonzero(self.keys[at] < 0)
            at, first = np.unique(at[free], return_index=True)
            self.keys[at], self.values[at] = codes[free[first]], values[free[first]]
            rest = np.ones(len(codes), bool)
            rest[free[first]] = False
            codes, values = codes[rest], values[rest]
            self.probes += 1

    def _slots(self, codes: np.ndarray, probe: int) -> np.ndarray:
        slots = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (slots.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each code, 0 for those that aren't here, and the places of these."""
        at = self._slots(codes, 0)
        value, held = self.values[at], self.keys[at]
        missing = held != codes
        value[missing] = 0
        open_ = np.flatnonzero(missing & (held >= 0))  # another code has the slot
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = self._slots(codes[open_], probe)
            held = self.keys[at]
            hit = held == codes[open_]
            value[open_[hit]] = self.values[at[hit]]
            missing[open_[hit]] = False
            open_ = open_[~hit & (held >= 0)]
        return value, np.flatnonzero(missing)


class Model:
    """The unfolded trie: ``table[row[context], symbol]`` is a log10 probability."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        codes = codes.astype(np.int64)
        symbol, one, two = codes & 255, codes >> 8 & 255, codes >> 16
        n0 = np.bincount(symbol, counts, 256)
        inside = one != END
        n1 = np.bincount((one * 256 + symbol)[inside], counts[inside], 65536).reshape(256, 256)
        inside = (one != END) & (two != END)
        seen, rank = np.unique(codes[inside] >> 8, return_inverse=True)
        n2 = np.bincount(rank * 256 + symbol[inside], counts[inside], len(seen) * 256).reshape(-1, 256)

        new = np.full(256, 1 / max(1, 256 - np.count_nonzero(n0)))  # of symbols that the corpus doesn't have
        empty = self._blend(n0[None], new[None], 0)[0]
        # without what a context of one byte has: first the empty context's, then that of new symbols
        rest0 = self._blend(np.where(n1 > 0, 0, n0[None]), np.broadcast_to(new, n1.shape), 0, np.count_nonzero(n0) == 256)
        rows1 = self._blend(n1, rest0, 1)
        last = seen & 255
        rest1 = self._blend(np.where(n2 > 0, 0, n1[last]), rest0[last], 1)
        rows2 = self._blend(n2, rest1, 2)
        with np.errstate(divide="ignore"):
            self.table = np.log10(np.concatenate([empty[None], rows1, rows2])).astype(np.float32)
        row = np.zeros(65536, np.int32)
        row[:] = 1 + (np.arange(65536) & 255)
        row[seen] = 257 + np.arange(len(seen))
        row[END << 8 : (END << 8) + 255] = 1 + np.arange(255)
        row[np.arange(256) * 256 + END] = 0
        self.row = row
        self.own, self.rest = n2, rest1

    def ends(self, codes: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The log10 probability of codes of three bytes after an escape from a longer context, whose
        symbols are excluded: ``total`` and ``kinds`` are what its two last bytes have without them. Negative: no longer context was seen.
        """
        row, symbol = self.row[codes >> 8], codes & 255
        value = self.table[row, symbol].astype(np.float64)
        after = np.flatnonzero(kinds >= 0)
        at, symbol, total, kinds = row[after] - 257, symbol[after], total[after], kinds[after]
        own, whole = self.own[at, symbol], np.maximum(total + kinds, 1)
        escape = np.where(kinds > 0, kinds / whole, 1.0)
        value[after] = np.log10(np.where(own > 0, own / whole, escape * self.rest[at, symbol]))
        return value

    @staticmethod
    def _blend(n: np.ndarray, lower: np.ndarray, order: int, complete: bool = False) -> np.ndarray:
        """Method C: a context's own counts, and an escape to ``lower`` for the others."""
        kinds, total = np.count_nonzero(n, axis=1)[:, None], n.sum(axis=1)[:, None]
        escapes = np.where((kinds == 256) | complete, 0, kinds)
        escape = np.where(total > 0, escapes / np.maximum(total + escapes, 1), 1.0)
        return np.where(n > 0, n / np.maximum(total + escapes, 1), escape * lower)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The log10 probability of each text."""
        parts = []
        for some in _chunks(texts):
            data = joined(some)
            each = self.table[self.row[contexts(data)], data]
            starts = np.concatenate([[0], np.flatnonzero(data == END)[:-1] + 1])
            parts.append(np.add.reduceat(each, starts, dtype=np.float64))
        return np.concatenate(parts) if parts else np.empty(0)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of all texts of ``docs``. What comes to the driver has at most 2^24 rows, the number of codes."""
    got = context_counts(docs, text_col).toArrow()
    return Model(got.column("code").to_numpy(), got.column("n").to_numpy())


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, n = list(held.keys()), list(held.values())
            for i in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), pa.array(n[i : i + 50_000], pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for texts in _chunks(batch.column(0).to_pylist()):
                for text in texts:
                    held.update(text.encode().translate(LOWER).split())
                if len(held) > 300_000:
                    yield from out()
        yield from out()

    return docs.select(text_of(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """Up to ``most`` rows with the largest ``count``: all those over a bound, which the histogram of counts gives.

    The histogram has a row for each sixteenth of a doubling, some thousand at most.
    """
    step = F.floor(F.log2(count) * 16)
    least, held = 1 << 20, 0
    for size, n in sorted(((r[0], r[1]) for r in rows.groupBy(step).count().collect()), reverse=True):
        held += n
        if held > most:
            break
        least = size
    return rows.where(step >= least)


def _deep_scores(texts: list[str], order: int, scored: Frequent) -> tuple[np.ndarray, ...]:
    """Of each text the sum of the scores in ``scored``; and the other codes: the text's place, the code, how often it has it."""
    sums, parts, first = [], [np.empty((3, 0), np.int64)], 0
    for some in _chunks(texts):
        data = joined(some)
        code = grams(data, order)
        each, missing = scored.find(code)
        ends = np.flatnonzero(data == END)
        sums.append(np.add.reduceat(each, np.concatenate([[0], ends[:-1] + 1]), dtype=np.float64))
        text, code = np.searchsorted(ends, missing), code[missing]
        by = np.lexsort((code, text))
        text, code = text[by], code[by]
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(by)), bool), (text[1:] != text[:-1]) | (code[1:] != code[:-1])]))
        parts.append(np.stack([first + text[begins], code[begins], np.diff(np.append(begins, len(by)))]))
        first += len(some)
    far, codes, times = np.concatenate(parts, axis=1)
    return np.concatenate(sums) if sums else np.empty(0), far, codes, times


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", most_in_memory: int = MOST_IN_MEMORY, order: int = ORDER, most_codes: int = MOST_CODES) -> DataFrame:
    """Scores every document by a model of those that aren't held out.

    Returns one row per document row: id, held_out, n_tokens, n_known, train_tokens,
    base_score (smoothed unigrams of words and one end), score (the model's log10
    probability of the lower-cased text and its end). Null text is empty: one token, the end. Without
    training documents all symbols are equally likely. A null id is kept, repeated rows give a
    row each, other columns are ignored.

    Counts of words are exact. The scores of the ``most_in_memory`` most frequent words go to
    the tasks; the other words of each document are joined with the counts. With an ``order``
    over ORDER, so do the scores of about ``most_codes`` of the most frequent codes.
    """
    if not ORDER <= order <= MOST_ORDER:
        raise ValueError(f"order: {ORDER} to {MOST_ORDER}")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), held_out.alias("held_out"))
    training = base.where(~F.col("held_out"))
    counts = stored(word_counts(training))
    ends = training.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = words + ends, distinct + (ends > 0)
    share = total + 0.1 * (kinds + 1)
    top = _most_frequent(counts, "n", most_in_memory).select("word", "n").toArrow()
    deep = gram_scores(base, order) if order > ORDER else None
    if deep is None:
        model = train(training)
    else:
        codes = _most_frequent(deep, "times", most_codes).select("code", "p").toArrow()
        model = codes.column("code").to_numpy(), codes.column("p").to_numpy()
    sent = spark.sparkContext.broadcast((model, top.column("word").to_pylist(), np.log10((top.column("n").to_numpy() + 0.1) / share), float(np.log10((ends + 0.1) / share))))
    kind = base.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, code long, times long"
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent, values, end = sent.value
        known = dict(zip(frequent, values.tolist()))
        scored = Frequent(*model) if order > ORDER else None
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_tokens, n_known, sums, at, other, times = [], [], [], [], [], []
            for k, text in enumerate(texts):
                found = Counter(text.encode().translate(LOWER).split())
                rare = [w for w in found if w not in known]
                for w in rare:
                    at.append(row + k)
                    other.append(w)
                    times.append(found.pop(w))
                here = sum(found.values())
                n_tokens.append(here + sum(times[len(times) - len(rare) :]) + 1)
                n_known.append(here + (ends > 0))
                sums.append(sum(known[w] * n for w, n in found.items()) + end)
            n = len(texts)
            score, far, codes, repeats = (model.scores(texts), *[np.empty(0, np.int64)] * 3) if scored is None else _deep_scores(texts, order, scored)
            rows = [pa.array(range(row, row + n), pa.int64()), batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(score, pa.float64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names)
            rest = [pa.array(at, pa.int64()), *(pa.nulls(len(at), c.type) for c in rows[1:7]), pa.array(other, pa.binary()), pa.nulls(len(at), pa.int64()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(rest, names)
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(row + far), *(pa.nulls(len(far), c.type) for c in rows[1:8]), pa.array(codes), pa.array(repeats)], names)
            row += n

    table = stored(base.select("id", "text", "held_out").mapInArrow(each, schema))
    rare = table.where("word is not null").select("row", "word", "times").join(counts, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(share))
    more = rare.groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"))
    whole = table.where("word is null and code is null").drop("word", "code", "times").join(more, "row", "left")
    score_of = F.col("score")
    if deep is not None:
        distant = table.where("code is not null").select("row", "code", "times").join(deep.select("code", "p"), "code")
        whole = whole.join(distant.groupBy("row").agg(F.sum(F.col("times") * F.col("p")).alias("more_score")), "row", "left")
        score_of = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        score_of.alias("score"),
    )
