"""The language model's contexts of more than two bytes against brute force."""

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from jobloom.llm import ppm, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(n):
    rng = random.Random(5)
    stems = ["abra", "cad", "abr", "acadab", "é", "ab", "Cada", "xyz"]
    return [None, "", "a", *("".join(rng.choice(stems + [" ", chr(97 + rng.randrange(26))]) for _ in range(rng.randint(1, 40))) for _ in range(n))]


def brute(rows, order, held_out=lambda i: i % 3 == 0):
    trie = collections.defaultdict(collections.Counter)
    coded = [(i, [*(t or "").translate(LOWER).encode(), 256]) for i, t in rows]
    for i, data in coded:
        if not held_out(i):
            for k, s in enumerate(data):
                for n in range(min(k, order) + 1):
                    trie[tuple(data[k - n : k])][s] += 1

    def p(context, s, excluded=frozenset()):
        own = {a: n for a, n in trie.get(context, {}).items() if a not in excluded}
        if s in own:
            return own[s] / (sum(own.values()) + len(own))
        share = len(own) / (sum(own.values()) + len(own)) if own else 1.0
        return share * (p(context[1:], s, excluded | set(own)) if context else 1 / (256 - len(trie.get((), {}))))

    return {i: sum(math.log10(p(tuple(data[max(0, k - order) : k]), s)) for k, s in enumerate(data)) for i, data in coded}


@pytest.mark.parametrize("order,most", [(5, 100_000), (5, 50), (6, 0)])
def test_long_contexts(spark, order, most):
    rows = list(enumerate(texts(80)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs, F.col("doc_id") % 3 == 0, order=order, most_codes=most).collect()}
    assert got == pytest.approx(brute(rows, order), rel=1e-5)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs, F.lit(True), order=5).collect()}
    assert got == pytest.approx({1: -4 * math.log10(256), 2: -math.log10(256)})


def test_query_reads_long_contexts(spark, tmp_path):
    rows = list(enumerate(texts(40)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.op4_lm_scoring(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(brute(rows, 5, lambda i: zlib.crc32(str(i).encode()) % 10 == 0), rel=1e-5)
