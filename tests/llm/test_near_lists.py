"""Lists of runs of retained values: small sets, hot keys, and the share of links that lists find."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import common, near_dedup


def similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 8, 12, 20, 44, 60, 300])
def test_sets_at_the_threshold_share_a_list(size):
    """For unions of up to LISTED values always; beyond, but for a chance of 2e-8, so never in so few trials."""
    rng = np.random.default_rng(size)
    for _ in range(300):
        union = np.unique(rng.integers(-(2**62), 2**62, size))
        lost = set(rng.choice(len(union), len(union) // 5, replace=False).tolist())
        sets = [np.array([v for k, v in enumerate(union) if k not in lost or (k % 2 == side)], np.int64) for side in (0, 1)]
        if not similar(*map(set, (s.tolist() for s in sets))):
            continue
        keys = []
        for s in sets:
            kept = s[: near_dedup.LISTED]
            counts = np.array([len(kept)])
            own = set(near_dedup.runs(kept, counts, near_dedup.RUN)[0].tolist())
            keys.append(own | (set(near_dedup.runs(kept, counts, 1)[0].tolist()) if len(s) <= 5 else set()))
        assert keys[0] & keys[1]


def test_small_and_mixed_documents_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 12))]
        for _ in range(3):
            text = list(base)
            if rng.random() < 0.7:
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    sets = [near_dedup.shingle_set(t, 2) for _, t in rows]
    top = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if similar(sets[a], sets[b]):
                x, y = sorted((near_dedup._top(top, a), near_dedup._top(top, b)))
                top[y] = x
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: near_dedup._top(top, k) for k in range(len(rows))}


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.createDataFrame([(k % 50 if k % 3 else 7, k) for k in range(900)], "key long, v long")
    table = common.stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).where("key <> 9"))
    want = sorted(map(tuple, rows.join(table.drop("n"), "key").collect()))
    for parts in (2, 10, 1 << 15):
        assert sorted(map(tuple, common.with_values(rows, table, "key", "n", parts=parts).collect())) == want
        assert common.with_values(rows, table, "key", "n", "left", parts=parts).count() == 900
    none = table.where("false")
    assert common.with_values(rows, none, "key", "n").count() == 0 and common.with_values(rows, none, "key", "n", "left").count() == 900


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_filter_loses_nothing(spark, bits):
    keys = spark.range(0, 2000, 7).withColumnRenamed("id", "key")
    rows = spark.range(0, 2000).withColumnRenamed("id", "key")
    got = {r[0] for r in common.among(rows, keys, "key", bits).collect()}
    assert got >= set(range(0, 2000, 7)) and (bits == 64 or len(got) < 320)
    assert common.among(rows, keys.where("false"), "key", bits).count() == 0
    assert common.among(rows, keys.where("false"), "key", bits, also=F.col("key") < 5).count() == 5


def test_stored_tables_can_go(spark):
    table = common.stored(spark.range(10))
    assert table.count() == 10
    common.discard(table)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        table.collect()


# ------------------------------------------------------------------ families of many distinct near copies

def family(rng, n, words=200, edits=(1, 3), tag="f"):
    base = [f"{tag}{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(*edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def dealt_rows(spark, monkeypatch, texts, members):
    """The groups of near copies, and how many rows of sketches were dealt to find them."""
    seen = []
    real = near_dedup._promising

    def counted(rows, *args, **kwargs):
        seen.append(rows.count())
        return real(rows, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(near_dedup, "_promising", counted)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs, members=members).collect()}
    return found, sum(seen)


def test_rows_grow_with_a_family_not_with_its_square(spark, monkeypatch):
    rng = random.Random(12)
    texts = family(rng, 2400)
    small, few = dealt_rows(spark, monkeypatch, texts[:800], members=64)
    large, many = dealt_rows(spark, monkeypatch, texts, members=64)
    assert set(small.values()) == {0} and set(large.values()) == {0}
    assert many < 4.5 * few and many < 20 * len(texts)


def test_blocks_find_what_one_group_finds(spark, monkeypatch):
    """Families whose members are often too far from the leader, and from each other, in small blocks and all at once."""
    rng = random.Random(13)
    texts = family(rng, 150, edits=(0, 14)) + family(rng, 150, edits=(6, 20), tag="g") + family(rng, 60, words=40, edits=(0, 5), tag="h")
    rng.shuffle(texts)
    whole, _ = dealt_rows(spark, monkeypatch, texts, members=10**6)
    assert len(set(whole.values())) > 3
    for members in (7, 40):
        assert dealt_rows(spark, monkeypatch, texts, members)[0] == whole
