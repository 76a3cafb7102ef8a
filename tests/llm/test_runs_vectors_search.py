"""Periodic runs, nearest neighbours and ranked search against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import lexical, periodic, queries, vectors

SPACE = r"[^\x20\x09-\x0D]+"


def brute_runs(w, least=12):
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [4, 7, 12])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    for _ in range(1500):
        n, kinds = rng.randrange(90), rng.choice([1, 2, 3, 30])
        w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(n)] = b"z"
        assert periodic.runs_of(w, least) == brute_runs(w, least)


def test_long_runs():
    assert periodic.runs_of([b"a"] * 50_000) == [(0, 50_000, 1)]
    w = [b"%d" % i for i in range(3000)] * 7
    assert periodic.runs_of(w) == [(0, 21_000, 3000)]
    assert periodic.runs_of([b"%d" % i for i in range(20_000)]) == []


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, key string, runs int, first int")


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "a b " * 9), (5, "a b " * 9), (None, "x y z " * 5), (7, "x" * 300_000), (8, "  \u0085 é " * 8), (9, "a\u001cb " * 13), (20, "Aa aa AA " * 4)]


def test_periodic_query(spark, tmp_path):
    rng = random.Random(3)
    rows = ODD + [(100 + i, " ".join(str(rng.randrange(40)) for _ in range(rng.randrange(80)))) for i in range(120)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for doc_id, text in rows:
        w = re.findall(SPACE, text or "")
        n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        expected.append((doc_id, len(runs), *tail, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped))))
    got = [tuple(r) for r in queries.op11_periodic(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert periodic.periodic_runs(documents(spark, [])).collect() == []


# ------------------------------------------------------------------ neighbours

VECTORS = "vec_id long, embedding array<double>, dim int, n int, point string, members int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, 7, "p", 1) for i, v in rows], VECTORS)


def brute_neighbours(rows, asks, k=20):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    found = []
    for a, (q, v) in enumerate(good):
        if q is None or not asks(q):
            continue
        others = [(-float((np.array(w) * np.array(v)).sum()), i if i is not None else math.inf) for b, (i, w) in enumerate(good) if b != a and len(w) == len(v)]
        found += [(q, n + 1, None if i == math.inf else i, round(-s, 9)) for n, (s, i) in enumerate(sorted(others)[:k])]
    return sorted(map(repr, found))


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]  # more copies than places
    rows += [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 0.0, 0.0]), (280, [1.0, float("nan"), 0.0, 0.0]), (300, [float("inf"), 0.0, 0.0, 0.0]), (320, [1.0, 2.0]), (340, [3.0, -1.0]), (360, [5.0]), (None, [9.0, 9.0, 9.0, 9.0])]
    rows += [(20, [100.0, -50.0, 3.0, 1.0]), (20, [100.0, -50.0, 3.0, 1.0])]  # long ones, repeated
    got = vectors.nearest_neighbours(table(spark, rows), asks=F.col("vec_id") % 20 == 0).collect()
    assert sorted(repr((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9))) for r in got) == brute_neighbours(rows, lambda i: i % 20 == 0)
    assert vectors.nearest_neighbours(table(spark, []), asks=F.lit(True)).collect() == []


def test_recall_over_shards(spark):
    """Recall against brute force, with a third of all rows one vector and a third about another."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2400, 24))
    base[::3] = base[0]
    base[1::3] = base[1] + rng.normal(size=(800, 24)) * 1e-4
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    got = collections.defaultdict(set)
    for r in vectors.nearest_neighbours(table(spark, rows), asks=F.col("vec_id") % 20 == 0, shard_rows=500).collect():
        got[r["query_id"]].add(r["vec_id"])
    recall = []
    for q in range(0, 2400, 20):
        s = (base * base[q]).sum(axis=1)
        s[q] = -np.inf
        recall.append(len(got[q] & set(np.lexsort((np.arange(2400), -s))[:20].tolist())) / 20)
    assert len(got) == 120 and np.mean(recall) > 0.95


def test_graph_is_flat_and_whole():
    x = np.random.default_rng(2).normal(size=(700, 9)).astype(np.float32)
    graph = vectors.Graph.build(x)
    again = vectors.Graph.from_flat(x, *graph.flat())
    assert all((a == b).all() for a, b in zip(graph.links, again.links, strict=True))
    assert all(np.isin(b, a).all() for a, b in zip(graph.nodes, graph.nodes[1:], strict=False))
    for k, links in enumerate(graph.links):  # no node links to itself, and each link lies on the level
        assert (links != np.arange(len(links))[:, None]).all() and links.max() < len(graph.nodes[k])
    assert set(graph.nearest(x[:1], 700)[0]) == set(range(700))


# ------------------------------------------------------------------ ranked search

def brute_search(docs, items, k=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(d, cut(t)) for d, t in docs]
    n_all, total = sum(bool(t) for _, t in bags), sum(len(t) for _, t in bags)
    df = collections.Counter(t for _, terms in bags for t in set(terms))
    found = []
    for item, text in items:
        scores = []
        for d, terms in bags:
            m, tf = 75 + (25 * len(terms) * n_all) // total if terms else 0, collections.Counter(terms)
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in cut(text) if tf[t])
            if s > 0:
                scores.append((-s, math.inf if d is None else d))
        found += [(item, n + 1, None if d == math.inf else d, -s) for n, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(map(repr, found))


def prose(rng, n, kinds=300):
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), kinds)}" for _ in range(n))


def test_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    docs = ODD + [(1000 + i % 280, prose(rng, rng.randrange(60))) for i in range(300)] + [(50, "w1 " * 4000), (51, "W1,w2;w3 straße 漢字 W1")] + [(60 + i, "w9 w8 w7") for i in range(40)]
    items = [(i, prose(rng, rng.randrange(1, 40))) for i in range(30)] + [(1, "w1 w1 straße"), (None, "w9"), (70, None), (71, "?!"), (72, "unknown")]
    d, q = documents(spark, docs).repartition(3), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, terms int")
    expected = brute_search(docs, items)
    as_rows = lambda frame: sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in frame.collect())
    assert as_rows(lexical.rank_documents(d, q)) == expected
    assert lexical.rank_documents(documents(spark, []), q).collect() == [] and lexical.rank_documents(d, q.limit(0)).collect() == []


def test_blocks_are_the_cheapest():
    rng = np.random.default_rng(6)
    lists = [rng.integers(1, 1000, n).astype(np.int64) for n in (17, 40, 160, 161, 700)]
    for x, (ends, tops) in zip(lists, lexical.blocks(lists), strict=True):
        cuts = [0, *ends.tolist()]
        assert cuts[-1] == len(x) and [int(x[a:b].max()) for a, b in zip(cuts, cuts[1:], strict=False)] == tops.tolist()
        price = lexical.PRICE * x.mean()
        cost = lambda a, b, x=x, price=price: (b - a) * x[a:b].max() - x[a:b].sum() + price
        places = [*range(0, len(x), lexical.STEP), len(x)]
        best = [0.0]
        for j in range(1, len(places)):
            best.append(min(best[i] + cost(places[i], places[j]) for i in range(max(0, j - lexical.LONGEST), j)))
        assert sum(cost(a, b) for a, b in zip(cuts, cuts[1:], strict=False)) == pytest.approx(best[-1])


def test_skipping_is_exact(monkeypatch):
    rng = np.random.default_rng(7)
    n = 5000
    query, dense = [], np.zeros(n, np.int64)
    for size, factor in ((4000, 3), (900, 40), (120, 300), (5, 2000)):
        docs = np.sort(rng.choice(n, size, replace=False)).astype(np.uint16)
        weights = rng.integers(1, 400, size).astype(np.int32)
        ends, tops = lexical.blocks([weights.astype(np.int64)])[0]
        query.append((factor, (factor, docs, weights, ends, tops.astype(np.int32))))
        dense[docs] += factor * weights.astype(np.int64)
    docs, scores = lexical.top_documents(query, n, 20)
    best = np.lexsort((np.arange(n), -dense))[:20]
    assert docs.tolist() == best.tolist() and scores.tolist() == dense[best].tolist()
