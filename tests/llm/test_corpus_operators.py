"""The corpus operators against brute force, round trips, held-out accuracy and odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import decontaminate, exact_dedup, html_text, language, licenses, near_dedup, packing, ppm, secrets, token_files
from jobloom.llm.components import components
from jobloom.llm.gru import Network
from jobloom.llm.tokens import Encoder, default_path

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so".split()


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "ed", str(rng.randint(0, 99))]) for _ in range(n))


def table(spark, rows):
    """Documents with columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, n int").withColumns({"key": F.lit("k"), "set": F.lit(1), "norm": F.lit(2), "words": F.lit(3), "row": F.lit(0)})


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "A  b\tc"), (6, "a b c"), (6, "a b c"), (7, "x" * 300_000), (8, "é ß 漢字 \U0001f600"), (None, "null id"), (9, "a b c")]


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# ------------------------------------------------------------------ exact dedup

def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    docs = table(spark, [*ODD, *[(100 + i, prose(i % 7)) for i in range(40)]])
    hash_of = (lambda c: F.substring(F.md5(c), 1, 1)) if weak else exact_dedup.content_hash  # one of 16 values: collisions
    got = exact_dedup.exact_groups(docs, hash_of=hash_of).collect()
    rows = [(r["doc_id"], norm(r["text"])) for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    expected = sorted(repr((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest())) for i, t in rows)
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got) == expected
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.drop_copies(docs).columns == docs.columns


# ------------------------------------------------------------------ near dedup

def edited(text, seed, edits):
    words, rng = text.split(), random.Random(seed)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randint(0, 10**6)}"
    return " ".join(words)


def brute_components(rows):
    sets = [near_dedup.shingle_set(t or "", 2) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("members", [1024, 8])
def test_near_groups(spark, members):
    base = [prose(s, n) for s, n in ((1, 200), (2, 40), (3, 90))]
    rows = [(1000 + k, edited(base[k % 3], k, k % 13)) for k in range(120)] + [(2000 + k, "a common passage of words " * 3 + prose(50 + k, 60)) for k in range(30)] + ODD
    got = near_dedup.near_groups(table(spark, rows), members=members, shingles=100_000_000)
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got.collect()) == sorted(map(repr, brute_components(rows)))


def test_near_groups_of_nothing(spark):
    docs = table(spark, ODD).where("false")
    assert near_dedup.near_groups(docs).count() == 0 and near_dedup.drop_near_copies(docs).columns == docs.columns


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(up)}


# ------------------------------------------------------------------ tokens, packing, files

def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_exact():
    rng, encode = random.Random(1), reference_ids()
    own = Encoder(default_path(), most=500)
    alphabet = "ab'sZ0 9.,!\n\t\r\x0b\x1c\x85  ​᠎éß漢\U0001f600ſ<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [prose(i) for i in range(50)] + ["<|endoftext|> a", "don't we'll"]
    assert [x.tolist() for x in own.texts(texts)] == [encode(t) for t in texts]


def test_pack(spark):
    rows = [*ODD[:-1], *[(100 + i, prose(i, 5 + 37 * i % 900)) for i in range(150)]]
    got = packing.pack(table(spark, rows), capacity=256, rows_a_block=10).collect()
    encode, per_doc, per_sequence = reference_ids(), collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        per_doc[r["doc_id"]].append(r)
        per_sequence[r["sequence_id"]].append(r)
    for i, text in dict(rows).items():
        ids = np.array([*encode(text), 1], "<u4")
        own = sorted(per_doc[i], key=lambda r: r["start"])
        if i == 6:  # a repeated row
            own = own[::2]
        assert [r["start"] for r in own] == list(range(0, len(ids), 256))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in own)
    for own in per_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert len(per_sequence) <= 1.05 * sum(r["length"] for r in got) / 256 + 1


def test_patterns_place_everything():
    rng = random.Random(5)
    for capacity in (8, 64, 2048):
        counts = {rng.randint(1, capacity): rng.randint(1, 500) for _ in range(60)}
        found = packing.patterns(counts, capacity)
        placed = collections.Counter()
        for count, pack in found:
            assert count > 0 and sum(n * t for n, t in pack) <= capacity
            for n, t in pack:
                placed[n] += count * t
        assert placed == counts and len(found) <= 2 * len(counts)
    assert packing.patterns({}, 8) == []


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files_round_trip(spark, tmp_path, kind):
    rows = [*ODD, *[(100 + i, prose(i, 30)) for i in range(60)]]
    path = str(tmp_path / "ids")
    token_files.write_ids(table(spark, rows), path, end_id=0, kind=kind, block=64, chunk_ids=500)
    got = sorted(token_files.read_ids(spark, path).collect(), key=lambda r: r["start"])
    encode, at = reference_ids(), 0
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (i, text), r in zip(expected, got, strict=True):
        ids = np.array([*encode(text), 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    empty = str(tmp_path / "none")
    token_files.write_ids(table(spark, rows).where("false"), empty)
    assert token_files.read_ids(spark, empty).count() == 0


# ------------------------------------------------------------------ decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("set_bits", [decontaminate.SET_BITS, 64])
def test_decontamination(spark, set_bits):
    items = [(1, prose(900, 40)), (10, prose(901, 13)), (2, "Only four words, Émile"), (3, None), (4, "..."), (None, prose(902, 20)), (5, prose(900, 40))]
    rows = [*ODD, (20, prose(1, 30) + " " + prose(900, 40).upper()), (21, prose(2, 400) + ", " + prose(901, 13)), (22, "Only FOUR words émile"), (23, "only four words Émile only four words Émile"), (24, prose(900, 40)[:150]), (25, prose(902, 20))]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    expected = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= {str(x) for x in own if x is not None}
        expected.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("w"))
    got = decontaminate.hits(docs, bench, set_bits=set_bits)
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"])) for r in got.collect()) == sorted(map(repr, expected))
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(x[0]) for x in expected if not x[4])
    if set_bits > 64:
        clean = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
        assert words(clean[20]) == words(prose(1, 30)) and clean[1] is None and clean[4] == "word"
    none = decontaminate.hits(docs, bench.where("false"), set_bits=set_bits)
    assert none.count() == len(rows) and none.where("n_hit > 0").count() == 0


# ------------------------------------------------------------------ secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(s, ("assign", "access", "hex")[k], e) for s, k, e in sorted(found)]


def test_secrets(spark):
    rng = random.Random(2)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [*ODD, (30, 'é Password: "hunter2hunter2" and API_KEY=' + key(40, "0123456789abcdef")), (31, "password: token \"= abcdefghij"), (32, "token=token=abcdefgh12"), (33, "AKIA" + key(16, "ABCDEFGH01234567") + " AKIASHORT"), (34, "\U0001f600 " + key(32, "0123456789abcdef") + " " + key(31, "abcdef")), (35, "see " + key(64, b64) + " there"), (36, "internationalisationalised " * 30 + "pneumonoultramicroscopicsilicovolcanoconiosis")]
    rows += [(200 + i, "-".join(["some-long-hyphenated-ordinary-name", *rng.sample(WORDS, 8)])) for i in range(40)]
    got = by_id(secrets.scan(table(spark, rows)))
    for i, t in rows:
        if i is not None:
            spans = lambda name: [(s["start"], s["kind"], s["end"]) for s in got[i][name]]  # noqa: B023, E731
            assert spans("base") == base_spans(t or ""), i
            assert [s for s in spans("spans") if s[1] != "random"] == spans("base")
    assert [(s["start"], s["end"]) for s in got[35]["spans"]] == [(4, 68)]
    assert not any(got[i]["spans"] for i in range(200, 240)) and not got[36]["spans"] and not got[7]["spans"]
    hidden = by_id(secrets.redact(table(spark, rows)))
    assert hidden[35]["text"] == "see " + "*" * 64 + " there" and hidden[1]["text"] is None


# ------------------------------------------------------------------ language

def test_gradients():
    net = Network(3, 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.random.default_rng(0).integers(65, 100, (7, 4)).astype(np.uint16)
    x[5:, 1] = 256
    label = np.array([0, 1, 2, 1])
    _, g = net.gradients(x, label)
    for name, value in net.p.items():
        at = np.unravel_index(np.argmax(np.abs(g[name])), value.shape)
        old = value[at]
        value[at] = old + 1e-3
        high = net.gradients(x, label)[0]
        value[at] = old - 1e-3
        low = net.gradients(x, label)[0]
        value[at] = old
        assert abs(g[name][at] - (high - low) / 2e-3) < 1e-3 * abs(g[name][at]) + 1e-5


def test_language(spark):
    alphabets = {"aa": "abcdefgh ", "bb": "mnopqrst ", "cc": "abmnéñüß "}
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(20, 400))), lang) for i, lang in enumerate(list(alphabets) * 60)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ...", None), (1003, "½ ²", "aa"), (None, "abcabc abc", None), (1004, "mnopqrst" * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    held_out = F.col("doc_id") % 4 == 2
    got = language.identify(docs, F.coalesce(held_out, F.lit(True))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    tested = [(i, lang) for i, _, lang in rows[:180] if i % 4 == 2]
    assert sum(pred[i] == lang for i, lang in tested) >= 0.95 * len(tested)
    assert [pred[i] for i in (1000, 1001, 1002, 1003, 1004)] == ["und"] * 4 + ["bb"]
    nothing = language.identify(docs, F.lit(True)).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]
    kept = language.drop_rejected(docs, F.lit(False))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4


# ------------------------------------------------------------------ language model

def test_lm_scores(spark):
    rows = [*ODD, *[(100 + i, prose(i, 40) + (" ÉÈ" if i % 3 else "")) for i in range(60)]]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10
    for most in (5, 100_000):
        got = ppm.score(table(spark, rows), remainder == 0, most_in_memory=most).collect()
        counts = collections.Counter()
        for i, t in rows:
            if not held(i):
                counts.update([*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None])
        total, kinds = sum(counts.values()), len(counts)
        trie = [collections.defaultdict(collections.Counter) for _ in range(3)]
        for i, t in rows:
            if not held(i):
                data = [*(t or "").translate(LOWER).encode(), 256]
                for k, s in enumerate(data):
                    for order in range(min(k, 2) + 1):
                        trie[order][tuple(data[k - order : k])][s] += 1

        def p(context, s, excluded=frozenset()):
            own = {a: n for a, n in trie[len(context)].get(context, {}).items() if a not in excluded}
            escape, total_ = len(own), sum(own.values())
            if s in own:
                return own[s] / (total_ + escape)
            share = escape / (total_ + escape) if own else 1.0
            return share * (p(context[1:], s, excluded | set(own)) if context else 1 / (256 - len(trie[0][()])))

        expected = []
        for i, t in rows:
            tokens = [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
            base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
            data = [*(t or "").translate(LOWER).encode(), 256]
            model = sum(math.log10(p(tuple(data[max(0, k - 2) : k]), s)) for k, s in enumerate(data)) if len(data) < 10_000 else None
            expected.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, base, model))
        order = lambda r: (r[0] is None, r[0] or 0)
        for a, b in zip(sorted((tuple(r) for r in got), key=order), sorted(expected, key=order), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and (b[6] is None or a[6] == pytest.approx(b[6], rel=1e-4))


def test_model_is_a_distribution():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(97, 105, (400, 3)) @ np.array([65536, 256, 1]))
    model = ppm.Model(codes, rng.integers(1, 9, len(codes)))
    assert np.allclose((10.0 ** model.table).sum(axis=1), 1, atol=1e-4)
    nothing = ppm.Model(np.empty(0, np.int64), np.empty(0, np.int64))
    assert nothing.scores(["", "ab"]).tolist() == pytest.approx([-math.log10(256), -3 * math.log10(256)])


# ------------------------------------------------------------------ licences

def test_licences(spark):
    texts = dict(licenses.TEXTS)
    mit = next(t for name, t in licenses.TEXTS if name == "MIT" and "hereby" in t)
    bsd3 = texts["BSD-3-Clause"] if "Redistribution" in texts["BSD-3-Clause"] else next(t for name, t in licenses.TEXTS if name == "BSD-3-Clause" and "Redistribution" in t)
    wrapped = "# " + "\n# ".join(re.findall(r".{1,60}(?:\s|$)", mit))
    rows = [*ODD, (40, f"MIT License\n\nCopyright (c) 2020 X\n\n{mit}"), (41, wrapped), (42, bsd3.upper()), (43, "no stop\nReleased under the MIT License.\nmore"), (44, "Licensed under CC BY-NC 4.0. " + prose(3, 30) + ". Licensed under CC BY-NC 4.0."), (45, "the license is not stated here"), (46, "SPDX-License-Identifier: GPL-3.0-only\n")]
    got = by_id(licenses.scan(table(spark, rows)))
    assert {i: got[i]["licenses"] for i in range(40, 47)} == {40: "MIT", 41: "MIT", 42: "BSD-3-Clause", 43: "MIT", 44: "CC-BY-NC-4.0", 45: "", 46: "GPL-3.0-only"}
    assert all(got[i]["n_licenses"] == 0 for i in range(1, 10))
    ids, rules = licenses.known()
    assert len(rules) == len({r for _, r in rules}) and len(ids) < 200


# ------------------------------------------------------------------ pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "</p><article>";</script></head><body><header class="site-header"><h1>Site</h1></header>
<nav><ul><li><a href="/a">a</a></ul></nav><div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; line</h1><p><b>One&nbsp;two<br>three <i>four
<p>Five &lt;six&gt; &eacute;</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><aside>aside</aside><form><p>form</p></form><div id="comments"><p>a reader's comment of some length</p></div></article></main>
<div class="ad">Buy</div><footer>&copy; us"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == "Head & line\nOne two three four\nFive <six> é\nx\ny\n1\n2"
    bare = "<body><div class=menu><a>1</a> <a>2</a></div><div id=c><h2>Head</h2><p>A paragraph of ordinary length.</p><p>Another one of ordinary length.</p></div><div>tiny</div></body>"
    assert html_text.main_text(bare) == "Head\nA paragraph of ordinary length.\nAnother one of ordinary length."
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (None, "v", "plain"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<p x='" * 500), (7, "u", "<<a<b a=\"")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert len(got) == 7 and got[2]["text"] == got[3]["text"] == "" and got[None]["text"] == "plain" and got[5]["text"] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


# ------------------------------------------------------------------ registered queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")
def test_registered_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__
    from jobloom.llm import queries

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        frame, expected = queries.QUERIES[name](spark, SF), con.sql(sql)
        columns = sorted(frame.columns)
        assert columns == sorted(expected.columns)
        at = [expected.columns.index(c) for c in columns]
        assert sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in expected.fetchall())
    assert {"pipeline", *queries.QUERIES} <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, columns = docs, docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == columns
        kept = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "language_id":
            assert set(kept) == {i for i, t in rows if any(map(str.isalpha, t))}
        elif name == "exact_dedup":
            first = {}
            for i, t in sorted(rows):
                first.setdefault(norm(t), i)
            assert set(kept) == set(first.values())
        elif name == "near_dedup":
            assert set(kept) == {i for i, _, c in brute_components(rows) if i == c or c is None}
        rows = list(kept.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(kept)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
