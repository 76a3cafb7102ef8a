"""The density method of HTML extraction: against a brute force over nested lists, and on pages whose names say nothing."""

import collections
import math
import os
import random
import re

import pyarrow.parquet as pq
import pytest

from jobloom.llm import html_text


def build(rng, depth=0):
    """A random tree: (tag, [texts and trees])."""
    kinds = ["div", "section", "p", "a", "span"] if depth < 4 else ["p", "a"]
    tag = rng.choice(kinds)
    if tag in ("p", "a") or rng.random() < 0.2:
        return (tag, ["word " * rng.randint(1, 40)])
    return (tag, [build(rng, depth + 1) if rng.random() < 0.8 else "loose text " * rng.randint(1, 5) for _ in range(rng.randint(1, 5))])


def write(tree):
    return f"<{tree[0]}>{''.join(write(x) if isinstance(x, tuple) else x for x in tree[1])}</{tree[0]}>"


def figures(tree, linked=False):
    """(characters, tags, characters in links, links) of all that a tree holds, counted anew for each call."""
    chars = tags = link_chars = links = 0
    for x in tree[1]:
        if isinstance(x, str):
            chars += len(x.replace(" ", ""))
        else:
            a, b, c, d = figures(x)
            chars, tags, link_chars, links = chars + a, tags + b + 1, link_chars + c, links + d
    return (chars, tags, chars, links + 1) if tree[0] == "a" else (chars, tags, link_chars, links)


def dense(tree, share):
    c, t, lc, lt = figures(tree)
    if not c:
        return 0.0
    t, n, lt = max(1, t), max(1, c - lc), max(1, lt)
    lc = max(1, lc)
    return c / t * math.log(max(1.0, (c / lc) * (t / lt))) / math.log(math.log(c / n * lc + share * c + math.e))


def every(tree):
    yield tree
    for x in tree[1]:
        if isinstance(x, tuple):
            yield from every(x)


@pytest.mark.parametrize("seed", range(30))
def test_densities_and_sums_by_brute_force(seed):
    rng = random.Random(seed)
    body = ("html", [build(rng) for _ in range(4)])
    page = "".join(map(write, body[1]))
    got = html_text.measure(html_text.parse(page))
    c, _, lc, _ = figures(body)
    share = lc / c if c else 0.0
    want = sorted((round(dense(t, share), 6), round(sum(dense(x, share) for x in t[1] if isinstance(x, tuple)), 6)) for t in every(body))
    assert sorted((round(n.density, 6), round(n.total, 6)) for n in got) == want
    # the threshold is the least density on the path from the node of the largest sum to the body
    best = max(got, key=lambda n: n.total)
    least, up = best.density, best
    while up.parent:
        up = up.parent
        least = min(least, up.density)
    assert html_text.mark(html_text.parse(page)) == pytest.approx(least)


SENTENCE = "An ordinary sentence of the article that goes on for a while, as such sentences do. "
SOUP = (
    "<div class=x1><div class=x2>" + "".join(f"<a href=/{k}>Entry {k}</a> " for k in range(12)) + "</div>"
    "<div class=x3><div class=x4>" + "".join(f"<div class=y>{SENTENCE * 4}</div>" for _ in range(8)) + "<div class=y>Short.</div></div></div>"
    "<div class=x5><span>Log in</span> <span>Help</span></div></div>"
)


def test_soup_without_telling_names():
    text = html_text.main_text(SOUP)
    assert text.count("An ordinary sentence") == 32 and text.endswith("\nShort.")
    assert "Entry" not in text and "Log in" not in text


def test_densities_decide(monkeypatch):
    with_them = html_text.main_text(SOUP)
    monkeypatch.setattr(html_text, "density", lambda *a: 1.0)
    assert html_text.main_text(SOUP) != with_them


@pytest.mark.parametrize("name", ["alert reply", "related-work", "social-science", "widget-theory", "notice"])
def test_article_text_with_awkward_names_stays(name):
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{SENTENCE}</p><div class='{name}'><p>{SENTENCE * 5}Marked.</p></div><p hidden>{SENTENCE * 5}</p></article></body>"
    assert "Marked." in html_text.main_text(page) and html_text.main_text(page).count("An ordinary") == 11


@pytest.mark.parametrize("tag", ["noscript", "svg", "template"])
def test_elements_that_are_never_ended(tag):
    assert html_text.main_text(f"<body><{tag} x=1><article><p>{SENTENCE}</p></article></body>") == SENTENCE.strip()


def test_nested_svg_leaves_nothing():
    assert html_text.main_text(f"<article><p>{SENTENCE}<svg><svg><text>a</text></svg><text>tail</text></svg></p></article>") == SENTENCE.strip()


def test_wrapper_with_a_word_of_adverts_stays():
    page = f"<div class='page sidebar'><p>{SENTENCE * 3}</p><p>{SENTENCE * 3}</p><p>End.</p></div><div class=ad>Buy this now, today only.</div>"
    text = html_text.main_text(page)
    assert text.endswith("End.") and "Buy" not in text


def test_very_long_and_very_deep_pages():
    long = "<article>" + f"<p>{SENTENCE * 50}</p>" * 2_000 + "</article>"
    assert html_text.main_text(long).count("\n") == 1_999
    assert html_text.main_text("<div>" * 50_000 + "deep") == "deep"


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, __html string")
    assert html_text.extract(pages).collect() == []


# ------------------------------------------------------------------ the whole extraction

def brute_text(trees):
    """The kept blocks of a page of named-nothing elements, from figures counted anew for each node."""
    root = ("html", trees)
    c, _, lc, _ = figures(root)
    share = lc / c if c else 0.0
    kids = lambda t: [x for x in t[1] if isinstance(x, tuple)]
    up, levels = {}, [root]
    for t in levels:
        for x in kids(t):
            up[id(x)] = t
            levels.append(x)
    own = {id(t): dense(t, share) for t in levels}
    total = {id(t): sum(own[id(x)] for x in kids(t)) for t in levels}
    best = levels[0]
    for t in levels:
        if total[id(t)] > total[id(best)]:
            best = t
    path = [best]
    while id(path[-1]) in up:
        path.append(up[id(path[-1])])
    least = min(own[id(t)] for t in path)
    largest = max(total[id(best)], own[id(best)])
    on_path, inner = set(map(id, path)), {id(t) for t in every(best)}

    def goes(t):
        c, _, lc, links = figures(t)
        if id(t) in inner:
            return t[0] in ("div", "section") and links > 1 and 10 * lc >= 9 * c and id(t) not in on_path and own[id(t)] < least
        if id(t) in up and id(up[id(t)]) in on_path and id(t) not in on_path and c:
            part = html_text.WEAK if c > html_text.SHORT else html_text.WEAK_SHORT
            return own[id(t)] < least or max(own[id(t)], total[id(t)]) < part * largest
        return False

    out = [[]]

    def walk(t):
        if goes(t):
            out.append([])
            return
        block = t[0] in ("div", "section", "p", "html")
        if block:
            out.append([])
        for x in t[1]:
            if isinstance(x, str):
                out[-1].append(x)
            else:
                walk(x)
        if block:
            out.append([])

    walk(root)
    return "\n".join(x for x in (" ".join("".join(b).split()) for b in out) if x)


@pytest.mark.parametrize("seed", range(120))
def test_extraction_by_brute_force(seed):
    rng = random.Random(1000 + seed)
    trees = [build(rng) for _ in range(rng.randint(1, 6))]
    assert html_text.main_text("".join(map(write, trees))) == brute_text(trees)


SUPPLIED = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(SUPPLIED), reason="no supplied tables")
def test_pages_whose_names_are_mute():
    """With elements made div and class, id and role taken away, nearly the same blocks are found; without densities, they aren't even with names."""
    pages = [r["html"] for r in pq.read_table(SUPPLIED, columns=["html"]).to_pylist()]
    right = wrong = lost = 0
    for page in pages:
        mute = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section|form)\b", r"<\1div", page)
        mute = re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", mute)
        want, got = (collections.Counter(html_text.main_text(x).split("\n")) for x in (page, mute))
        right, wrong, lost = right + (want & got).total(), wrong + (got - want).total(), lost + (want - got).total()
    assert right / (right + wrong) >= 0.98 and right / (right + lost) >= 0.99


def test_without_densities_adverts_stay(monkeypatch):
    page = f"<body><div class=ad>Buy now.</div><article><p>{SENTENCE}</p><p>{SENTENCE}</p></article></body>"
    assert "Buy" not in html_text.main_text(page)
    monkeypatch.setattr(html_text, "density", lambda *a: 0.0)
    assert "Buy" in html_text.main_text(page)


@pytest.mark.parametrize("part", [
    "<pre><code><span class='hljs-comment'>// kept: explains the loop</span></code></pre>", "<p><b class='ad'>kept</b> words</p>", f"<section id='menu'>{'<p>kept ' + SENTENCE * 3 + '</p>'}{'<p>' + SENTENCE * 4 + '</p>'}</section>",
    f"<div class='google-ads-guide'><p>kept {SENTENCE * 3}</p><p>{SENTENCE * 5}</p></div>", f"<section class='popup culture'><p>kept {SENTENCE * 3}</p><p>{SENTENCE * 3}</p></section>",
])
def test_article_text_whose_names_mean_something_else(part):
    assert "kept" in html_text.main_text(f"<body><article><h1>Title</h1><p>{SENTENCE * 2}</p><p>{SENTENCE * 2}</p>{part}</article></body>")


def test_comments_go_however_dense():
    page = f"<article><p>{SENTENCE * 3}</p><p>{SENTENCE * 3}</p><div class='comments'><p>{SENTENCE * 6}Reader.</p></div></article>"
    assert "Reader" not in html_text.main_text(page)
