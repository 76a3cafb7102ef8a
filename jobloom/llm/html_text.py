"""Main text of web pages by composite text density.

Of every node of the page's tree: its characters per tag, adjusted by the share of characters in
links (the composite text density of the published method). Of every node: the sum of its children's
densities. The node with the largest sum leads to the article; the least density on its path to the
body is the threshold. What stands beside that path, on any level, stays where it reaches the
threshold, and where its own density or sum has some weight against the largest sum. Names never decide alone: a class name or id raises the weight that a block
needs, inside the article as well; a dense enough part stays whatever it is called. Only elements and roles that hold no article text by their
definition, and readers' comments, which are as dense as an article, go by what they are.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from jobloom.llm.common import text_of

# Kinds of elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements and roles that by their definition hold no article text.
BESIDE = frozenset("nav footer aside form button select option optgroup menu dialog object embed audio video canvas map datalist output input label fieldset noscript template svg".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar".split())
#: Elements that are left out as tags where the page never ends them.
ENDED = frozenset("noscript template svg object audio video canvas map".split())
#: Words of class or id of blocks that must weigh ``STRONG`` to stay.
WORDS = frozenset("ad ads adv advert adverts advertisement adsense sponsored banner cookie cookies gdpr nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav masthead newsletter popup modal overlay pagination pager".split())
#: Words of readers' comments.
COMMENTS = frozenset("comment comments commentlist disqus".split())
#: Words that count only against nodes under the threshold.
HINTS = frozenset("header footer topbar aside widget widgets sponsor promo promotion consent notice notices alert subscribe subscription respond reply replies social share sharing related recommended recommendations login signup search toolbar skip".split())
#: Parts of the largest density sum: what a block beside the path must have of its own, or of up to ``SHORT`` characters, and what one must have that names speak against,
#: inside an article or main element or on a page without one, and outside it.
WEAK, WEAK_SHORT, STRONG, OUTSIDE = 0.04, 0.3, 0.5, 8.0
SHORT = 120
#: Start tags that end an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*+(?:["'].*)?\Z|<[a-zA-Z][^>]*>|([^<]+)|(<)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Node:
    """An element: what it holds in order (text or nodes), and the figures of its subtree.

    ``doubt`` is 3 for what isn't article text by its element or role or as readers' comments, 2 for what its class name or id speaks against, 1 for what has a hint of that, else 0.
    """

    __slots__ = ("tag", "parent", "parts", "doubt", "beside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, doubt: int):
        self.tag, self.parent, self.doubt, self.beside, self.parts = tag, parent, doubt, False, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _doubt(tag: str, attributes: str, within: bool) -> int:
    """How sure the element itself is that it stands beside the article; ``within``: an article or main is open."""
    if tag in BESIDE or tag == "header" and not within:
        return 3
    if not attributes or tag not in BLOCK or tag in ("html", "body", "article", "main"):  # names of inline elements say how text looks
        return 0
    found = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in ROLES:
            return 3
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            found = max(found, 1)
        if name in ("class", "id"):
            for word in value.split():
                if word.startswith(("has-", "with-", "no-", "without-")):
                    continue
                parts = re.split(r"[^a-z0-9]+", word)
                if not COMMENTS.isdisjoint(parts):
                    return 3
                found = max(found, 2 * (not WORDS.isdisjoint(parts)), int(not HINTS.isdisjoint(parts)))
    return found


def parse(page: str) -> Node:
    """The page's tree. Open elements that HTML ends by itself are ended; unknown end tags are ignored."""
    root = now = Node("html", None, 0)
    at, end = 0, len(page)
    depth: dict[str, int] = {}
    last: dict[str, int] = {}  # where the page ends such an element for the last time
    while at < end:
        m = _PART.match(page, at)
        at = m.end()
        closed, opened, attributes, text, lone = m.groups()
        if text or lone:
            now.parts.append(text or lone)
        elif closed:
            closed = closed.lower()
            if depth.get(closed):
                while now.tag != closed:
                    depth[now.tag] -= 1
                    now = now.parent
                depth[closed] -= 1
                now = now.parent
        elif opened:
            tag = opened.lower()
            if tag in ("html", "head", "body"):
                continue
            ended = {"p"} if tag in BLOCK else set()
            for kinds in (ended, ENDS.get(tag, ())):
                top = now
                while kinds and top.parent and top.tag not in kinds and (top.tag not in BLOCK or top.tag == "p"):
                    top = top.parent
                if top.parent and top.tag in kinds:
                    while now is not top.parent:
                        depth[now.tag] -= 1
                        now = now.parent
            if tag in RAW:
                found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = found.end() if found else end
                continue
            if tag in ENDED:
                if tag not in last:
                    last[tag] = max((x.start() for x in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
                if last[tag] < at:
                    continue
            within = bool(depth.get("article") or depth.get("main"))
            node = Node(tag, now, _doubt(tag, attributes or "", within))
            now.parts.append(node)
            if tag not in VOID and not (attributes or "").endswith("/"):
                now = node
                depth[tag] = depth.get(tag, 0) + 1
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes of the subtree, parents first."""
    found = [root]
    for node in found:
        found.extend(p for p in node.parts if isinstance(p, Node))
    return found


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density: characters per tag, on a scale that falls with links; ``share``: of the body's characters in links."""
    if not chars:
        return 0.0
    plain, tags, links, link_tags = max(1, chars - link_chars), max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / plain * links + share * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / links * tags / link_tags)) / math.log(base)


def measure(root: Node) -> list[Node]:
    """Sets densities and density sums of all nodes, and returns the nodes.

    Sums leave out children that aren't article text by their element, role or class name.
    """
    nodes = _nodes(root)
    for node in reversed(nodes):
        node.chars += sum(len("".join(html.unescape(p).split())) for p in node.parts if isinstance(p, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    for node in nodes:  # a part of the page that holds more than half of all text, links apart, is no advert
        if node.doubt >= 2 and node.tag not in BESIDE and node.tags > 2 and 2 * (node.chars - node.link_chars) > root.chars - root.link_chars:
            node.doubt = 1
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        if node.parent and node.doubt < 2:
            node.parent.total += node.density
    return nodes


def mark(root: Node) -> float:
    """Marks the nodes that stand beside the article, and returns the threshold. Of equal sums, the first in the page's levels leads."""
    nodes = measure(root)
    shut: set[int] = set()  # what names or elements speak against, and all in it, doesn't lead to the article
    for node in nodes:
        if node.doubt >= 2 or id(node.parent) in shut:
            shut.add(id(node))
    best = max((n for n in nodes if id(n) not in shut), key=lambda n: n.total, default=root)
    path = [best]
    while path[-1].parent:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    top = next((n for n in reversed(path) if n.tag in ("article", "main")), None)
    inner = set(map(id, _nodes(top or best)))
    on_path = set(map(id, path))
    largest = max(best.total, best.density)
    for node in nodes:
        weight = max(node.total, node.density)
        if node.doubt >= 2:
            node.beside = node.doubt == 3 or weight < (STRONG if top is None or id(node) in inner else OUTSIDE) * largest
        elif id(node) in inner:
            links = node.link_tags > 1 and node.tag in BLOCK and node.tag != "p" and 10 * node.link_chars >= 9 * node.chars
            node.beside = (node.doubt == 1 or links) and id(node) not in on_path and node.density < threshold
        elif node.parent and id(node.parent) in on_path and id(node) not in on_path and node.chars and node.tag not in HEADING and node.tag != "article":
            node.beside = node.density < threshold or weight < (WEAK if node.chars > SHORT else WEAK_SHORT) * largest or node.doubt == 1 and top is not None and weight < OUTSIDE * largest
    return threshold


def blocks(nodes: list[Node]) -> list[str]:
    """The text of each block of what isn't beside the article, in page order, its white space made single spaces."""
    found, held = [], []

    def done() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            found.append(text)
        held.clear()

    for top in nodes:
        done()
        stack: list = [iter((top,))]
        while stack:
            part = next(stack[-1], None)
            if part is None:
                stack.pop()
            elif isinstance(part, str):
                held.append(part)
            elif part is _BREAK:
                done()
            elif part.tag == "br":
                held.append(" ")
            elif not part.beside:
                block = part.tag in BLOCK
                if block:
                    done()
                    stack.append(iter((_BREAK,)))
                stack.append(iter(part.parts))
            else:
                done()
        done()
    return found


_BREAK = object()


def main_text(page: str) -> str:
    """The page's main text, its blocks joined by line feeds."""
    if not page:
        return ""
    root = parse(page)
    mark(root)
    return "\n".join(blocks([root]))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keep`` of each row of ``pages``, with text and n_chars (its code points).

    Null or empty html gives an empty text. Repeated rows give a row each, nulls in the kept columns are kept, other
    columns are ignored. Pages of any length and depth and with unclosed or stray tags are read. An empty table gives an
    empty result.
    """
    rows = pages.select(*keep, text_of(html_col).alias("__html"))
    schema = StructType([*rows.schema.fields[:-1], StructField("text", StringType()), StructField("n_chars", LongType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page) for page in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    return rows.mapInArrow(texts, schema)
