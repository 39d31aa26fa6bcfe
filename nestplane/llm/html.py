"""Main-text extraction by composite text density (Sun, Song and Liao, SIGIR 2011).

The page becomes a tree of block elements, without the parts that are never main text (menus, page heads
and feet, asides, form controls, scripts). Forms and parts named as adverts, notices and the like are only suspects: they go
if they are link-heavy, hold few plain characters a tag against the rest of the page, or are scraps without paragraph or heading. Readers' comments,
which read like the article, go by their name while they are the lesser part of the page. Each node's density is its characters per
tag, lowered for the share of link text against the body's. The node with the greatest sum of child
densities is taken, then widened upwards while the parent is at least as dense as the body as a whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not markup (fixed by HTML).
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
DROPPED = RAW | set("head nav header footer aside button select noscript template svg canvas object audio video menu dialog".split())
#: Elements that may stand in a page's head (fixed by HTML); the first other start tag ends a head.
HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements whose names never make them unwanted: what they hold is text of its own or the page.
TEXTUAL = set("html body article main p h1 h2 h3 h4 h5 h6".split())
#: A suspect part is cut if this share of its text is link text, ...
LINKED = 0.5
#: ... or if it has at most this share of the plain characters a tag of what is not suspect, ...
THIN = 0.5
#: ... or if it has neither paragraph nor heading, and the page an article elsewhere or the part fewer characters than this.
SPARSE = 200
#: Readers' comments are cut if they are at most this share of the page's text.
MINOR = 0.4
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd".split())
#: Elements that stay inside the block they stand in.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open paragraph (fixed by HTML).
ENDS_P = set("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Start tags that end an open element of the group, up to the container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of a class, id or role that make a part suspect of not being main text.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|sidebar|side|footer|header|masthead|cookie|cookies|consent|notice|notices|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comment|comments|discussion|disqus|replies|widget|pagination|pager|search)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: Names of readers' comments.
REPLIES = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus|replies)(?=$|[\s_-])", re.IGNORECASE)
OPENED = re.compile(r"<(?:!--|([/]?)([a-zA-Z][^\s/<>]*)|[!?/])")
MARK = re.compile("[>\"']")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.IGNORECASE)


class Node:
    __slots__ = ("name", "parent", "children", "dropped", "suspect", "replies", "link", "density", "total", "chars", "tags", "linked", "link_tags")

    def __init__(self, name: str, parent: Node | None, dropped: bool = False, link: bool = False):
        self.name, self.parent, self.dropped, self.link = name, parent, dropped, link
        self.suspect = self.replies = False
        self.children: list[Node | str] = []
        self.chars = self.tags = self.linked = self.link_tags = 0
        self.density = self.total = 0.0


def unwanted(name: str, attributes: str) -> bool:
    return name in DROPPED or (name not in TEXTUAL and bool(attributes) and bool(HIDDEN.search(attributes)))


def named(name: str, attributes: str, words: re.Pattern) -> bool:
    return name not in TEXTUAL and bool(attributes) and any(words.search(a or b or c) for a, b, c in NAMES.findall(attributes))


class Size(NamedTuple):
    chars: int = 0
    linked: int = 0
    tags: int = 0
    holds: bool = False  # the page's article
    told: bool = False  # a paragraph or heading

    def plus(self, other: Size) -> Size:
        return Size(self.chars + other.chars, self.linked + other.linked, self.tags + other.tags, self.holds or other.holds, self.told or other.told)

    def density(self) -> float:
        return (self.chars - self.linked) / max(1, self.tags)


def cut(root: Node) -> None:
    """Drops suspect parts, outer ones first; one that holds the page's ``article`` or ``main``, or all of its text, stays unless it is link-heavy.

    Below an article a suspect part is a section of the text unless it is link-heavy.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    if not any(n.suspect for n in order):
        return
    sizes: dict[Node, Size] = {}
    plain: dict[Node, Size] = {}  # without suspect parts
    for node in reversed(order):
        n = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        size = rest = Size(n, n * node.link, node.name not in INLINE, node.name in ("article", "main"), node.name in PARAGRAPHS)
        for c in node.children:
            if isinstance(c, Node) and not c.dropped:
                size, rest = size.plus(sizes[c]), rest.plus(plain[c])
        sizes[node] = size._replace(holds=size.holds and size.chars > 0)
        plain[node] = Size() if node.suspect else rest
    whole, marked, rest = sizes[root].chars, sizes[root].holds, plain[root]
    usual = rest.density() if rest.chars >= SPARSE else 0.0
    inside: set[Node] = set()
    for node in order:
        if node.parent is not None and (node.parent.dropped or node.parent in inside):
            (inside.add(node) if node.parent in inside else None)
            node.dropped = node.dropped or node.parent.dropped
        if node.name in ("article", "main"):
            inside.add(node)
        if node.suspect and not node.dropped:
            own = sizes[node]
            node.dropped = own.linked > LINKED * own.chars
            if not node.dropped and not own.holds and node not in inside and own.chars < whole:
                sparse = not own.told and (marked or own.chars < SPARSE)
                node.dropped = sparse or own.density() <= THIN * usual or (node.replies and own.chars <= MINOR * whole)


class Scanner:
    """The tags of a page, one after the other, in time linear in the page: what is known to be missing is not looked for again."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last = {mark: page.rfind(mark) for mark in ">\"'<"}

    def next(self) -> tuple[int, str, str, str] | None:
        """``(start, slash, name, attributes)`` of the next tag (no name: a comment or declaration); ``at`` is its end."""
        page = self.page
        while m := OPENED.search(page, self.at):
            if m[0] == "<!--":
                stop = page.find("-->", m.end())
                self.at = len(page) if stop < 0 else stop + 3
                return m.start(), "", "", ""
            if not m[2]:
                stop = page.find(">", m.end())
                self.at = len(page) if stop < 0 else stop + 1
                return m.start(), "", "", ""
            stop = self.end_of(m.end())
            if stop >= 0:
                self.at = stop
                return m.start(), m[1], m[2].lower(), page[m.end() : stop - 1]
            if self.last["<"] == m.start():  # the page breaks off in a tag
                self.at = len(page)
                return m.start(), "", "", ""
            self.at = m.end()
        return None

    def end_of(self, at: int) -> int:
        """Where a tag ends whose attributes begin ``at``, or -1. An opening quote that nothing closes is a character."""
        while at <= self.last[">"]:
            m = MARK.search(self.page, at)
            if m[0] == ">":
                return m.end()
            close = self.page.find(m[0], m.end()) if m.end() <= self.last[m[0]] else -1
            at = m.end() if close < 0 else close + 1
        return -1


class Builder:
    """The open elements while a page is read, and how many of each name there are."""

    def __init__(self, root: Node):
        self.node, self.count = root, Counter([root.name])

    def enter(self, node: Node) -> None:
        self.node = node
        self.count[node.name] += 1

    def back_to(self, node: Node) -> None:
        while self.node is not node:
            self.count[self.node.name] -= 1
            self.node = self.node.parent

    def close(self, names: set[str], limits: set[str]) -> None:
        """End the nearest open element of ``names`` this side of ``limits``; except for paragraphs, those around it too."""
        while any(self.count[n] for n in names):
            seen: Node | None = self.node
            while seen is not None and seen.name not in limits and seen.name not in names:
                seen = seen.parent
            if seen is None or seen.name in limits or seen.parent is None:
                return
            self.back_to(seen.parent)
            if names == {"p"}:
                return

    def end(self, name: str) -> None:
        if self.count[name]:
            node = self.node
            while node.name != name:
                node = node.parent
            if node.parent is not None:
                self.back_to(node.parent)


def tree(page: str) -> Node:
    """The page's elements; unclosed and crossing tags are mended much as browsers do."""
    root = Node("body", None)
    build, scan, at = Builder(root), Scanner(page), 0
    while True:
        found = scan.next()
        stop = found[0] if found else len(page)
        if stop > at:
            if build.node.name == "head" and not page[at:stop].isspace():
                build.back_to(out_of_head(build.node))
            build.node.children.append(page[at:stop])
        if not found:
            break
        _, slash, name, attributes = found
        at = scan.at
        if not name:
            continue
        if slash:
            build.end(name)
            continue
        if name == "body" or (name != "html" and name != "head" and name not in HEAD):
            build.back_to(out_of_head(build.node))
        if name in ("html", "body"):
            continue
        if name in ENDS_P:
            build.close({"p"}, {"table", "td", "th", "button"})
        if name in SIBLINGS:
            build.close(*SIBLINGS[name])
        above = build.node
        node = Node(name, above, above.dropped or unwanted(name, attributes), above.link or name == "a")
        node.suspect = name == "form" or named(name, attributes, MARKED)
        node.replies = node.suspect and named(name, attributes, REPLIES)
        above.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = scan.at = end.end() if end else len(page)
        elif name not in VOID and not attributes.endswith("/"):
            build.enter(node)
    cut(root)
    return root


def out_of_head(node: Node) -> Node:
    """Where we stand once an open head (nothing open in it but elements of a head) has ended."""
    seen: Node | None = node
    while seen is not None and seen.name in HEAD:
        seen = seen.parent
    return seen.parent if seen is not None and seen.name == "head" and seen.parent is not None else node


def measured(root: Node) -> list[Node]:
    """Counts and densities of every wanted block, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    order.reverse()
    for node in order:
        for c in node.children:
            if isinstance(c, str):
                n = len("".join(c.split()))
                node.chars += n
                node.linked += n * node.link
            elif not c.dropped:
                node.chars += c.chars
                node.linked += c.linked
                node.tags += c.tags + (c.name not in INLINE)
                node.link_tags += c.link_tags + (c.name == "a")
    whole = max(1, root.chars)
    for node in order:
        if node.chars:
            tags, plain = max(1, node.tags), max(1, node.chars - node.linked)
            base = math.log(node.chars / plain * node.linked + root.linked / whole * node.chars + math.e)
            node.density = node.chars / tags * max(0.0, math.log(node.chars / max(1, node.linked) * tags / max(1, node.link_tags) + 1e-9) / math.log(base + 1e-9) if base > 1.01 else math.log(node.chars * tags + 1))
    for node in order:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.dropped and c.name not in INLINE)
    return order


def main_node(root: Node) -> Node:
    best = max(reversed(measured(root)), key=lambda n: n.total)  # the outermost of equal ones
    if best.total <= 0:
        return root
    while best.parent is not None and best.parent.parent is not None and best.parent.density >= root.density:
        best = best.parent
    if best.parent is root and any(isinstance(c, Node) and c is not best and not c.dropped and c.name not in INLINE and c.density >= root.density for c in root.children):
        return root
    return best


def blocks(node: Node) -> list[str]:
    """Text of each block below a node, in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.name == "br":
            held.append(" ")
        elif not x.dropped:
            if x.name not in INLINE:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The page's main text, a block a line; empty for a null or empty page or one without text."""
    return "\n".join(blocks(main_node(tree(page)))) if page else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) instead of ``html_col`` (columns of these names, in any case, are replaced)."""
    kept = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(len(kept))]
            out = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*kept, "text", "n_chars"])

    return pages.select(*kept, F.col(html_col).cast("string").alias(html_col)).mapInArrow(run, schema)
