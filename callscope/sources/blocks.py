"""Listing pages to links with what surrounds them: an Arrow function over the standard library's parser.

Only the parsing is here. What counts as a share link, a general label or a
heading is decided by the column rules of ``operators.extraction``.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

LINKS = "array<struct<kind: string, place: int, href: string, label: string, names: array<string>, headers: array<string>, lead: string, container: boolean, date_text: string, context: string>>"
#: Defaults: a wider surrounding text is passed over for a narrower one, a longer lead is cut (None lifts either).
SCAN_CONTEXT, LEAD = 5000, 160

# Where a block's heading is looked for, in this order.
HEADINGS = ("summary", ".accordion-header", ".accordion-button", ".card-header", ".panel-heading", "h1", "h2", "h3", "h4", "h5", ".titulo", ".title", ".field--name-title", "strong", "b")
CONTAINER = re.compile("accordion-item|panel|collapse|card", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SELF_CLOSING = frozenset("li p tr td th option dt dd".split())
_SILENT = frozenset(("script", "style", "template"))
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+\])*)")


class _Node:
    __slots__ = ("at", "attrs", "classes", "end", "heading", "parent", "tag", "text", "text_end")

    def __init__(self, tag, attrs, parent, at, text):
        self.tag, self.parent, self.at, self.text = tag, parent, at, text
        self.attrs = {k: v or "" for k, v in attrs}
        self.classes = frozenset(self.attrs.get("class", "").split())
        self.end = self.text_end = self.heading = None


class Page(HTMLParser):
    """Nodes and texts in document order; a node's content is a range of both."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[_Node] = []
        self.texts: list[str] = []
        self.open: list[_Node] = []
        try:
            self.feed(html)
            self.close()
        except Exception:  # a page that cannot be parsed gives what was read
            pass
        self._shut(0)

    def _shut(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            node.end, node.text_end = len(self.nodes), len(self.texts)

    def handle_starttag(self, tag, attrs):
        if tag in _SELF_CLOSING and self.open and self.open[-1].tag == tag:
            self._shut(len(self.open) - 1)
        self.nodes.append(_Node(tag, attrs, self.open[-1] if self.open else None, len(self.nodes), len(self.texts)))
        self.open.append(self.nodes[-1])
        if tag in _VOID:
            self._shut(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        self._shut(min(depth, len(self.open)))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag == tag:
                self._shut(depth)
                return

    def handle_data(self, data):
        if not (self.open and self.open[-1].tag in _SILENT):
            self.texts.append(data)

    def text_of(self, node: _Node, between: str = "") -> str:
        return " ".join(between.join(self.texts[node.text : node.text_end]).split())

    def inside(self, node: _Node) -> list[_Node]:
        return self.nodes[node.at + 1 : node.end]

    def headings(self, node: _Node, first, lead_chars: int | None = LEAD) -> tuple[list[str], str]:
        """Candidate headings of a block, best place first, and the beginning of its text."""
        if node.heading is None:
            wanted = [*([first] if first else []), *_DEFAULT]
            found: dict[int, _Node] = {}
            for n in self.inside(node):
                for i, s in enumerate(wanted):
                    if i not in found and matches(n, s):
                        found[i] = n
                if len(found) == len(wanted):
                    break
            node.heading = [self.text_of(found[i]) for i in sorted(found)], self.text_of(node)[:lead_chars]
        return node.heading


def selector(css: str | None) -> list | None:
    """A comma list of compounds (tag, .class, #id, [attribute]) joined by blanks or ``>``; None if it is anything else."""
    if not (css or "").strip():
        return None
    out = []
    for chain in css.split(","):
        steps, child = [], False
        for word in chain.replace(">", " > ").split():
            if word == ">":
                child = True
                continue
            m = _COMPOUND.fullmatch(word)
            if not m:
                return None
            marks = re.findall(r"[.#\[][\w-]+", m.group(2))
            steps.append((child, (m.group(1) or "*").lower(), frozenset(x[1:] for x in marks if x[0] == "."), [x[1:] for x in marks if x[0] == "#"], [x[1:].lower() for x in marks if x[0] == "["]))
            child = False
        if not steps or child or steps[0][0]:
            return None
        out.append(steps)
    return out


def _fits(node: _Node, step) -> bool:
    _, tag, classes, ids, attrs = step
    return tag in ("*", node.tag) and classes <= node.classes and all(node.attrs.get("id") == i for i in ids) and all(a in node.attrs for a in attrs)


def matches(node: _Node, chains: list) -> bool:
    def up(node: _Node | None, steps: list) -> bool:
        if node is None or not _fits(node, steps[-1]):
            return False
        if len(steps) == 1:
            return True
        above, only = node.parent, steps[-1][0]
        while above is not None:
            if up(above, steps[:-1]):
                return True
            above = None if only else above.parent
        return False

    return any(up(node, steps) for steps in chains)


_DEFAULT = [selector(s) for s in HEADINGS]


def _ancestors(node: _Node) -> list[_Node]:
    out, above = [], node.parent
    while above is not None and len(out) < 4 and above.tag not in ("body", "html"):
        out.append(above)
        above = above.parent
    return out


def links_of(html: str | None, css: str | None, title_css: str | None, date_css: str | None, widest: int | None = SCAN_CONTEXT, lead_chars: int | None = LEAD) -> list[dict]:
    """Every link of every block that ``css`` selects (kind ``selector``), then every link of the page (kind ``scan``)."""
    page = Page(html or "")
    blocks, titles, dates = selector(css), selector(title_css), selector(date_css)
    out: list[dict] = []

    def add(kind, a, headers, lead, container, date_text, context):
        names = [n for n in (" ".join(a.attrs.get(k, "").split()) for k in ("title", "aria-label")) if n]
        out.append({"kind": kind, "place": len(out), "href": a.attrs["href"].strip(), "label": page.text_of(a), "names": names, "headers": headers, "lead": lead, "container": container, "date_text": date_text, "context": context})

    for block in (n for n in page.nodes if blocks and matches(n, blocks)):
        headers, lead = page.headings(block, titles, lead_chars)
        dated = next((n for n in page.inside(block) if dates and matches(n, dates)), None)
        around = page.text_of(block, " ")
        container = block.tag == "details" or bool(CONTAINER.search(block.attrs.get("class", "")))
        for a in [block, *page.inside(block)]:
            if a.tag == "a" and a.attrs.get("href"):
                add("selector", a, headers, lead, container, page.text_of(dated) if dated else "", around)
    for node in page.nodes:
        node.heading = None
    for a in page.nodes:
        if a.tag == "a" and "href" in a.attrs:
            headers, around = [], ""
            for above in _ancestors(a):
                found, lead = page.headings(above, None, lead_chars)
                headers += [*found, lead]
                if len(around) < 60:
                    text = page.text_of(above, " ")
                    around = text if 20 <= len(text) and (widest is None or len(text) <= widest) else around
            add("scan", a, list(dict.fromkeys(headers)), "", False, "", around)
    return out


def listing_links(css: str | None, title_css: str | None = None, date_css: str | None = None, widest: int | None = SCAN_CONTEXT, lead_chars: int | None = LEAD):
    """A column function over HTML. ``widest``: characters of the widest text around a link of a whole page; ``lead_chars``: of a text that stands in for a heading. None lifts either."""

    @F.pandas_udf(LINKS)
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda page: links_of(page, css, title_css, date_css, widest, lead_chars))

    return run
