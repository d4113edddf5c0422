"""Main-text extraction from HTML by tree scoring.

A tolerant parser builds a tree of block elements. Every paragraph-like block
passes points for its length and its commas to its ancestors, in full to the
first two and halved at each further level, and each candidate's sum is
discounted by its link density. Both steps read a page about once, however its
tags are nested or left open.
The best container is kept with its siblings. Inside an article or main element
of few links that element is the container, whole, and its siblings stay if they
score enough of its points or read like prose. Elsewhere the container is the
outermost element around the best one that has few links and holds no page
furniture (boilerplate blocks) itself, and its siblings and the loose text between
them stay unless they are mostly links: no block is judged by its length. Of equal
containers the inner one, or else the first, is the best. Navigation, headers,
footers, sidebars, notices, adverts, forms, comments and code never enter the tree.

Defined results: a null page counts as empty; a page without readable text
gives the empty string; rows are independent, so repeated rows and null keys
each give a result; an empty table gives an empty one; extra columns are ignored;
pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

#: HTML's own element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An element of the key closes an open one of the values, up to the nearest of the scope.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Never main text: by element, by role, by a word of class or id.
DROPPED = frozenset("nav header footer aside form script style button select input textarea iframe noscript template svg canvas object embed menu dialog head title".split())
#: Those of them that stand inside articles too.
WIDGETS = frozenset("head title form script style button select input textarea iframe noscript template svg canvas object embed".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promoted sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside rail footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments discussion disqus respond replies share sharing social related recommended recommendations pagination pager toolbar widget skip".split()
)
#: Those of them that count at the start or end of a name whatever else it says; words that tell of a layout.
STRONG_WORDS = frozenset("ad ads advert advertisement comment comments sidebar footer cookie nav navigation disqus sponsored promo notice".split())
LAYOUT_WORDS = frozenset("has with no without layout col cols column columns grid".split())
#: Words of class or id that keep an element in spite of the list above.
KEPT_WORDS = frozenset("article main content body post entry story".split())
KEPT_TAGS = frozenset("html body main article".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")
_COMMAS = re.compile("[,،、，]")


class Node:
    """An element: `first` and `last` bound the blocks inside it, in page order."""

    __slots__ = ("tag", "parent", "up", "items", "dropped", "link", "hint", "first", "last", "own", "below", "furnished")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool, hint: float = 0.0):
        self.tag, self.parent, self.dropped, self.hint = tag, parent, dropped, hint
        #: strings, nodes in page order
        self.items: list = []
        self.link = tag == "a"
        #: the nearest element around that isn't inline
        self.up: "Node | None" = None
        self.first = self.last = 0
        #: points of the blocks directly inside; of those further below, halved at each level after the first
        self.own = self.below = 0.0
        #: whether boilerplate stands directly inside
        self.furnished = False


def _is_dropped(tag: str, raw: str) -> tuple[bool, float]:
    """Whether boilerplate; and a hint that a container holds an article."""
    if tag in DROPPED:
        return True, 0.0
    if not raw.strip(" /\t\n"):
        return False, 25.0 if tag in ("article", "main") else 0.0
    at = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        at.setdefault(name.lower(), a or b or c)
    if at.get("role", "").lower() in DROPPED_ROLES or "hidden" in at or at.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", "")):
        return tag not in KEPT_TAGS, 0.0
    names = [[w.lower() for w in _WORD.findall(n)] for n in f"{at.get('class', '')} {at.get('id', '')}".split()]
    kept = tag in KEPT_TAGS or any(w in KEPT_WORDS for n in names for w in n)
    return tag not in KEPT_TAGS and any(_names_boilerplate(n, kept) for n in names if n), 25.0 if kept else 0.0


def _names_boilerplate(words: list[str], kept: bool) -> bool:
    """`ad-box`, `page-sidebar` and `post-comments` do; `has-sidebar` tells of a layout, and `content-menu-space` of content."""
    if words[0] in DROPPED_WORDS and not (kept and words[0] not in STRONG_WORDS):
        return True
    if set(words) & LAYOUT_WORDS:
        return False
    return words[-1] in STRONG_WORDS or not kept and bool(set(words) & DROPPED_WORDS)


class _Tags:
    """Ends of tags in a page. Each call starts after the last one's end, so a page is read about once.

    A quote counts where a value begins. One that is never closed is none from
    there on, as in a tag left open by an editor; a tag without an end takes in
    the rest of the page.
    """

    def __init__(self, page: str):
        self.page, self.quotes = page, "\"'"
        self._look()

    def _look(self) -> None:
        self.next = re.compile(rf">|=\s*[{self.quotes}]" if self.quotes else ">")

    def end(self, at: int) -> int:
        while True:
            m = self.next.search(self.page, at)
            if m is None:
                return len(self.page)
            if m[0] == ">":
                return m.start()
            close = self.page.find(m[0][-1], m.end())
            if close < 0:
                # none of its kind follows anywhere: from now on it doesn't count
                self.quotes = self.quotes.replace(m[0][-1], "")
                self._look()
                at = m.end()
            else:
                at = close + 1


class _Open:
    """The open elements from the root down, with the places of each tag, so closing one looks at no others."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        """Close all elements from a place on."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else 0

    def close(self, tag: str) -> None:
        place = self.last(tag)
        if place and not (tag in INLINE and any(self.last(t) > place for t in ("article", "main", "section", "table"))):
            self.cut(place)

    def close_within(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Close the outermost open element of `tags` that is inside the nearest element of `scope`."""
        border = max(self.last(t) for t in scope)
        inside = [found[i] for found in (self.places.get(t, []) for t in tags) if (i := bisect_right(found, border)) < len(found)]
        if inside:
            self.cut(min(inside))


def parse(page: str) -> Node:
    root = Node("html", None, False)
    opened, tags, here, n = _Open(root), _Tags(page), 0, len(page)
    while here < n:
        start = page.find("<", here)
        if start < 0 or start == n - 1:
            _add_text(opened.top, page[here:])
            break
        closing = page[start + 1] == "/"
        name = _NAME.match(page, start + 1 + closing)
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = n if end < 0 else end + 3
        elif page[start + 1] in "!?":
            end = page.find(">", start)
            end = n if end < 0 else end + 1
        elif name is None:  # no tag
            _add_text(opened.top, page[here : start + 1])
            here = start + 1
            continue
        else:
            stop = tags.end(name.end())
            raw, end = page[name.end() : stop], min(n, stop + 1)
        if start > here:
            _add_text(opened.top, page[here:start])
        here = end
        if name is None:
            continue
        tag = name[0].lower()
        if closing:
            opened.close(tag)
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, here)
            here = n if found is None else min(n, tags.end(found.end()) + 1)
            continue
        if tag in ("html", "body", "head"):
            if tag == "body" and opened.top.tag == "head":
                opened.cut(len(opened.stack) - 1)
            if tag == "head":
                node = Node("head", opened.top, True)
                opened.top.items.append(node)
                opened.push(node)
            continue
        if opened.top.tag == "head" and tag not in ("meta", "link", "base"):
            opened.cut(len(opened.stack) - 1)
        if tag in CLOSES_P:
            opened.close_within(("p",), ("td", "th", "table", "button", "object"))
        elif tag in IMPLIED:
            opened.close_within(*IMPLIED[tag])
        at = opened.top
        if tag in VOID:
            at.items.append(" " if tag in ("br", "wbr") else Node(tag, at, True))
            continue
        dropped, hint = _is_dropped(tag, raw)
        node = Node(tag, at, dropped, hint)
        at.items.append(node)
        if not raw.rstrip().endswith("/") or tag not in ("path", "circle", "rect", "use", "line"):
            opened.push(node)
    return root


def _add_text(at: Node, raw: str) -> None:
    at.items.append(html.unescape(raw) if "&" in raw else raw)


class Block:
    __slots__ = ("text", "links", "node")

    def __init__(self, text: str, links: int, node: Node):
        self.text, self.links, self.node = text, links, node


def blocks(root: Node) -> tuple[list[Block], list[Node]]:
    """Runs of inline content between block borders, in page order, boilerplate left out; the elements, inner ones first."""
    out: list[Block] = []
    closed: list[Node] = []
    parts: list[str] = []
    links = 0

    def flush(node: Node) -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, min(links, len(text)), node))
            parts.clear()
        links = 0

    stack: list[tuple[Node, Node, int, bool]] = [(root, root, 0, False)]
    while stack:
        node, block, i, linked = stack.pop()
        while i < len(node.items):
            item = node.items[i]
            i += 1
            if isinstance(item, str):
                parts.append(item)
                if linked:
                    links += len(_SPACE.sub(" ", item).strip())
            elif item.dropped:
                if item.tag not in INLINE and item.tag not in VOID:
                    flush(block)
                    block.furnished |= item.tag not in WIDGETS
            else:
                inline = item.tag in INLINE
                if not inline:
                    flush(block)
                    item.first, item.up = len(out), block
                stack.append((node, block, i, linked))
                stack.append((item, block if inline else item, 0, linked or item.link))
                break
        else:
            if node is block:
                flush(block)
                node.last = len(out)
                closed.append(node)
    return out, closed


def extract(page: str) -> str:
    """The main text: blocks joined by newlines, white space inside them by blanks."""
    found, closed = blocks(parse(page))
    if not found:
        return ""
    length, linked = [0], [0]
    for b in found:
        length.append(length[-1] + len(b.text))
        linked.append(linked[-1] + b.links)
    size = lambda n: length[n.last] - length[n.first]
    density = lambda n: (linked[n.last] - linked[n.first]) / max(1, size(n))
    prose = [b for b in found if len(b.text) >= 25 and b.node.tag not in ("li", "dt", "dd", "option")]
    for b in prose:
        b.node.own += 1.0 + len(_COMMAS.findall(b.text)) + min(len(b.text) / 100.0, 3.0)
    if not prose:
        for b in found:
            b.node.own += len(b.text) / 100.0
    # inner elements come first, so one pass carries all points up
    final = {}
    for node in closed:
        if node.up is not None:
            node.up.below += node.own + node.below / 2
        if node.own + node.below > 0 and node.last > node.first:
            own = 0.0 if prose and node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre") else node.own
            if own + node.below > 0:
                final[node] = (own + node.below + node.hint) * (1 - density(node))
    best = max(final, key=final.get)
    enough = max(10.0, 0.2 * final[best])
    # a section of an article has won: the article stays whole
    around = best
    while around is not None and not (around.tag in ("article", "main") and density(around) < 0.25):
        around = around.parent
    best = around or best
    if around is None:
        while best.up is not None and not best.up.furnished and density(best.up) < 0.25:
            best = best.up
    keep = [(best.first, best.last)]
    for x in best.parent.items if best.parent is not None else ():
        if isinstance(x, Node) and x is not best and x.last > x.first:
            said = x.tag in ("p", "blockquote", "pre") and density(x) < 0.25 and size(x) >= 80
            title = x.tag in ("h1", "h2") and density(x) < 0.25
            if final.get(x, 0.0) >= enough or said or title or around is None and density(x) < 0.25:
                keep.append((x.first, x.last))
    if around is None and best.up is not None:
        keep += [(i, i + 1) for i in range(best.up.first, best.up.last) if found[i].node is best.up and found[i].links < 0.25 * len(found[i].text)]
    return "\n".join(found[i].text for i in sorted({i for a, z in keep for i in range(a, z)}))


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per page: the kept columns, its main text and the text's number of code points."""
    small_batches(pages.sparkSession)
    picked = pages.select(*(F.col(c) for c in keep), text_or_empty(html_col).alias("_html"))

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column("_html").to_pylist()]
            columns = [batch.column(c) for c in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    fields = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{fields}, text string, n_chars long")
