"""A forgiving HTML reader: from a page's source to a tree of elements and texts.

Time grows in proportion to the page, however broken: the source is scanned
once, and open elements are found by the depths at which each tag is open.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

#: The start of a start or end tag, and what stands before its next quote or end.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Roots of foreign content, in which a tag may close itself and which a block of HTML ends.
FOREIGN = frozenset("svg math".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: start tag -> open elements that it closes, up to the nearest of the last set.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Elements whose text stands in a line with what surrounds it.
INLINE = frozenset("annotation maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics svg text tspan canvas audio video object a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark output q s samp small span strike strong sub sup time tt u var wbr".split())
#: An end tag of a block closes whatever is open inside the block.
SPECIAL = frozenset("body article section main div table ul ol dl nav aside header footer form td th li blockquote figure".split())


class Node:
    """An element; ``children`` are nodes and strings in page order."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(source)}


class Open:
    """The open elements: their path from the root, and for each tag the depths at which it is open."""

    def __init__(self, root: Node):
        self.path, self.depths, self.special = [root], {}, []

    @property
    def at(self) -> Node:
        return self.path[-1]

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.path))
        if node.tag in SPECIAL:
            self.special.append(len(self.path))
        self.path.append(node)

    def close(self, depth: int) -> None:
        """Close the element at ``depth`` and all inside it."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.depths[tag].pop()
            if tag in SPECIAL:
                self.special.pop()

    def last(self, *tags: str) -> int:
        """The depth of the innermost open element with one of the tags; 0 (the root's) without one."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def barrier(self) -> int:
        return self.special[-1] if self.special else 0

    def foreign(self) -> int:
        """The depth of the svg or math element around, if no element of HTML stands between; else 0."""
        depth = self.last(*FOREIGN)
        return depth if depth > max(self.barrier(), self.last("foreignobject")) else 0


class Source:
    """A page and what is known of its rest, so that nothing is sought twice."""

    def __init__(self, page: str):
        self.page, self.quotes, self.endless = page, True, set()

    def tag_end(self, place: int) -> int:
        """The place of the > that ends a tag; quoted ones do not count, unless quotes are broken.  -1 without one."""
        page, at = self.page, place
        while self.quotes:
            at = PLAIN.match(page, at).end()
            if at == len(page):
                self.quotes = False
            elif page[at] == ">":
                return at
            else:
                closed = page.find(page[at], at + 1)
                if closed < 0:
                    self.quotes = False
                at = closed + 1
        return page.find(">", place)

    def raw_end(self, tag: str, place: int) -> int:
        """The place after the end tag of raw text; -1 without one."""
        if tag in self.endless:
            return -1
        end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, place)
        if end is None:
            self.endless.add(tag)
        return end.end() if end else -1


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are mended as browsers do, scripts and styles are dropped."""
    root = Node("#root", {}, None)
    open_, source = Open(root), Source(page)
    place, n = 0, len(page)

    def text(start: int, end: int) -> None:
        if end > start:
            open_.at.children.append(html.unescape(page[start:end]))

    said = place
    while (place := page.find("<", place)) >= 0:
        if page.startswith("<!--", place):
            text(said, place)
            end = page.find("-->", place + 4)
            place = said = end + 3 if end >= 0 else n
            continue
        m = TAG.match(page, place)
        if m is None and page[place + 1 : place + 2] not in ("!", "?"):
            place += 1
            continue
        end = page.find(">", place) if m is None else source.tag_end(m.end())
        if end < 0:
            break
        text(said, place)
        place = said = end + 1
        if m is None:
            continue
        tag, rest = m[2].lower(), page[m.end() : end]
        if m[1]:
            depth = open_.last(tag)
            if depth and (tag in SPECIAL or depth > open_.barrier()):
                open_.close(depth)
            continue
        if tag in ENDS_P:
            while depth := open_.foreign():
                open_.close(depth)
            depth = open_.last("p")
            if depth > max(open_.barrier(), open_.last("button")):
                open_.close(depth)
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            least = open_.last(*stop)
            inside = [d[k] for t in closed if (d := open_.depths.get(t)) and (k := bisect_right(d, least)) < len(d)]
            if inside:
                open_.close(min(inside))
        node = Node(tag, attributes(rest) if rest else {}, open_.at)
        open_.at.children.append(node)
        if tag in VOID or rest.rstrip().endswith("/") and (tag in RAW or tag in FOREIGN or tag not in SPECIAL and tag != "foreignobject" and open_.foreign()):
            continue
        if tag in RAW:
            end = source.raw_end(tag, place)
            place = said = end if end >= 0 else n if tag in ("script", "style") else place
            continue
        open_.push(node)
    text(said, n)
    return root


def text_of(node: Node) -> str:
    """All text below a node."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack.extend(reversed(x.children))
    return "".join(out)
