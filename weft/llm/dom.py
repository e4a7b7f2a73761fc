"""A small DOM of blocks and runs of text, and the features of its nodes."""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style iframe template textarea title".split())
BLOCK = set(
    "html head body article section main div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary select option button label dialog menu center hgroup legend".split()
)
#: A start tag on the left ends an open element on the right, if one is open within the nearest container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = set("html body ul ol dl table div article section main nav aside form header footer td th blockquote select".split())
_ENDS_P = BLOCK - {"label", "button", "option", "select", "html", "head", "body"}

TAGS = "article main section div p h1 h2 h3 h4 ul ol li nav header footer aside form table td blockquote pre figure figcaption dl body button select label #text".split()
#: Words in class, id, role and itemprop are hashed into so many features.
WORDS = 128
_TAG_OF = {t: i for i, t in enumerate(TAGS)}
#: Ancestors that are features: their presence anywhere above.
ABOVE = "nav header footer aside form article main ul table".split()


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    words: int = 0  # bits of the hashed attribute words
    text: str = ""  # of a run, with white space as it is
    links: int = 0  # characters of a run inside links
    children: list[int] = field(default_factory=list)


def _words(attrs: str) -> int:
    found = 0
    if "=" in attrs:
        for _, a, b, c in _ATTR.findall(attrs):
            for w in _WORD.findall(a or b or c):
                found |= 1 << zlib.crc32(w.lower().encode()) % WORDS
    return found


class _TagEnds:
    """Where tags end: at the first ``>`` outside quotes, or at the first at all if a quote isn't closed. Linear in the page, whatever its quotes."""

    _TRIES = 64

    def __init__(self, page: str):
        self.page = page
        self.places: list[int] | None = None

    def of(self, at: int) -> int:
        """The end of the tag whose name ends at ``at``; some ``>`` has to follow."""
        page, here = self.page, at
        for _ in range(self._TRIES):
            m = _SPECIAL.search(page, here)
            if m is None:
                return page.find(">", at)
            if m[0] == ">":
                return m.start()
            here = page.find(m[0], m.end()) + 1
            if not here:
                return page.find(">", at)
        if self.places is None:
            self._list_all()
        i = bisect_left(self.places, at)
        return self.ends[i] if self.ends[i] >= 0 else page.find(">", at)

    def _list_all(self) -> None:
        """For each quote and ``>`` of the page, from the last to the first, where a tag ends that goes on there outside quotes; -1: nowhere."""
        self.places = [m.start() for m in _SPECIAL.finditer(self.page)]
        n = len(self.places)
        self.ends = [-1] * (n + 1)
        following: dict[str, int] = {}
        for i in range(n - 1, -1, -1):
            c = self.page[self.places[i]]
            if c == ">":
                self.ends[i] = self.places[i]
            else:
                self.ends[i] = self.ends[following[c] + 1] if c in following else -1
                following[c] = i


class _Open:
    """Open elements, inline ones with their block's number; knows for each name where it is open, so that nothing is searched."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("#root", 0)]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]

    def push(self, tag: str, number: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, number))

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.places[tag].pop()
        if tag in _SCOPE:
            self.scopes.pop()
        return tag

    def last(self, tag: str) -> int:
        """Where the innermost element of a name is open; 0 if there is none."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def ended_by(self, tag: str) -> int:
        """The innermost element that a start tag ends, within the nearest container; 0 if there is none."""
        names = _ENDS.get(tag, ())
        found = max(map(self.last, names), default=0)
        if tag in _ENDS_P:
            found = max(found, self.last("p"))
        return found if found >= self.scopes[-1] else 0


def parse(page: str) -> list[Node]:
    """Nodes in page order, the root first: block elements, and runs of text (tag ``#text``) between block borders.

    Scripts, styles, comments and other raw elements have no nodes; text in math, svg, object and noscript is text like any. Ends of paragraphs, list items and table parts may
    be missing, as may any others; ends without a start are ignored. Time is linear in the page's length, whatever it holds.
    """
    nodes = [Node("#root", -1, 0)]
    opened = _Open()
    stack = opened.stack
    parts: list[str] = []
    in_links = 0
    linked = 0
    ends = _TagEnds(page)

    def flush() -> None:
        nonlocal linked
        text = "".join(parts)
        parts.clear()
        if not text.isspace() and text:
            owner = stack[-1][1]
            nodes[owner].children.append(len(nodes))
            nodes.append(Node("#text", owner, nodes[owner].depth + 1, 0, text, linked))
        linked = 0

    def close(index: int) -> None:
        nonlocal in_links
        flushed = False
        while len(stack) > index:
            if not flushed and stack[-1][0] in BLOCK:
                flush()
                flushed = True
            in_links -= opened.pop() == "a"

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text)
            parts.append(text)
            if in_links:
                linked += len(text)

    size, last_end = len(page), page.rfind(">")
    at = seek = 0
    while True:
        here = page.find("<", seek)
        if here < 0:
            add(page[at:])
            break
        if last_end < here:  # no tag ends any more
            comment = page.find("<!--", here)
            add(page[at:comment] if comment >= 0 else page[at:])
            break
        m = _TAG.match(page, here)
        if m:
            end, tag, attrs = m.groups()
            stop = m.end()
        elif name := _NAME.match(page, here):
            end, tag = name.groups()
            stop = ends.of(name.end()) + 1
            attrs = page[name.end() : stop - 1]
        elif page.startswith("<!--", here):
            add(page[at:here])
            stop = page.find("-->", here + 4)
            at = seek = size if stop < 0 else stop + 3
            continue
        elif page[here + 1] in "!?/":
            add(page[at:here])
            at = seek = page.find(">", here) + 1
            continue
        else:
            seek = here + 1
            continue
        add(page[at:here])
        at = seek = stop
        tag = tag.lower()
        if end:
            if found := opened.last(tag):
                close(found)
        elif tag in RAW:
            if not attrs.endswith("/"):
                closed = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = seek = closed.end() if closed else size
        elif tag in VOID:
            if tag in ("br", "hr", "img"):
                parts.append(" ")
        elif tag in BLOCK:
            while found := opened.ended_by(tag):
                was = stack[found][0]
                close(found)
                if was == "p" or tag != "tr":
                    break
            flush()
            owner = stack[-1][1]
            number = len(nodes)
            nodes[owner].children.append(number)
            nodes.append(Node(tag, owner, nodes[owner].depth + 1, _words(attrs)))
            opened.push(tag, number)
        else:
            in_links += tag == "a"
            opened.push(tag, stack[-1][1])
    flush()
    return nodes


N_FEATURES = len(TAGS) + 2 * WORDS + len(ABOVE) + 20


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: tag, attribute words of itself and above, ancestors, subtree density, depth, siblings and place."""
    n = len(nodes)
    x = np.zeros((n, N_FEATURES), np.float32)
    chars, links, words, stops, elements, runs = (np.zeros(n) for _ in range(6))
    above, tags_above = [0] * n, [0] * n
    order = np.zeros(n)
    seen = 0
    above_bit = {t: 1 << i for i, t in enumerate(ABOVE)}
    for i, d in enumerate(nodes):
        order[i] = seen
        if d.parent >= 0:
            above[i] = above[d.parent] | nodes[d.parent].words
            tags_above[i] = tags_above[d.parent] | above_bit.get(nodes[d.parent].tag, 0)
        if d.tag == "#text":
            chars[i], links[i], words[i] = len(d.text), min(d.links, len(d.text)), d.text.count(" ") + 1
            stops[i] = d.text.count(".") + d.text.count(",") + d.text.count("?") + d.text.count("!")
            runs[i] = 1
            seen += len(d.text)
        else:
            elements[i] = 1
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for c in (chars, links, words, stops, elements, runs):
            c[p] += c[i]
    total = max(1.0, float(chars[0]))
    at = 0
    for i, d in enumerate(nodes):
        if (t := _TAG_OF.get(d.tag)) is not None:
            x[i, t] = 1
    at = len(TAGS)
    for masks in ([d.words for d in nodes], above):
        x[:, at : at + WORDS] = np.unpackbits(np.frombuffer(b"".join(m.to_bytes(WORDS // 8, "little") for m in masks), np.uint8).reshape(n, -1), axis=1, bitorder="little")
        at += WORDS
    tags = np.array(tags_above, np.int64)
    for k in range(len(ABOVE)):
        x[:, at + k] = tags >> k & 1
    at += len(ABOVE)
    parent = np.array([max(0, d.parent) for d in nodes])
    siblings = np.array([len(nodes[p].children) for p in parent])
    nth = np.zeros(n)
    same = np.zeros(n)
    for d in nodes:
        kinds: dict[str, int] = {}
        for k, c in enumerate(d.children):
            nth[c] = k
            kinds[nodes[c].tag] = kinds.get(nodes[c].tag, 0) + 1
        for c in d.children:
            same[c] = kinds[nodes[c].tag]
    length = np.maximum(chars, 1)
    values = [
        np.log1p(chars), chars / total, links / length, np.log1p(words), words / np.maximum(runs, 1), stops / np.maximum(words, 1), chars / np.maximum(elements, 1),
        np.log1p(elements), np.log1p(runs), np.array([d.depth for d in nodes]), np.log1p(siblings), nth / np.maximum(siblings, 1), same / np.maximum(siblings, 1), order / total,
        (order + chars) / total, chars[parent] / total, links[parent] / np.maximum(chars[parent], 1), chars / np.maximum(chars[parent], 1), np.log1p(chars[parent] / np.maximum(siblings, 1)),
        stops[parent] / np.maximum(words[parent], 1),
    ]
    x[:, at:] = np.stack(values, 1)
    return x
