"""A small tolerant HTML reader: elements with their subtree statistics, and text in page order.

Unclosed elements end where HTML says they do (a new paragraph, list item, cell or option ends the open
one; an end tag closes what is open inside it; an end tag without its element is ignored), and what a
page leaves open ends with the page. Inline elements without class, id or role are transparent.

The time is in proportion to the page, whatever it holds: every search goes on from where the last one ended, what the
rest of a page lacks is looked for once, and open elements are found by their tag, not by a walk up.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: A tag as most are written; others are read by ``Source.attributes``.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[a-zA-Z_:@][-\w:.]*+(?:=(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=`]++))?)*+)\s*+(/?)>")
_NAME, _BLANKS, _KEY, _EQUALS, _BARE = (re.compile(x) for x in (r"</?([a-zA-Z][^\s/>]*+)", r"[\s/]*+", r"=?[^\s/>=]*+", r"\s*+=\s*+", r"[^\s>]*+"))
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page; of the raw ones, one without an end goes on to the end of the page.
RAW = frozenset("script style textarea title noscript iframe".split())
OPAQUE = RAW | frozenset("template select button svg math object canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_STOPS = frozenset("ul ol dl table body article section div main aside nav form blockquote".split())


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    place: int  # among its parent's children
    inline: bool = False
    tokens: frozenset = frozenset()
    hidden: bool = False
    children: list = field(default_factory=list)
    own_chars: int = 0
    chars: int = 0
    link_chars: int = 0
    elements: int = 0
    blocks: int = 0
    stops: int = 0
    rights: bool = False


@dataclass
class Page:
    nodes: list
    #: (node, text, starts a block) in page order
    pieces: list


class Source:
    """A page's source and what its rest is known to lack."""

    def __init__(self, text: str):
        self.text, self._lacks = text, set()

    def find(self, what: str, at: int) -> int:
        """Place of a sign from ``at`` on, or -1; a sign that is lacking is looked for once. Calls go forward."""
        if what in self._lacks:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self._lacks.add(what)
        return found

    def end_tag(self, tag: str, at: int) -> tuple[int, int] | None:
        """(begin, end) of the next end tag of ``tag``."""
        if f"</{tag}" in self._lacks:
            return None
        m = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(self.text, at)
        end = self.find(">", m.end()) if m else -1
        if end < 0:
            self._lacks.add(f"</{tag}")
            return None
        return m.start(), end + 1

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool] | None:
        """(attributes, end of the tag, whether it closes itself) from behind a tag's name on; None if the page ends before."""
        found: dict[str, str] = {}
        text, n = self.text, len(self.text)
        while True:
            begin, at = at, _BLANKS.match(text, at).end()
            if at >= n:
                return None
            if text[at] == ">":
                return found, at + 1, at > begin and text[at - 1] == "/"
            m = _KEY.match(text, at)
            at, value = m.end(), ""
            if (eq := _EQUALS.match(text, at)) is not None:
                at = eq.end()
                close = self.find(text[at], at + 1) if at < n and text[at] in "\"'" else -1
                if close >= 0:
                    value, at = text[at + 1 : close], close + 1
                else:
                    bare = _BARE.match(text, at)
                    value, at = bare[0], bare.end()
            found.setdefault(m[0].lower(), value)


def read(source: str) -> Page:
    """Nodes (the first is the page itself) and pieces of text."""
    nodes, pieces = [Node("#page", -1, 0, 0)], []
    stack, links, fresh, at, n = [0], 0, True, 0, len(source)
    rest = Source(source)
    #: Places in the stack of open elements by tag, of those that bound a search, and of blocks.
    open_at: dict[str, list[int]] = {}
    stops, blocks = [0], [0]

    def text(raw: str) -> None:
        nonlocal fresh
        raw = html.unescape(raw)
        if not raw:
            return
        body = raw.strip()
        own = nodes[stack[-1]]
        if body:
            own.own_chars += len(body)
            own.stops += body.count(".") + body.count(",") + body.count("!") + body.count("?")
            own.rights = own.rights or "©" in body
            if links:
                own.link_chars += len(body)
            if fresh:
                own.blocks += 1
        pieces.append((stack[-1], raw, fresh))
        fresh = False

    def close_to(depth: int) -> None:
        nonlocal fresh
        while len(stack) > depth:
            gone = nodes[stack.pop()]
            open_at[gone.tag].pop()
            if stops[-1] == len(stack):
                stops.pop()
            if not gone.inline:
                blocks.pop()
                fresh = True

    def close_open(tags: tuple[str, ...]) -> None:
        """Close the innermost open element of these tags, if nothing that bounds the search is open within."""
        nearest = max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)
        if nearest > stops[-1]:
            close_to(nearest)

    while at < n:
        begin = at
        while True:  # to the next sign that opens a tag or a comment
            at = rest.find("<", at)
            if at < 0 or source[at + 1 : at + 2].isalpha() or source[at + 1 : at + 2] in ("!", "?") or source[at + 1 : at + 2] == "/" and at + 2 < n:
                break
            at += 1
        if at != begin:
            text(source[begin : at if at >= 0 else n])
        if at < 0:
            break
        if source.startswith("<!--", at):
            end = rest.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        m, selfish = _TAG.match(source, at), False
        if m is not None:
            tag, closing, selfish, end = m[2].lower(), bool(m[1]), bool(m[4]), m.end()
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] and not closing else {}
        elif (m := _NAME.match(source, at)) is not None:
            tag, closing = m[1].lower(), source[at + 1] == "/"
            if (got := rest.attributes(m.end())) is None:  # the page ends within the tag
                break
            found, end, selfish = got
        else:  # a declaration, or an end tag without a name
            end = rest.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        at = end
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            places = open_at.get(tag)
            if places and (tag not in INLINE or places[-1] > blocks[-1]):
                close_to(places[-1])
            if tag not in INLINE:
                fresh = True
            continue
        if tag in OPAQUE:
            if not (selfish and tag in ("svg", "math")):
                end_tag = rest.end_tag(tag, at)
                at = end_tag[1] if end_tag else n if tag in RAW else at
            continue  # all of these stand within a line of text
        inline = tag in INLINE
        if tag == "a":
            links += 1
        if tag in VOID:
            if tag in ("hr",):
                fresh = True
            elif tag in ("br", "wbr"):
                pieces.append((stack[-1], " " if tag == "br" else "", False))
            nodes[stack[-1]].elements += 1
            continue
        if inline and not (found.keys() & {"class", "id", "role"}):
            nodes[stack[-1]].elements += 1
            continue
        if tag in _ENDS_P:
            close_open(("p",))
        if tag in _ENDS_SAME:
            close_open(_ENDS_SAME[tag])
        up = nodes[stack[-1]]
        words = frozenset(_WORDS.findall(" ".join((found.get("class", ""), found.get("id", ""), found.get("role", ""), found.get("aria-label", ""))).lower()))
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        up.children.append(len(nodes))
        nodes.append(Node(tag, stack[-1], up.depth + 1, len(up.children) - 1, inline, words, hidden))
        open_at.setdefault(tag, []).append(len(stack))
        if tag in _STOPS:
            stops.append(len(stack))
        if not inline:
            blocks.append(len(stack))
        stack.append(len(nodes) - 1)
        if not inline:
            fresh = True
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        x.chars += x.own_chars
        if i:
            up = nodes[x.parent]
            up.chars += x.chars
            up.link_chars += x.link_chars
            up.elements += x.elements + 1
            up.blocks += x.blocks
            up.stops += x.stops
            up.rights = up.rights or x.rights
    return Page(nodes, pieces)


def kept_text(page: Page, keep: list[bool]) -> str:
    """Blocks of the kept nodes: white space to one space, trimmed, empty ones left out, joined by a line feed."""
    blocks: list[list[str]] = [[]]
    for node, raw, starts in page.pieces:
        if starts and blocks[-1]:
            blocks.append([])
        if keep[node]:
            blocks[-1].append(raw)
    clean = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n".join(b for b in clean if b)
