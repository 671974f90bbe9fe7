"""HTML to leaf blocks with their ancestors. One pass, no tree in memory.

A leaf block is a run of text between block-level boundaries; inline elements
and line breaks do not end it. Scripts, styles, comments, markup and form
controls have no blocks; the text of a formula or button belongs to the prose
it stands in, but a block of buttons alone is none. Broken markup is read as
browsers do in spirit: unclosed elements close where a like one begins or their
parent ends, stray end tags count for nothing, an unclosed comment or tag ends
the page.

Work and memory are in proportion to the page, however deep its elements nest:
the open elements are found by tag, and blocks share their ancestors.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from html import unescape
from typing import NamedTuple

#: Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select svg canvas object noembed noframes xmp title annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow ms msqrt mstyle msub msup mtext munder mover semantics q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "body": ("head",),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",)}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMED = frozenset(("class", "id", "role", "hidden", "style", "aria-hidden", "data-y"))


class Path:
    """An element that has blocks below, and what is above it."""

    __slots__ = ("above", "name", "known")

    def __init__(self, above: Path | None, name: str):
        self.above = above
        self.name = name  # "tag" or "tag class-and-id-words"
        self.known = None  # a place for what a reader derives from it

    def up(self) -> Iterator[Path]:
        """This element and all above, innermost first."""
        at: Path | None = self
        while at is not None:
            yield at
            at = at.above


class Block(NamedTuple):
    text: str
    path: Path | None
    linked: int  # characters inside links
    label: str | None  # nearest data-y, for training pages


class _Open(NamedTuple):
    tag: str
    path: Path | None  # of the nearest element that is not inline
    hidden: bool
    label: str | None


def _opened(tag: str, attributes: str, above: _Open | None) -> _Open:
    path, hidden, label = (above.path, above.hidden, above.label) if above else (None, False, None)
    if not attributes or attributes.isspace():
        return _Open(tag, path if tag in INLINE else Path(path, tag), hidden, label)
    found = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in NAMED}
    if tag not in INLINE:
        words = " ".join(unescape(found.get(k, "")) for k in ("class", "id", "role")).lower().strip()
        path = Path(path, f"{tag} {words}" if words else tag)
    hidden = hidden or "hidden" in found or found.get("aria-hidden", "") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return _Open(tag, path, hidden, found.get("data-y", label))


class _Stack:
    """The open elements, with the places of each tag and of those that are not inline."""

    def __init__(self):
        self.all: list[_Open] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.outline: list[int] = []

    def top(self) -> _Open | None:
        return self.all[-1] if self.all else None

    def last(self, tag: str) -> int:
        """Where the innermost open element of a tag is, or -1."""
        places = self.at.get(tag)
        return places[-1] if places else -1

    def push(self, tag: str, attributes: str) -> None:
        self.at[tag].append(len(self.all))
        if tag not in INLINE:
            self.outline.append(len(self.all))
        self.all.append(_opened(tag, attributes, self.top()))

    def pop_to(self, depth: int) -> None:
        while len(self.all) > depth:
            tag = self.all.pop().tag
            self.at[tag].pop()
            if tag not in INLINE:
                self.outline.pop()

    def make_room(self, tag: str) -> None:
        """Close what a new element of this tag ends: an open paragraph, or a like element in its scope."""
        names = CLOSES.get(tag, ())
        if not names:
            if self.outline and self.all[self.outline[-1]].tag == "p":
                self.pop_to(self.outline[-1])
            return
        while True:
            ends = max(self.last("p"), *map(self.last, names))
            bars = (self.last(t) for t in SCOPES.get(tag, ()) if t not in names)
            if ends < 0 or ends < max(bars, default=-1):
                return
            self.pop_to(ends)
            if self.all and self.all[-1].tag not in names:
                return


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page, in order; none for null or empty."""
    out: list[Block] = []
    if not html:
        return out
    stack = _Stack()
    text: list[str] = []
    linked = pressed = at = 0

    def end_block() -> None:
        nonlocal linked, pressed
        if text:
            top = stack.top()
            if not (top and top.hidden):
                whole = " ".join(unescape("".join(text)).split())
                if whole and pressed < sum(len(t) for t in text if not t.isspace()):
                    out.append(Block(whole, top.path if top else None, linked, top.label if top else None))
            text.clear()
        linked = pressed = 0

    while True:
        m = TOKEN.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            text.append(piece)
            if stack.last("a") >= 0:
                linked += len(piece)
            if stack.last("button") >= 0 and not piece.isspace():
                pressed += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[4]:  # the page ends inside a tag
            break
        if m[1]:
            if tag not in INLINE:
                end_block()
            if (depth := stack.last(tag)) >= 0:
                stack.pop_to(depth)
            continue
        if tag in RAW:
            if tag in ("textarea", "select", "iframe"):
                end_block()
            if not m[3].endswith("/"):
                close = _raw_end(tag).search(html, at)
                at = close.end() if close else len(html)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            end_block()
            stack.make_room(tag)
        if tag in VOID:
            continue
        stack.push(tag, m[3])
    end_block()
    return out


@cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I)
