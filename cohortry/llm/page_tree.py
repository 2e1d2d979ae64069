"""HTML as a flat tree: elements in page order with their parents, and the text pieces between tags.

Forgiving like a browser: elements with an optional end close where the next one needs it, an end tag
without its start is ignored, what is open at the end of the page is closed there. Formatting elements
that a block cuts off are not opened again, which changes no text. Scanning is linear in the page: ends
that nothing waits for are known from counts of open elements, not from a walk up the tree.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no markup.
RAW = frozenset("script style iframe noembed noframes xmp title textarea".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext"
    " pre search section summary table tbody td tfoot th thead tr ul".split())
# A start tag of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
# Start tag -> elements it ends, and the ones it does not look beyond.
_ROWS = frozenset(("tbody", "thead", "tfoot"))
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "tr": (frozenset(("tr", "caption")), frozenset(("table",))),
    **{name: (_ROWS | {"caption", "colgroup"}, frozenset(("table",))) for name in _ROWS},
    "a": (frozenset(("a",)), BLOCKS),
}
PARAGRAPH = frozenset(("p",))
SCOPE = frozenset("applet button caption html marquee object table td template th".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</[^a-zA-Z>][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE) for name in RAW}


@dataclass
class Page:
    """``tag``, ``attributes`` (source text) and ``parent`` by element, element 0 is the page; ``pieces``
    are (element, block, text), where pieces of one block have no block boundary between them."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    attributes: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    pieces: list[tuple[int, int, str]] = field(default_factory=list)

    def attribute(self, element: int, *names: str) -> list[str | None]:
        """Values of attributes: '' when given without one, None when missing."""
        source = self.attributes[element]
        if not source or source.isspace():
            return [None] * len(names)
        found: dict[str, str] = {}
        for match in _ATTRIBUTE.finditer(source):
            found.setdefault(match[1].lower(), unescape(match[2] or match[3] or match[4] or ""))
        return [found.get(name) for name in names]


def parse(html: str) -> Page:
    """The tree of a page. Text without any tag is one piece of the page itself."""
    page = Page()
    stack, waiting = [0], Counter(("html",))
    block, at = 0, 0

    def close_to(depth: int) -> None:
        nonlocal block
        for element in stack[depth:]:
            waiting[page.tag[element]] -= 1
            block += page.tag[element] in BLOCKS
        del stack[depth:]

    def close_last(names: frozenset[str], beyond: frozenset[str]) -> None:
        """Closes the innermost open element of some names, unless one of ``beyond`` lies further in."""
        if not any(waiting[name] for name in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            name = page.tag[stack[depth]]
            if name in names:
                close_to(depth)
                return
            if name in beyond:
                return

    def text(source: str) -> None:
        if source:
            page.pieces.append((stack[-1], block, unescape(source) if "&" in source else source))

    while match := _TOKEN.search(html, at):
        text(html[at : match.start()])
        at = match.end()
        name = match[2] and match[2].lower()
        if not name or name in ("html", "body") and (match[1] or waiting[name]):
            continue
        if match[1]:
            if waiting[name]:
                close_last(HEADINGS if name in HEADINGS else frozenset((name,)),
                           SCOPE - {name} if name in BLOCKS else BLOCKS)
            elif name == "p" or name == "br":
                block += name == "p"
                text(" ")
            continue
        if waiting["head"] and name not in HEAD_ONLY and name != "head":
            close_last(frozenset(("head",)), frozenset())
        if name in ENDS_PARAGRAPH and waiting["p"]:
            close_last(PARAGRAPH, SCOPE)
        if name in ENDS:
            close_last(*ENDS[name])
        elif name in HEADINGS and page.tag[stack[-1]] in HEADINGS:
            close_to(len(stack) - 1)
        block += name in BLOCKS
        element = len(page.tag)
        page.tag.append(name)
        page.attributes.append(match[3])
        page.parent.append(stack[-1])
        if name in VOID:
            if name == "br":
                text(" ")
            continue
        stack.append(element)
        waiting[name] += 1
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            text(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
            close_to(len(stack) - 1)
    text(html[at:])
    return page
