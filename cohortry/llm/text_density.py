"""Main text of web pages by composite text density (operator 11).

Elements that are never part of an article (menus, page headers and footers, sidebars, notices,
adverts, forms, scripts, reader comments) leave the tree first, by tag, role or the words of their class and
id. For every element left, the composite text density is its characters per tag, scaled by a logarithm
whose base grows with the share of link text, so text outside links counts and link lists count as
nothing. The element with the largest sum of its children's densities is the core of the article. The
least density on the path from the core to the body is the threshold: elements that reach it
contribute the subtree with the largest sum inside them, and the article is the smallest part of the page that
holds all of these; where ``article`` or ``main`` elements exist, only they are searched, and are taken whole. Lists of
links inside are menus and go too.

A NULL page, an empty one and one without an article give an empty text. Text outside any tag is body
text. Very long pages are read whole, in linear time. White space (also no-break spaces) inside a block
becomes one space, ``br`` is white space, blocks are joined by an empty line. Pages are treated one by
one, so ties and repeated rows do not matter; an empty table gives an empty result. All columns of the
table are kept, whatever their names; the result replaces a column named ``text``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import prepare, whole
from cohortry.llm.page_tree import HEADINGS, Page, parse

# What is never article text, by tag, by role and by a word of its class or id.
LEFT_OUT_TAGS = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form frame frameset head iframe input"
    " map menu nav noembed noframes noscript object optgroup option script search select style svg"
    " template textarea title video xmp".split())
LEFT_OUT_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status"
    " toolbar tooltip".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs byline carousel consent cookie"
    " cookies copyright disclaimer disqus footer gdpr hidden login masthead menu modal nav navbar navigation"
    " newsletter notice notices notification notifications outbrain overlay pager pagination paywall popup"
    " promo promoted promotion promotions recommendations recommended related share sharing sidebar"
    " signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets".split())
COMMENT_WORDS = frozenset("comment comments commentlist discussion replies reply respond responses".split())
HEADER_WORDS = frozenset(("header", "heading"))
LINK_LISTS = frozenset(("ul", "ol", "dl", "menu", "table"))
# A list is a menu if this share of its characters is link text, in at least so many links.
MENU_SHARE, MENU_LINKS = 0.8, 3

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _subtree_sums(parent: list[int], own: list[int]) -> list[int]:
    """Sums over whole subtrees; children stand behind their parents."""
    total = list(own)
    for element in range(len(own) - 1, 0, -1):
        total[parent[element]] += total[element]
    return total


def left_out(page: Page) -> list[bool]:
    """For each element whether it, or something around it, is no article text."""
    held = _subtree_sums(page.parent, [int(t in ("article", "main")) for t in page.tag])
    titles = _subtree_sums(page.parent, [int(t == "h1") for t in page.tag])
    paragraphs = _subtree_sums(page.parent, [int(t == "p") for t in page.tag])
    out, in_article, in_header = [False], [False], [False]
    for element in range(1, len(page.tag)):
        tag, above = page.tag[element], page.parent[element]
        article = in_article[above] or tag in ("article", "main")
        gone, header = out[above], in_header[above]
        if not gone and not header:
            names, roles, style, hidden, aria = page.attribute(element, "class", "role", "style", "hidden", "aria-hidden")
            words = set(map(str.lower, _WORDS.findall(names or "")))
            words.update(map(str.lower, _WORDS.findall(page.attribute(element, "id")[0] or "")))
            # What holds the article, or looks like one, is judged by what is in it.
            wraps = bool(held[element]) or tag in ("html", "body") or titles[element] > 0 and paragraphs[element] > 1
            titled = tag in ("html", "body", "main") or titles[element] > 0
            gone = (
                tag in LEFT_OUT_TAGS
                or hidden is not None or aria == "true" or bool(style and _HIDDEN.search(style))
                or (roles or "").lower() in LEFT_OUT_ROLES
                or not wraps and bool(words & LEFT_OUT_WORDS)
                or not titled and bool(words & COMMENT_WORDS))
            header = not gone and (tag == "header" or not wraps and tag not in HEADINGS and bool(words & HEADER_WORDS))
            gone = gone or header and not article
        elif header and not gone:
            # Of the header inside an article only the headings are its text.
            gone = tag in LEFT_OUT_TAGS
        out.append(gone)
        in_article.append(article)
        in_header.append(header and tag not in HEADINGS)
    for element, header in enumerate(in_header):
        out[element] = out[element] or header and page.tag[element] not in HEADINGS
    return out


def _density(chars: int, tags: int, link_chars: int, links: int, body_share: float) -> float:
    """Composite text density; missing tags, links and plain text count as one."""
    if not chars:
        return 0.0
    inside = chars / max(chars - link_chars, 1) * link_chars + body_share * chars + math.e
    # A page without links would have base 1; e is the least.
    base = math.log(max(math.log(inside), math.e))
    return chars / max(tags, 1) * math.log(chars / max(link_chars, 1) * max(tags, 1) / max(links, 1)) / base


def article_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = parse(html)
    n, parent, tag = len(page.tag), page.parent, page.tag
    out = left_out(page)
    inside_link, article = [False] * n, [-1] * n
    for element in range(1, n):
        inside_link[element] = tag[element] == "a" or inside_link[parent[element]]
        outer = article[parent[element]]
        # The outermost article, or main where it holds no article.
        article[element] = outer if outer >= 0 else element if tag[element] == "article" and not out[element] else -1
    own = [0] * n
    for element, _, text in page.pieces:
        if not out[element]:
            own[element] += len("".join(text.split()))
    own_links = [c if linked else 0 for c, linked in zip(own, inside_link, strict=True)]
    chars, link_chars = _subtree_sums(parent, own), _subtree_sums(parent, own_links)
    kept = [not gone for gone in out]
    tags = _subtree_sums(parent, [int(k) for k in kept])
    links = _subtree_sums(parent, [int(k and t == "a") for k, t in zip(kept, tag, strict=True)])
    if not chars[0]:
        return ""
    if not any(a >= 0 and chars[a] for a in article):
        for element in range(1, n):
            outer = article[parent[element]]
            article[element] = outer if outer >= 0 else element if tag[element] == "main" and kept[element] else -1
    marked_up = any(a >= 0 and chars[a] for a in article)
    menu = [False] * n
    for element in range(1, n):
        menu[element] = menu[parent[element]] or (
            kept[element] and tag[element] in LINK_LISTS and links[element] >= MENU_LINKS
            and link_chars[element] >= MENU_SHARE * chars[element])
        out[element] = out[element] or menu[element]

    share = link_chars[0] / max(chars[0], 1)
    density = [0.0] * n
    sums = [0.0] * n
    for element in range(n - 1, -1, -1):
        if out[element]:
            continue
        own_tag = int(kept[element])
        density[element] = _density(
            chars[element], tags[element] - own_tag, link_chars[element], links[element] - (tag[element] == "a"), share)
        # Its own text counts like a child without tags.
        sums[element] += _density(own[element], 1, own_links[element], 0, share)
        if element:
            sums[parent[element]] += density[element]
    searched = [not out[e] and (not marked_up or article[e] >= 0) and chars[e] > 0 for e in range(n)]
    if not any(searched):
        return ""
    core = max((e for e in range(n) if searched[e]), key=lambda e: (sums[e], -e))
    threshold, above = density[core], core
    while above > 0 and tag[above] != "body":
        above = parent[above]
        threshold = min(threshold, density[above])
    # From the bottom up: the element with the largest sum in each subtree.
    best = list(range(n))
    for element in range(n - 1, 0, -1):
        over = parent[element]
        if searched[element] and (not searched[over] or (sums[best[element]], -best[element]) > (sums[best[over]], -best[over])):
            best[over] = best[element]
    chosen = {best[e] for e in range(n) if searched[e] and density[e] >= threshold} | {core}
    if marked_up:
        roots = {article[e] for e in chosen}
    else:
        roots = {_common_root(parent, chosen)}
    inside = [False] * n
    for element in range(n):
        inside[element] = element in roots or element > 0 and inside[parent[element]]
    blocks: dict[int, list[str]] = {}
    for element, block, text in page.pieces:
        if inside[element] and not out[element]:
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(text for text in joined if text)


def _common_root(parent: list[int], elements: set[int]) -> int:
    """The innermost element that holds all of some elements."""
    shared = set(elements)
    while len(shared) > 1:
        # Parents stand before their children, so the last one cannot hold the others.
        last = max(shared)
        shared.remove(last)
        shared.add(parent[last])
    return shared.pop()


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows with a column ``text``: the article of each page, empty if there is none."""
    prepare(pages.sparkSession)

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(map(article_text, batch.to_pylist()), pa.string())

    return pages.withColumn("text", extract(whole(html)))
