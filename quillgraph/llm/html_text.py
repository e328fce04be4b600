"""Main text of HTML pages from flat text blocks.

A page is cut into flat blocks at block-level tags, in one pass over its characters. A block's features are its word
count and link density, those of the blocks before and behind it, which elements enclose it, and a weak hint that class
words give. A decision tree, grown here on the small labelled table below, decides which blocks are main text.

Nulls: null html is empty, and an empty page has an empty text. Repeated rows are extracted apart. Pages of any length
and any markup are read whole, in time that grows with their length alone. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names.
RAW = ("script", "style", "title", "noscript", "template", "iframe", "object", "svg", "math", "textarea")
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("nav footer aside form menu dialog button select fieldset head".split())
ARTICLE = frozenset("article main".split())
CONTAINERS = FURNITURE | ARTICLE | frozenset("header div section ul ol dl table figure details blockquote span td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre dd figcaption".split())
#: Words of class, id and role attributes that hint at page furniture, and those that hint at the article.
FURNITURE_WORDS = frozenset("ad adbox ads adsense adslot advert advertisement advertising advertisment alert backlink banner breadcrumb breadcrumbs comment commentlist comments consent contentinfo cookie cookies copyright cta disclaimer discussion disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo promoted rail related replies reply respond responses search searchbox share sharing side sidebar signin signup sitemap social sponsor sponsored subnav subscribe tagcloud toolbar topbar topnav widget".split())
ARTICLE_WORDS = frozenset("article post content entry story main".split())

_SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^<>\"'=]*+)>")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_GAP = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+)?+")
_BARE = re.compile(r"[^\s>]*+")
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    """``section``: 1 in an article, -1 in page furniture (elements, not classes). ``hint``: what the nearest class words say, alike. ``doubt``: whether any class words around it hint at furniture. ``kind``: 2 a heading, 1 prose, 0 else."""

    text: str
    words: int
    link_density: float
    section: int
    hint: int
    doubt: int
    kind: int


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, dict[str, str]]]:
    """(start, end, name, closing, attributes) of every tag and, with an empty name, of comments and raw elements.

    One pass: a quoted value always ends before a place that is not looked at again, a raw element ends at its closing
    tag or with the page, and so does a tag without an end.
    """
    at, size = 0, len(page)
    last = {'"': page.rfind('"'), "'": page.rfind("'")}
    while (at := page.find("<", at)) >= 0:
        start = at
        if page.startswith(("<!", "<?", "</"), at) and not _OPEN.match(page, at):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            yield start, at, "", False, {}
            continue
        attributes: dict[str, str] = {}
        if m := _SIMPLE.match(page, at):
            at = m.end()
            for word in m[3].split():
                attributes.setdefault(word.lower().strip("/"), "")
        elif m := _OPEN.match(page, at):
            at = m.end()
            while True:
                at = _GAP.match(page, at).end()
                if at >= size or page[at] == ">":
                    at += 1
                    break
                a = _ATTRIBUTE.match(page, at)
                at = a.end()
                value = ""
                if a[0] != a[1]:
                    quote = page[at : at + 1]
                    if quote in last and quote and at < last[quote]:
                        end = page.index(quote, at + 1)
                        value, at = page[at + 1 : end], end + 1
                    else:
                        b = _BARE.match(page, at)
                        value, at = b[0], b.end()
                attributes.setdefault(a[1].lower(), value)
        else:
            at += 1  # a plain "<"
            continue
        name = m[2].lower()
        if name in _CLOSING and not m[1]:
            end = _CLOSING[name].search(page, at)
            at = end.end() if end else size
            yield start, at, "", False, {}
        else:
            yield start, min(at, size), name, bool(m[1]), attributes


def hint_of(attributes: dict[str, str]) -> int:
    """-1 where class words hint at page furniture, 1 where they hint at an article, 0 for neither or both."""
    words: set[str] = set()
    for key in ("class", "id", "role", "aria-label"):
        if value := attributes.get(key):
            words.update(w for x in (value, _CAMEL.sub(" ", value)) for w in re.split(r"[^a-z]+", x.lower()))
    return bool(words & ARTICLE_WORDS) - bool(words & FURNITURE_WORDS)


def hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


class Context:
    """The containers that enclose a place, and what they say about it."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []  # name, section, hint
        self.open: dict[str, int] = {}
        self.furniture = self.article = self.doubts = 0
        self.hints: list[int] = []

    def enter(self, name: str, attributes: dict[str, str]) -> None:
        section = -1 if name in FURNITURE or hidden(attributes) or name == "header" and not self.article else 1 if name in ARTICLE else 0
        hint = hint_of(attributes) if attributes else 0
        self.stack.append((name, section, hint))
        self.open[name] = self.open.get(name, 0) + 1
        self.furniture += section < 0
        self.article += section > 0
        self.doubts += hint < 0
        if hint:
            self.hints.append(hint)

    def leave(self, name: str) -> None:
        """Closes the innermost container of a name and what is open inside; without one, nothing happens."""
        while self.open.get(name):
            own, section, hint = self.stack.pop()
            self.open[own] -= 1
            self.furniture -= section < 0
            self.article -= section > 0
            self.doubts -= hint < 0
            if hint:
                self.hints.pop()
            if own == name:
                break

    def block(self, text: str, linked: int, kind: int) -> Block:
        words = text.count(" ") + 1
        section = -1 if self.furniture else 1 if self.article else 0
        return Block(text, words, min(1.0, linked / words), section, self.hints[-1] if self.hints else 0, int(self.doubts > 0), kind)


def blocks_of(page: str) -> list[Block]:
    """The page's flat text blocks in order. A single line break is white space, two in a row end a block."""
    out: list[Block] = []
    context = Context()
    pieces: list[str] = []
    linked = at = breaks = kind = 0
    in_link = False

    def close() -> None:
        nonlocal linked, breaks
        breaks = 0
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                out.append(context.block(text, linked, kind))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, breaks
        if text:
            pieces.append(text)
            if not text.isspace():
                breaks = 0
                if in_link:
                    linked += len(text.split())

    for start, end, name, closing, attributes in tags_of(page):
        add(page[at:start])
        at = end
        if not name:
            continue
        if name == "br":
            breaks += 1
            pieces.append(" ")
            if breaks == 2:
                close()
        elif name == "a":
            in_link = not closing
        if name in BLOCKS:
            close()
            in_link = False  # an anchor left open ends with its block
            kind = 0 if closing else 2 if name in HEADINGS else 1 if name in PROSE else 0
        if name in CONTAINERS:
            if closing:
                context.leave(name)
            else:
                context.enter(name, attributes)
        if name == "body" and not closing:  # ends a head that was left open
            context = Context()
    add(page[at:])
    close()
    return out


FEATURES = ("words", "link_density", "previous_words", "previous_link_density", "next_words", "next_link_density", "section", "kind", "hint", "doubt")


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block; beyond the page's ends there are blocks without words."""
    none = Block("", 0, 0.0, 0, 0, 0, 0)
    around = [none, *blocks, none]
    return [(b.words, b.link_density, p.words, p.link_density, n.words, n.link_density, b.section, b.kind, b.hint, b.doubt) for p, b, n in zip(around, blocks, around[2:], strict=False)]


#: The labelled table: pages as blocks in order, each (enclosing elements, words, linked words, whether it is main text).
#: Elements are written as ``name.class`` from the outermost to the one that makes the block.
LABELLED = (
    # an article element between furniture elements
    (("nav ul li", 1, 1, 0), ("nav ul li", 2, 2, 0), ("nav ul li", 1, 1, 0), ("div.ad", 9, 0, 0), ("article h1", 9, 0, 1), ("article p", 14, 0, 1), ("article p", 60, 2, 1), ("article p", 5, 0, 1), ("article p", 3, 3, 1), ("article p", 130, 3, 1), ("article p", 2, 0, 1), ("footer", 14, 0, 0)),
    (("nav ul li", 1, 1, 0), ("nav ul li", 1, 1, 0), ("div.ad", 18, 0, 0), ("article h1", 5, 0, 1), ("article p", 6, 0, 1), ("footer", 12, 0, 0)),
    (("nav ul li", 1, 1, 0), ("div.ad", 5, 0, 0), ("article h1", 1, 0, 1), ("article p", 1, 0, 1), ("article p", 250, 0, 1), ("footer", 22, 0, 0)),
    (("nav li", 2, 2, 0), ("div.advert", 30, 0, 0), ("article h2", 12, 0, 1), ("article p", 45, 0, 1), ("article div.ad", 12, 0, 0), ("article p", 52, 1, 1), ("article aside p", 25, 0, 0), ("article p", 41, 0, 1), ("article nav li", 4, 4, 0), ("footer p", 26, 3, 0)),
    (("header div", 3, 0, 0), ("header nav li", 1, 1, 0), ("main article header h1", 8, 0, 1), ("main article header div", 4, 1, 0), ("main article p", 38, 0, 1), ("main article ul li", 5, 0, 1), ("main article ul li", 6, 5, 1), ("main article ul li", 4, 0, 1), ("main article p", 22, 0, 1), ("main article figure figcaption", 7, 0, 1), ("main article footer p", 6, 5, 0), ("main section.related li", 7, 7, 0), ("footer p", 9, 0, 0)),
    (("header h1", 3, 3, 0), ("main p", 40, 0, 1), ("main blockquote", 18, 0, 1), ("main p", 6, 6, 1), ("main p", 26, 1, 1), ("main p", 2, 2, 1), ("main table td", 2, 0, 1), ("main table td", 3, 0, 1), ("main div.notice p", 24, 0, 0), ("main p", 33, 0, 1), ("aside h3", 2, 0, 0), ("aside p", 44, 0, 0), ("aside ul li", 5, 5, 0), ("footer div", 15, 2, 0)),
    (("nav li", 1, 1, 0), ("article.story.alert h1", 7, 0, 1), ("article.story.alert p", 80, 0, 1), ("article.story.alert p", 35, 1, 1), ("footer", 8, 0, 0)),
    (("nav li", 1, 1, 0), ("article.sponsored-story.promo h1", 6, 0, 1), ("article.sponsored-story.promo p", 55, 0, 1), ("article.sponsored-story.promo p", 48, 0, 1), ("section#comments h2", 3, 0, 0), ("section#comments article.comment p", 40, 0, 0), ("section#comments article.comment p", 9, 0, 0), ("section#comments article.comment div", 3, 1, 0), ("section#comments form label", 4, 0, 0), ("footer", 10, 0, 0)),
    (("main p", 4, 0, 1), ("main p", 3, 0, 1), ("main p", 5, 0, 1), ("footer", 9, 1, 0)),
    (("nav li", 1, 1, 0), ("div.ad", 9, 0, 0), ("article p", 95, 0, 1), ("article p", 31, 0, 1), ("div.ad", 14, 0, 0), ("div.ads", 40, 0, 0), ("footer", 10, 0, 0)),
    (("nav li", 2, 2, 0), ("div.ad", 5, 0, 0), ("article h1", 17, 0, 1), ("article div", 33, 1, 1), ("nav li", 1, 1, 0), ("div.ad", 8, 0, 0), ("article h2", 26, 0, 1), ("article p", 12, 0, 1), ("nav li", 4, 4, 0), ("div.ad", 4, 0, 0), ("article p", 44, 0, 1), ("nav li", 1, 1, 0), ("div.ad", 7, 0, 0), ("article p", 20, 0, 1), ("footer", 25, 0, 0)),
    (("div.promo", 4, 0, 0), ("article h1", 70, 0, 1), ("article p", 140, 0, 1), ("article p", 3, 0, 1), ("div.sponsored", 20, 0, 0), ("main p", 60, 0, 1), ("div.banner", 6, 0, 0), ("main p", 80, 0, 1), ("section.newsletter p", 16, 0, 0)),
    # pages that end with their article, or with hardly anything behind it
    (("nav li", 1, 1, 0), ("nav li", 2, 2, 0), ("article h1", 6, 0, 1), ("article p", 25, 0, 1), ("article p", 70, 0, 1), ("article p", 8, 0, 1)),
    (("nav li", 3, 3, 0), ("article h1", 11, 0, 1), ("article p", 2, 0, 1)),
    (("nav li", 1, 1, 0), ("article h1", 7, 0, 1), ("article p", 17, 0, 1), ("article p", 24, 0, 1), ("footer a", 1, 1, 0)),
    (("header div", 1, 0, 0), ("main h1", 3, 0, 1), ("main p", 10, 0, 1), ("main p", 21, 0, 1), ("main p", 4, 0, 1), ("footer", 1, 0, 0)),
    (("nav li", 2, 2, 0), ("aside p", 12, 0, 0), ("article h1", 2, 0, 1), ("article p", 12, 0, 1), ("article h2", 3, 0, 1), ("article p", 9, 0, 1), ("article div", 6, 0, 1), ("article div", 14, 2, 1), ("nav li", 1, 1, 0), ("footer", 5, 0, 0)),
    (("nav li", 2, 2, 0), ("aside p", 31, 0, 0), ("main h1", 5, 0, 1), ("main div", 20, 0, 1), ("main div", 3, 0, 1), ("main div", 11, 0, 1), ("aside div", 9, 0, 0), ("aside div", 26, 1, 0)),
    (("footer p", 30, 0, 0), ("footer p", 14, 0, 0), ("footer p", 3, 0, 0)),
    (("article h1", 4, 0, 1), ("article p", 1, 0, 1), ("article p", 6, 0, 1), ("article p", 3, 0, 1), ("aside p", 5, 0, 0), ("aside p", 18, 0, 0), ("nav p", 6, 2, 0), ("nav p", 4, 0, 0)),
    (("article li", 4, 4, 1), ("article li", 3, 3, 1), ("article p", 30, 26, 1), ("article li", 7, 7, 1), ("article p", 5, 5, 1), ("article p", 15, 6, 1), ("article p", 9, 7, 1), ("article p", 1, 1, 1), ("article p", 4, 0, 1), ("nav li", 3, 3, 0), ("nav li", 2, 2, 0)),
    # hardly anything besides the article
    (("article p", 1, 0, 1),), (("article p", 30, 0, 1),), (("article div", 5, 0, 1),), (("main p", 8, 0, 1),), (("article h1", 3, 0, 1), ("article p", 20, 0, 1)), (("article", 2, 0, 1),),
    (("article p", 4, 0, 1), ("article p", 1, 0, 1)), (("main div", 7, 0, 1), ("main div", 2, 0, 1)), (("nav li", 2, 2, 0), ("article p", 2, 0, 1)), (("footer", 2, 0, 0),), (("nav", 5, 0, 0), ("nav", 3, 1, 0)),
    (("p", 25, 0, 1), ("p", 7, 0, 1), ("p", 34, 0, 1)), (("div p", 40, 0, 1), ("div p", 52, 1, 1), ("div p", 23, 0, 1)), (("p", 31, 0, 1), ("p", 28, 0, 1), ("p", 5, 0, 1), ("p", 66, 0, 1), ("p", 44, 0, 1)), (("div", 33, 0, 1), ("div", 41, 0, 1)), (("p", 19, 0, 1),),
    # divisions without names: the blocks around decide
    (("div ul li", 2, 2, 0), ("div ul li", 1, 1, 0), ("div ul li", 2, 2, 0), ("div", 3, 0, 0), ("div h1", 8, 0, 1), ("div p", 42, 0, 1), ("div p", 6, 0, 1), ("div p", 55, 4, 1), ("div h2", 4, 0, 1), ("div p", 29, 0, 1), ("div p", 70, 9, 1), ("div", 4, 4, 0), ("div ul li", 7, 7, 0), ("div ul li", 6, 6, 0), ("div", 9, 0, 0)),
    (("div", 2, 2, 0), ("div", 2, 2, 0), ("div h1", 5, 0, 1), ("div p", 24, 0, 1), ("div p", 18, 0, 1), ("div p", 3, 0, 1), ("div p", 31, 2, 1), ("div", 3, 3, 0), ("div", 4, 4, 0), ("div", 7, 1, 0)),
    (("div a", 1, 1, 0), ("div a", 1, 1, 0), ("div h2", 9, 0, 1), ("div", 36, 0, 1), ("div", 48, 3, 1), ("div", 5, 0, 1), ("div", 61, 0, 1), ("div", 20, 18, 0), ("div", 12, 11, 0), ("div", 5, 0, 0), ("div", 4, 4, 0)),
    (("td", 2, 2, 0), ("td", 3, 3, 0), ("td", 3, 0, 0), ("td", 2, 2, 0), ("td", 95, 4, 1), ("td", 120, 2, 1), ("td", 2, 2, 0), ("td", 4, 4, 0), ("td", 11, 1, 0)),
    (("div li", 3, 3, 0), ("div li", 2, 2, 0), ("div p", 26, 0, 1), ("div p", 12, 0, 1), ("div p", 9, 0, 1), ("div p", 15, 0, 1), ("div p", 40, 25, 0), ("div li", 8, 8, 0), ("div li", 6, 6, 0), ("div p", 18, 2, 0)),
    (("div li", 1, 1, 0), ("div li", 1, 1, 0), ("div li", 3, 3, 0), ("div", 4, 0, 0), ("div li", 5, 5, 0), ("div li", 4, 4, 0), ("div", 6, 1, 0), ("div li", 3, 3, 0), ("div", 8, 0, 0)),
    (("div li", 2, 2, 0), ("div h1", 6, 0, 1), ("div p", 80, 2, 1), ("div p", 7, 0, 1), ("div p", 90, 12, 1), ("div p", 33, 11, 1), ("div p", 64, 0, 1), ("div h3", 3, 0, 0), ("div li", 7, 7, 0), ("div li", 9, 9, 0), ("div h3", 2, 0, 0), ("div li", 5, 5, 0), ("div p", 12, 1, 0)),
    (("div", 5, 5, 0), ("div", 6, 2, 0), ("p", 50, 0, 1), ("p", 44, 0, 1), ("p", 10, 0, 1), ("p", 37, 5, 1), ("div", 6, 5, 0), ("div", 5, 0, 0)),
    (("p", 60, 0, 1), ("p", 6, 0, 1), ("p", 58, 1, 1), ("p", 8, 0, 1), ("p", 75, 0, 1)),
    (("p", 12, 0, 1), ("p", 30, 0, 1)),
    (("div p", 16, 0, 1), ("div p", 6, 0, 1), ("div p", 6, 0, 1), ("div p", 28, 0, 1), ("div li", 2, 2, 0)),
    (("div", 1, 1, 0), ("div", 4, 0, 0), ("div", 3, 3, 0), ("div", 27, 0, 1), ("div", 6, 0, 1), ("div", 21, 0, 1), ("div", 2, 2, 0), ("div", 5, 0, 0), ("div", 2, 2, 0)),
    (("div", 2, 2, 0), ("div", 6, 0, 0), ("div", 1, 1, 0), ("div", 19, 0, 1), ("div", 8, 0, 1), ("div", 25, 1, 1), ("div", 4, 0, 1), ("div", 22, 0, 1), ("div", 3, 3, 0), ("div", 3, 0, 0), ("div", 1, 1, 0)),
    # class words as hints
    (("div.header", 4, 0, 0), ("div.menu li", 1, 1, 0), ("div.menu li", 2, 2, 0), ("div.post h1", 7, 0, 1), ("div.post p", 48, 1, 1), ("div.post p", 5, 0, 1), ("div.post li", 12, 0, 1), ("div.post li", 4, 2, 1), ("div.post p", 39, 0, 1), ("div.comments h3", 2, 0, 0), ("div.comments p", 35, 0, 0), ("div.comments p", 12, 0, 0), ("div.comments div.comment-content p", 28, 0, 0), ("div.comment-form label", 2, 0, 0), ("div.footer p", 18, 2, 0)),
    (("div.cookie-consent p", 45, 1, 0), ("div.cookie-consent p", 6, 1, 0), ("div.navbar li", 1, 1, 0), ("div#content h1", 6, 0, 1), ("div#content p", 66, 2, 1), ("div#content p", 4, 0, 1), ("div#content p", 51, 0, 1), ("div.sidebar h4", 2, 0, 0), ("div.sidebar p", 38, 0, 0), ("div.sidebar li", 4, 4, 0), ("div#footer", 16, 0, 0)),
    (("div.sidebar-layout div.post h1", 5, 0, 1), ("div.sidebar-layout div.post p", 57, 0, 1), ("div.sidebar-layout div.post p", 44, 1, 1), ("div.sidebar-layout div.post p", 8, 0, 1), ("div.sidebar-layout div.widget p", 21, 0, 0), ("div.sidebar-layout div.widget li", 3, 3, 0)),
    (("div.banner p", 22, 0, 0), ("div.banner p", 30, 0, 0), ("div.entry h2", 4, 0, 1), ("div.entry p", 35, 0, 1), ("div.entry p", 2, 0, 1), ("div.entry div.share", 5, 5, 0), ("div.entry div.newsletter p", 17, 0, 0), ("div.entry p", 61, 2, 1), ("div.related h3", 3, 0, 0), ("div.related li", 8, 8, 0)),
    (("form label", 2, 0, 0), ("form p", 22, 0, 0), ("form button", 1, 0, 0), ("div p", 47, 0, 1), ("div p", 36, 0, 1), ("dialog p", 40, 0, 0), ("footer li", 2, 2, 0)),
)

Tree = bool | tuple[int, float, "Tree", "Tree"]


def variants(pages: tuple = LABELLED) -> Iterator[tuple]:
    """The labelled pages, ten times; and those without class words again with all containers as divisions, and with all blocks as such.

    There, words, links and neighbours have to decide. Blocks that only their element can tell (long ones that are no main text, links that are) are left out.
    """
    for page in pages:
        yield from [page] * 10
        if len(page) > 2 and not any(c in where for where, *_ in page for c in ".#"):
            own = tuple(row for row in page if (row[3] and 2 * row[2] < row[1]) or not row[3] and (row[1] <= 15 or 2 * row[2] > row[1]))
            yield tuple((f"div {where.split()[-1]}", *rest) for where, *rest in own)
            yield tuple(("div", *rest) for _, *rest in own)


def labelled_rows(pages: tuple = LABELLED) -> list[tuple[float, ...]]:
    """FEATURES of every block of the labelled pages and their variants, computed as for real ones, and at last the label."""
    out = []
    for page in variants(pages):
        blocks = []
        for where, words, linked, _ in page:
            context, parts = Context(), where.split()
            for part in parts:
                name, *marks = re.split(r"[.#]", part)
                if name in CONTAINERS:
                    context.enter(name, {"class": " ".join(marks)})
            last = parts[-1]
            blocks.append(context.block(" ".join(["w"] * words), linked, 2 if last in HEADINGS else 1 if last in PROSE else 0))
        out += [(*row, block[3]) for row, block in zip(features(blocks), page, strict=True)]
    return out


def grow(rows: list[tuple[float, ...]] | None = None, depth: int = 14, least: int = 2) -> Tree:
    """A binary decision tree by Gini impurity: a leaf is a verdict, a node (feature, threshold, at most, above). Both sides of a cut have ``least`` different rows."""
    rows = labelled_rows() if rows is None else rows
    positive = sum(r[-1] for r in rows)
    if depth == 0 or positive in (0, len(rows)):
        return 2 * positive > len(rows)

    def impurity(part: list) -> float:
        share = sum(r[-1] for r in part) / len(part)
        return len(part) * share * (1 - share)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            if min(len(set(low)), len(set(high))) >= least and (best is None or impurity(low) + impurity(high) < best[0] - 1e-12):
                best = (impurity(low) + impurity(high), f, cut, low, high)
    if best is None:
        return 2 * positive > len(rows)
    low, high = grow(best[3], depth - 1, least), grow(best[4], depth - 1, least)
    return low if low is high else (best[1], best[2], low, high)


def decide(tree: Tree, row: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree: Tree) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if decide(tree, row))


def extract_text(pages: DataFrame, labelled: tuple = LABELLED) -> DataFrame:
    """page_id, url, text and n_chars of every page. A page is extracted where it is read; nothing is shuffled."""
    tree = grow(labelled_rows(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x or "", tree) for x in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
