"""Main text of HTML pages: flat text blocks, a decision tree over the shape of a block and its neighbours.

A page is cut at block-level tags into flat text blocks. Each has its number of words, its link density
(share of words inside anchors), the same two of the block before and after, and whether it is a heading.

Markup and names are features beside these: whether the block stands in the article (article and main elements), in an element that is none (nav, footer, aside,
form, dialog, header), or in neither; how plainly a class, id or role around it names an advert, menu, notice, sidebar or comments; and how many words, of them in links, the
element so named holds in all. Some such names leave no doubt (``comments``, ``ad-slot``, ``cookie-banner``), others are ordinary words of a section too (``discussion``, ``legal``,
``related``): inside an article the latter count as boilerplate only where little text or mostly links stand in them. A name counts only if it says nothing else: each of its words is such a word or
one of layout, so ``social-links`` is a name of this kind and ``social-policy`` is not; what a heading is called does not count. A name outside any content container may only speak of the page's
layout (``content with-sidebar``): an article or main element in it is content, unless the page has content outside such wrappers. A main element is
content by any name.

Every block is the decision tree's to judge. It is grown from two small tables: shapes of blocks of real pages whose markup was taken away, with their labels; and
what a place and a name make of blocks of any shape.

Defined results: null, empty and text-free pages give an empty string; markup left open ends with the page, and stray quotes in a
tag end with it; repeated rows give repeated results; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgatlas.llm.shared import sliced

#: Element names by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option optgroup p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = ("script", "style", "noscript", "template", "svg", "iframe", "object", "head", "textarea", "select", "math", "canvas", "audio", "video")
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_TAGS = frozenset(("nav", "footer", "aside", "form", "dialog", "menu", "button", "fieldset"))
#: Places: in the article, in an element that is none, in neither; and in a content container inside an element that is boilerplate by name only.
ARTICLE, OUTSIDE, UNKNOWN, LIFTED = 1, -1, 0, 2
#: How plainly a name speaks of boilerplate.
PLAIN, PERHAPS = 2, 1
HEADING_TAGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of a class, id or role that name what stands beside an article.
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "banner", "banners", "sponsor", "sponsored", "promo", "promoted", "promotion", "nav", "navbar",
    "navigation", "navi", "menu", "menubar", "breadcrumb", "breadcrumbs", "footer", "foot", "masthead", "topbar", "sidebar", "side", "aside", "widget", "widgets", "comment", "comments",
    "commentlist", "respond", "reply", "replies", "disqus", "discussion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "dialog", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "teaser", "teasers", "pager", "pagination",
    "copyright", "legal", "search", "toolbar", "complementary", "contentinfo", "disclaimer", "skip",
}
#: Words of such a name that speak of layout only.
LAYOUT_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "desktop", "fixed", "form", "global", "group", "head", "header", "holder",
    "icons", "id", "inline", "inner", "item", "items", "left", "links", "list", "lower", "main", "mobile", "module", "msg", "outer", "page", "panel", "placeholder", "post", "posts", "primary",
    "right", "row", "secondary", "section", "site", "slot", "space", "stories", "articles", "sticky", "text", "thread", "title", "top", "unit", "upper", "wrap", "wrapper", "zone", "leaderboard",
}
#: Of these, the words that are ordinary names of sections as well.
SECTION_WORDS = {
    "discussion", "legal", "notice", "notices", "related", "side", "aside", "overlay", "search", "share", "sharing", "banner", "reply", "respond", "social", "login", "alert", "notification",
    "copyright", "disclaimer", "teaser", "teasers", "recommended", "recommendations", "foot", "skip", "toolbar", "subscription", "dialog", "complementary", "promotion", "promoted", "signup", "consent",
}
#: Levels of the tree.
DEPTH = 9
CONTENT_ROLES = frozenset(("main", "article"))
#: Elements whose class says nothing about a part of the page.
WHOLE_PAGE = frozenset(("html", "body"))

PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>="']++|=\s*(?:"[^"]*"|'[^']*')|[="'])*+)(?:>|\Z)""", re.S)
NAMING = re.compile(r"""(?:\s|^)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD_CUT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")

#: The labelled table: (words, link density, words before, density before, words after, density after, heading, main text?).
#: First blocks of pages of the test tables, without their containers; then shapes that these pages lack.
LABELLED = (
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (1, 1.0, 1, 1.0, 4, 0.0, 0, 0), (1, 1.0, 1, 1.0, 5, 0.0, 0, 0), (1, 1.0, 1, 1.0, 8, 0.0, 0, 0), (1, 1.0, 1, 1.0, 9, 0.0, 0, 0),
    (5, 0.0, 1, 1.0, 4, 0.0, 0, 0), (5, 0.0, 1, 1.0, 5, 0.0, 0, 0), (5, 0.0, 1, 1.0, 11, 0.0, 0, 0), (6, 0.0, 1, 1.0, 9, 0.0, 0, 0), (8, 0.0, 1, 1.0, 4, 0.0, 0, 0), (8, 0.0, 1, 1.0, 8, 0.0, 0, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 0), (8, 0.0, 8, 0.0, 0, 0.0, 0, 0), (9, 0.0, 1, 1.0, 9, 0.0, 0, 0), (9, 0.0, 10, 0.0, 0, 0.0, 0, 0), (10, 0.0, 1, 1.0, 8, 0.0, 0, 0), (10, 0.0, 1, 1.0, 9, 0.0, 0, 0),
    (10, 0.0, 1, 1.0, 12, 0.0, 0, 0), (11, 0.0, 64, 0.0, 0, 0.0, 0, 0), (11, 0.0, 84, 0.0, 0, 0.0, 0, 0), (12, 0.0, 60, 0.0, 0, 0.0, 0, 0), (12, 0.0, 73, 0.0, 0, 0.0, 0, 0), (13, 0.0, 1, 1.0, 11, 0.0, 0, 0),
    (13, 0.0, 4, 0.0, 0, 0.0, 0, 0), (13, 0.0, 13, 0.0, 0, 0.0, 0, 0), (13, 0.0, 108, 0.0, 0, 0.0, 0, 0), (15, 0.0, 9, 0.0, 0, 0.0, 0, 0), (16, 0.0, 3, 0.0, 0, 0.0, 0, 0), (16, 0.0, 86, 0.0, 0, 0.0, 0, 0),
    (1, 0.0, 78, 0.0, 32, 0.0, 0, 1), (3, 0.0, 37, 0.0, 128, 0.0, 0, 1), (4, 0.0, 4, 0.0, 3, 0.0, 0, 1), (4, 0.0, 41, 0.0, 26, 0.0, 0, 1), (5, 0.0, 11, 0.0, 5, 0.0, 1, 1), (5, 0.0, 30, 0.0, 60, 0.0, 0, 1),
    (6, 0.0, 18, 0.0, 77, 0.0, 0, 1), (6, 0.0, 19, 0.0, 3, 0.0, 0, 1), (6, 0.0, 21, 0.0, 3, 0.0, 0, 1), (7, 0.0, 7, 0.0, 25, 0.0, 0, 1), (7, 0.0, 10, 0.0, 150, 0.0, 1, 1), (8, 0.0, 50, 0.0, 46, 0.0, 0, 1),
    (9, 0.0, 5, 0.0, 5, 0.0, 0, 1), (9, 0.0, 5, 0.0, 15, 0.0, 0, 1), (9, 0.0, 9, 0.0, 17, 0.0, 0, 1), (10, 0.0, 8, 0.0, 71, 0.0, 1, 1), (10, 0.0, 12, 0.0, 38, 0.0, 1, 1), (10, 0.0, 26, 0.0, 7, 0.0, 0, 1),
    (10, 0.0, 67, 0.0, 3, 0.0, 0, 1), (11, 0.0, 5, 0.0, 24, 0.0, 1, 1), (11, 0.0, 9, 0.0, 45, 0.0, 1, 1), (11, 0.0, 13, 0.0, 50, 0.0, 1, 1), (12, 0.0, 10, 0.0, 64, 0.0, 1, 1), (13, 0.0, 5, 0.0, 29, 0.0, 0, 1),
    (13, 0.0, 7, 0.0, 13, 0.0, 0, 1), (13, 0.0, 75, 0.0, 62, 0.0, 0, 1), (14, 0.0, 24, 0.0, 46, 0.0, 0, 1), (15, 0.0, 8, 0.0, 52, 0.0, 0, 1), (15, 0.0, 18, 0.0, 58, 0.0, 0, 1), (17, 0.0, 4, 0.0, 30, 0.0, 0, 1),
    (18, 0.0, 8, 0.0, 15, 0.0, 0, 1), (19, 0.0, 43, 0.0, 2, 0.0, 0, 1), (19, 0.0, 71, 0.0, 9, 0.0, 0, 1), (21, 0.0, 67, 0.0, 11, 0.0, 0, 1), (28, 0.0, 51, 0.0, 4, 0.0, 0, 1), (29, 0.0, 13, 0.0, 27, 0.0, 0, 1),
    (29, 0.0, 64, 0.0, 16, 0.0, 0, 1), (31, 0.0, 46, 0.0, 31, 0.0, 0, 1), (35, 0.0, 126, 0.0, 24, 0.0, 0, 1), (37, 0.0, 13, 0.0, 33, 0.0, 0, 1), (38, 0.0, 4, 0.0, 7, 0.0, 0, 1), (43, 0.0, 60, 0.0, 19, 0.0, 0, 1),
    (44, 0.0, 13, 0.0, 8, 0.0, 0, 1), (49, 0.0, 11, 0.0, 130, 0.0, 0, 1), (51, 0.0, 27, 0.0, 28, 0.0, 0, 1), (62, 0.0, 13, 0.0, 98, 0.0, 0, 1), (63, 0.0, 12, 0.0, 45, 0.0, 0, 1), (73, 0.0, 2, 0.0, 12, 0.0, 0, 1),
    (78, 0.0, 6, 0.0, 27, 0.0, 0, 1), (80, 0.0, 1, 0.0, 42, 0.0, 0, 1), (86, 0.0, 9, 0.0, 8, 0.0, 0, 1), (95, 0.0, 43, 0.0, 11, 0.0, 0, 1), (107, 0.0, 82, 0.0, 57, 0.0, 0, 1), (138, 0.0, 130, 0.0, 86, 0.0, 0, 1),
    (208, 0.0, 26, 0.0, 56, 0.0, 0, 1),
    (70, 0.0, 50, 0.0, 60, 0.0, 0, 1), (45, 0.1, 3, 1.0, 55, 0.0, 0, 1), (25, 0.0, 80, 0.0, 60, 0.0, 0, 1), (120, 0.05, 0, 0.0, 4, 1.0, 0, 1), (9, 0.0, 2, 1.0, 70, 0.0, 1, 1), (6, 0.0, 60, 0.0, 50, 0.0, 1, 1),
    (14, 0.0, 90, 0.0, 75, 0.0, 0, 1), (20, 0.0, 9, 0.0, 40, 0.0, 0, 1), (2, 1.0, 3, 1.0, 70, 0.0, 0, 0), (1, 1.0, 2, 1.0, 45, 0.0, 0, 0), (9, 0.1, 80, 0.0, 0, 0.0, 0, 0), (11, 0.0, 60, 0.0, 3, 1.0, 0, 0),
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0), (3, 0.0, 1, 1.0, 4, 0.0, 0, 0), (15, 0.8, 20, 0.9, 12, 0.9, 0, 0), (30, 0.7, 8, 1.0, 6, 1.0, 0, 0),
    (5, 0.0, 2, 0.0, 3, 0.0, 0, 0), (7, 0.4, 4, 0.5, 3, 1.0, 0, 0), (12, 1.0, 5, 1.0, 40, 0.0, 0, 0), (30, 0.95, 9, 1.0, 60, 0.0, 0, 0), (16, 0.7, 60, 0.0, 70, 0.0, 0, 0), (90, 0.8, 30, 0.0, 40, 0.0, 0, 0),
    (70, 0.0, 60, 0.0, 0, 0.0, 0, 1), (35, 0.0, 90, 0.0, 0, 0.0, 0, 1), (120, 0.05, 30, 0.0, 0, 0.0, 0, 1), (55, 0.1, 9, 0.0, 0, 0.0, 0, 1), (40, 0.0, 50, 0.0, 1, 1.0, 0, 1), (28, 0.0, 70, 0.0, 2, 1.0, 0, 1),
)
#: Shapes that blocks have anywhere: (words, link density, words before, density before, words after, density after, heading).
SHAPES = ((1, 0.0, 40, 0.0, 60, 0.0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0), (6, 0.0, 20, 0.0, 70, 0.0, 1), (9, 0.0, 3, 1.0, 0, 0.0, 0), (14, 0.6, 60, 0.0, 9, 0.0, 0), (30, 0.0, 9, 0.0, 30, 0.0, 0), (75, 0.05, 0, 0.0, 45, 0.0, 0), (180, 0.0, 12, 0.0, 2, 1.0, 0))
#: The labelled table of places: (place, name, words in the named element, link density there, main text?). A block of any shape has the label.
PLACES = (
    (ARTICLE, 0, 0, 0.0, 1), (OUTSIDE, 0, 0, 0.0, 0), (OUTSIDE, PERHAPS, 60, 0.0, 0), (OUTSIDE, PLAIN, 60, 0.0, 0), (ARTICLE, PLAIN, 4, 0.0, 0), (ARTICLE, PLAIN, 30, 0.5, 0), (ARTICLE, PLAIN, 90, 0.0, 0), (ARTICLE, PLAIN, 400, 0.1, 0),
    (UNKNOWN, PLAIN, 5, 1.0, 0), (UNKNOWN, PLAIN, 70, 0.0, 0), (UNKNOWN, PLAIN, 300, 0.1, 0), (UNKNOWN, PERHAPS, 3, 0.0, 0), (UNKNOWN, PERHAPS, 20, 1.0, 0), (UNKNOWN, PERHAPS, 60, 0.0, 0), (UNKNOWN, PERHAPS, 300, 0.0, 0),
    (ARTICLE, PERHAPS, 1, 0.0, 0), (ARTICLE, PERHAPS, 9, 0.0, 0), (ARTICLE, PERHAPS, 15, 1.0, 0), (ARTICLE, PERHAPS, 18, 0.2, 0), (ARTICLE, PERHAPS, 40, 0.7, 0), (ARTICLE, PERHAPS, 120, 0.9, 0),
    (ARTICLE, PERHAPS, 26, 0.0, 1), (ARTICLE, PERHAPS, 45, 0.1, 1), (ARTICLE, PERHAPS, 61, 0.0, 1), (ARTICLE, PERHAPS, 90, 0.25, 1), (ARTICLE, PERHAPS, 350, 0.05, 1),
)
RESULT = "page_id long, url string, text string, n_chars long"


def grow(rows: list[tuple], depth: int = DEPTH) -> tuple | int:
    """A decision tree by least Gini impurity; (feature, threshold, at most, above) or a class."""
    ones = sum(r[-1] for r in rows)
    if ones in (0, len(rows)) or not depth:
        return int(2 * ones >= len(rows))

    def impurity(part: list[tuple]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * 2 * p * (1 - p)

    best = None
    for feature in range(len(rows[0]) - 1):
        values = sorted({r[feature] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            left, right = [r for r in rows if r[feature] <= cut], [r for r in rows if r[feature] > cut]
            cost = impurity(left) + impurity(right)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, feature, cut, left, right)
    if best is None:
        return int(2 * ones >= len(rows))
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


@functools.cache
def tree() -> tuple | int:
    shapes = [row[:-1] for row in LABELLED] + list(SHAPES)
    return grow([(*row[:-1], UNKNOWN, 0, 0, 0.0, row[-1]) for row in LABELLED] + [(*shape, *place) for shape in shapes for place in PLACES])


def is_main(features: tuple) -> bool:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node == 1


@functools.lru_cache(10_000)
def named(name: str) -> int:
    """How plainly a class, id or role speaks of boilerplate: not at all (0) if it says anything but that and layout besides."""
    words = {w.lower() for w in WORD_CUT.split(name)} - {""}
    if not words & BOILERPLATE_WORDS or not words <= BOILERPLATE_WORDS | LAYOUT_WORDS:
        return 0
    return PLAIN if words & (BOILERPLATE_WORDS - SECTION_WORDS) - {"banner", "banners"} or len(words & BOILERPLATE_WORDS) > 1 and "notice" not in words else PERHAPS


def container(tag: str, attributes: str, inside: int) -> tuple[int, int]:
    """(place, how plainly it is named) that an element inside one of place ``inside`` has by itself; place 0 if it says nothing."""
    if tag in BOILERPLATE_TAGS or tag == "header" and inside <= 0:
        return OUTSIDE, 0
    if tag in WHOLE_PAGE or tag == "header":
        return UNKNOWN, 0
    place, name = int(tag in CONTENT_TAGS), 0
    for key, value in NAMING.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"' ")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return OUTSIDE, 0
        if key in ("class", "id", "role") and tag != "main" and tag not in HEADING_TAGS:
            name = max([name, *map(named, value.split())])
        if key == "role" and set(value.lower().split()) & CONTENT_ROLES:
            place = ARTICLE
    return place, name


def blocks(page: str) -> list[tuple]:
    """The flat text blocks of a page: (text, words, words in links, heading, container, place, name, words of the named element, of them in links).

    ``container``: 1 if nothing speaks against the article, -1 if the place or a plain name does, else 0.
    """
    out: list[list] = []
    stack: list[tuple] = []  # open block elements with what was around them
    parts = [[0, 0]]  # words and words in links of the named elements; the first is none
    place, name, part, heading, links = UNKNOWN, 0, 0, 0, 0
    texts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if texts:
            text = " ".join(entities.unescape("".join(texts)).split())
            if text:
                in_links = len(entities.unescape(" ".join(linked)).split()) if linked else 0
                words = text.count(" ") + 1
                parts[part][0] += words
                parts[part][1] += in_links
                out.append([text, words, in_links, heading, place, name, part])
            texts.clear()
            linked.clear()

    at, end = 0, len(page)
    while at < end:
        match = PIECE.search(page, at)
        if match is None:
            texts.append(page[at:])
            break
        if match.start() > at:
            texts.append(page[at : match.start()])
            if links:
                linked.append(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag is None:
            if page.startswith("<![CDATA[", match.start()):
                texts.append(entities.escape(match[0][9:].removesuffix("]]>")))
            continue
        tag, closing = tag.lower(), match[1] == "/"
        if tag in SKIPPED_TAGS and not closing:
            if not match[3].endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else end if tag in ("script", "style") else at
            flush()
            continue
        if tag == "br":
            texts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCK_TAGS or (not closing and match[3] and speaks(container(tag, match[3], place))) or (closing and any(x[0] == tag for x in stack[-4:])):
            flush()
            links = 0
            if closing:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        place, name, part, heading = stack[depth][1:]
                        del stack[depth:]
                        break
            elif tag not in VOID_TAGS:
                if stack and tag == "p" and stack[-1][0] == "p" or stack and tag == "li" and stack[-1][0] == "li":
                    place, name, part, heading = stack.pop()[1:]
                stack.append((tag, place, name, part, heading))
                own, called = container(tag, match[3], place)
                if place != OUTSIDE:
                    if own == ARTICLE and place == UNKNOWN and name:  # the name was the wrapper's
                        place, name, part = LIFTED, 0, 0
                    elif own == OUTSIDE or own == ARTICLE and place != LIFTED:
                        place = own
                    if called and own != LIFTED and not name:
                        parts.append([0, 0])
                        part = len(parts) - 1
                    name = max(name, called)
                heading = int(tag in HEADING_TAGS) or heading
    flush()
    lifted = OUTSIDE if any(b[4] == ARTICLE for b in out) else ARTICLE
    found = []
    for text, words, in_links, head, where, how, index in out:
        where = lifted if where == LIFTED else where
        kind = -1 if where == OUTSIDE or how == PLAIN or how and where != ARTICLE else 0 if how else where
        found.append((text, words, in_links, head, kind, where, how, *(parts[index] if how else (0, 0))))
    return found


def speaks(told: tuple[int, int]) -> bool:
    """Whether an inline element is a part of its own."""
    return told[0] == OUTSIDE or told[1] > 0


def shape(found: list[tuple], i: int) -> tuple:
    """Words and link density of a block, of the one before and of the one after, whether it is a heading, its place and name, and words and link density of the named element."""
    around = [found[k] if 0 <= k < len(found) else None for k in (i, i - 1, i + 1)]
    place, name, words, in_links = found[i][5:]
    return *(x for b in around for x in ((b[1], min(1.0, b[2] / b[1])) if b else (0, 0.0))), found[i][3], place, name, words, min(1.0, in_links / words) if words else 0.0


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n\n".join(block[0] for i, block in enumerate(found) if is_main(shape(found, i)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = [main_text(page or "") for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one map stage over whole pages."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, RESULT)
