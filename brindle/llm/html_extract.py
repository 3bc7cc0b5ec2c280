"""Operator 4: HTML main text from flat text blocks.

The page is flattened to text blocks at block-level tags. Each block is described by its words and link density, those of its
neighbours, and whether it lies in a marked-off region, in the article element, or there under a name that partly reads like a
region; a decision tree, trained on the small labelled table below, keeps or drops it. Kept blocks are joined in page order by two line breaks.

One pass over whole pages without a shuffle. Defined results: null or empty html gives an empty text; broken markup
(missing ends, stray tags) is read as far as it goes; repeated rows are extracted alike; extra columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from brindle.llm.common import pick, stream

#: No part of it can run past the next "<" outside of quotes and be tried again there, so a page is read in linear time.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^<>]*+>|<\?[^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+'|\"[^\"]{0,2000}+\"|'[^']{0,2000}+')*+)>", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z]+")

#: Elements whose content is never text of the page. Fixed values.
SKIPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "video", "audio", "head", "title", "select", "textarea", "button"}
#: Elements that begin and end a block. Fixed values.
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that mark off what is not the article. Fixed values.
APART = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "address"}
#: Words in class, id or role that mark off the same. Fixed values.
APART_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "discussion", "disqus", "footer", "gdpr", "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "rail", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "topbar", "widget"}
MAIN = {"article", "main"}
MAIN_NAMES = {"article", "content", "entry", "main", "post", "story"}

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words that, beside one of APART_NAMES, only say that an element holds such things. Fixed values.
HOLDERS = {"area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "container", "content", "entry", "form", "group", "header", "item", "items", "label", "left", "links", "list", "news", "pages", "panel", "posts", "right", "section", "site", "slot", "stories", "thread", "title", "top", "unit", "wrapper"}

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "apart", "in_main", "page_has_main", "named")
#: The labelled table: the features above but the last, then 1 for main text.
LABELLED = (
    # menus, footers, side columns and notices, marked off
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0), (2, 1.0, 1, 1.0, 8, 0.0, 1, 0, 1, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1, 0), (40, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1, 0), (12, 0.0, 90, 0.0, 0, 0.0, 1, 0, 1, 0),
    (14, 0.1, 60, 0.0, 3, 1.0, 1, 0, 0, 0), (25, 0.0, 60, 0.0, 30, 0.0, 1, 0, 0, 0), (5, 0.0, 0, 0.0, 30, 0.0, 1, 0, 0, 0),
    (60, 0.0, 50, 0.0, 40, 0.0, 1, 0, 0, 0), (30, 0.0, 45, 0.0, 20, 0.0, 1, 1, 1, 0), (6, 1.0, 45, 0.0, 5, 1.0, 1, 1, 1, 0),
    (9, 0.2, 12, 0.0, 22, 0.0, 1, 1, 1, 0), (80, 0.0, 12, 0.0, 22, 0.0, 1, 1, 1, 0),
    # the article element
    (9, 0.0, 8, 0.0, 60, 0.0, 0, 1, 1, 1), (60, 0.0, 9, 0.0, 45, 0.0, 0, 1, 1, 1), (1, 0.0, 60, 0.0, 2, 0.0, 0, 1, 1, 1),
    (2, 0.0, 1, 0.0, 90, 0.0, 0, 1, 1, 1), (120, 0.1, 80, 0.0, 70, 0.0, 0, 1, 1, 1), (30, 0.0, 25, 0.0, 10, 0.0, 0, 1, 1, 1),
    (6, 1.0, 60, 0.0, 40, 0.0, 0, 1, 1, 1), (20, 0.6, 30, 0.0, 30, 0.1, 0, 1, 1, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1), (15, 0.0, 1, 1.0, 12, 0.0, 0, 1, 1, 1),
    # outside of an article element that the page has
    (9, 0.0, 1, 1.0, 12, 0.0, 0, 0, 1, 0), (12, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 0), (3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 1, 0), (40, 0.0, 60, 0.0, 9, 0.0, 0, 0, 1, 0), (25, 0.1, 4, 1.0, 30, 0.0, 0, 0, 1, 0),
    # the article element: long paragraphs beside long, short, linked or no neighbours
    (40, 0.0, 60, 0.0, 9, 0.0, 0, 1, 1, 1), (14, 0.0, 108, 0.0, 2, 0.0, 0, 1, 1, 1), (25, 0.1, 60, 0.0, 0, 0.0, 0, 1, 1, 1), (150, 0.0, 130, 0.0, 7, 0.0, 0, 1, 1, 1), (60, 0.0, 300, 0.0, 18, 0.0, 0, 1, 1, 1), (30, 0.3, 46, 0.0, 1, 1.0, 0, 1, 1, 1),
    (25, 0.1, 4, 1.0, 30, 0.0, 0, 1, 1, 1), (60, 0.0, 2, 1.0, 60, 0.0, 0, 1, 1, 1), (120, 0.0, 9, 0.8, 20, 0.0, 0, 1, 1, 1), (40, 0.2, 20, 1.0, 0, 0.0, 0, 1, 1, 1), (17, 0.0, 60, 1.0, 40, 0.0, 0, 1, 1, 1),
    # running text outside of it
    (40, 0.0, 30, 0.0, 5, 0.0, 0, 0, 1, 1), (20, 0.0, 9, 0.0, 0, 0.0, 0, 0, 1, 1), (60, 0.0, 60, 0.0, 60, 0.0, 0, 0, 1, 1), (40, 0.1, 30, 0.0, 45, 0.0, 0, 0, 1, 1), (20, 0.0, 60, 0.0, 25, 0.0, 0, 0, 1, 1), (15, 0.0, 9, 0.0, 60, 0.0, 0, 0, 1, 1), (120, 0.0, 2, 0.0, 30, 0.1, 0, 0, 1, 1),
    # pages without one: words and links of the block and its neighbours decide
    (60, 0.0, 9, 0.0, 45, 0.0, 0, 0, 0, 1), (45, 0.05, 60, 0.0, 30, 0.0, 0, 0, 0, 1), (18, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 1), (30, 0.2, 20, 0.1, 25, 0.0, 0, 0, 0, 1),
    (3, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0, 1), (1, 0.0, 25, 0.0, 30, 0.0, 0, 0, 0, 1), (7, 0.0, 1, 1.0, 80, 0.0, 0, 0, 0, 1), (8, 0.0, 2, 1.0, 35, 0.0, 0, 0, 0, 1), (20, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 1), (25, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (40, 0.0, 2, 1.0, 2, 0.0, 0, 0, 0, 1), (30, 0.0, 2, 0.0, 2, 1.0, 0, 0, 0, 1), (120, 0.0, 3, 1.0, 1, 0.0, 0, 0, 0, 1), (55, 0.1, 1, 0.0, 3, 1.0, 0, 0, 0, 1), (80, 0.0, 0, 0.0, 4, 1.0, 0, 0, 0, 1), (200, 0.05, 5, 0.0, 5, 0.0, 0, 0, 0, 1),
    (40, 0.0, 60, 0.0, 9, 0.0, 0, 0, 0, 1), (25, 0.0, 108, 0.0, 2, 0.0, 0, 0, 0, 1), (60, 0.1, 60, 0.0, 0, 0.0, 0, 0, 0, 1), (150, 0.0, 130, 0.0, 7, 0.0, 0, 0, 0, 1), (30, 0.0, 46, 0.0, 3, 1.0, 0, 0, 0, 1), (25, 0.1, 4, 1.0, 30, 0.0, 0, 0, 0, 1), (60, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 1),
    (2, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 1), (5, 0.0, 120, 0.0, 90, 0.0, 0, 0, 0, 1), (9, 0.0, 55, 0.1, 25, 0.0, 0, 0, 0, 1),
    (3, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0), (2, 1.0, 30, 0.0, 3, 0.0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 5, 0.0, 0, 0, 0, 0), (8, 0.9, 90, 0.0, 60, 0.0, 0, 0, 0, 0), (35, 0.8, 4, 1.0, 3, 1.0, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (6, 0.8, 40, 0.0, 5, 1.0, 0, 0, 0, 0), (15, 0.7, 3, 1.0, 9, 0.8, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0),
    (4, 0.0, 6, 0.0, 5, 0.0, 0, 0, 0, 0), (5, 0.0, 3, 0.5, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 2, 0.0, 3, 1.0, 0, 0, 0, 0), (30, 0.9, 30, 0.0, 20, 0.5, 0, 0, 0, 0),
)
#: More rows, of blocks in the article element under a name that partly reads like one of APART_NAMES: words and links decide.
NAMED = (
    (60, 0.0, 40, 0.0, 30, 0.0, 0, 1, 1, 1), (25, 0.1, 60, 0.0, 20, 0.0, 0, 1, 1, 1), (9, 0.0, 8, 0.0, 60, 0.0, 0, 1, 1, 1), (15, 0.0, 30, 0.0, 12, 0.0, 0, 1, 1, 1), (40, 0.2, 9, 0.0, 0, 0.0, 0, 1, 1, 1), (2, 0.0, 60, 0.0, 45, 0.0, 0, 1, 1, 1),
    (3, 1.0, 2, 1.0, 3, 1.0, 0, 1, 1, 0), (6, 0.9, 60, 0.0, 5, 1.0, 0, 1, 1, 0), (4, 1.0, 50, 0.0, 40, 0.0, 0, 1, 1, 0), (8, 0.8, 30, 0.0, 2, 1.0, 0, 1, 1, 0), (12, 0.7, 20, 0.0, 9, 0.6, 0, 1, 1, 0), (30, 0.8, 45, 0.0, 12, 0.0, 0, 1, 1, 0),
)


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    apart: bool
    in_main: bool
    named: bool


def _attributes(raw: str, element: str) -> tuple[bool, bool, bool, bool]:
    """From class, id and role: whether a whole name marks the element off, whether any word of one does, whether one names the
    main text; and whether the element is hidden."""
    whole = partly = main = hidden = False
    if raw and not raw.isspace():
        for key, value in _ATTR.findall(raw):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id", "role"):
                for token in value.split():
                    parts = _NAME.findall(token)
                    marked = [x in APART_NAMES for x in parts]
                    partly |= any(marked)
                    main |= any(x in MAIN_NAMES for x in parts)
                    if element not in HEADINGS and not (element == "section" and key == "id") and any(marked):
                        whole |= all(m or x in HOLDERS for m, x in zip(marked, parts))
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
    return whole, partly, main, hidden


def blocks(page: str) -> list[Block]:
    """Flat text blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, apart, in_main, named
    depth: Counter[str] = Counter()  # open elements by name
    endless: set[str] = set()  # skipped elements that the rest of the page does not close
    words: list[str] = []
    state = {"links": 0, "link": 0}

    def flush() -> None:
        text = " ".join("".join(words).split())
        if text:
            n = len(text.split(" "))
            _, apart, main, named = stack[-1] if stack else ("", False, False, False)
            out.append(Block(text, n, min(1.0, state["links"] / n), apart, main, named))
        words.clear()
        state["links"] = 0

    def add(text: str) -> None:
        text = htmllib.unescape(text)
        words.append(text)
        if state["link"]:
            state["links"] += len(text.split())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        closing, name, raw = m[1], (m[2] or "").lower(), m[3] or ""
        if not name:
            continue
        if not closing and name in SKIPPED and not raw.endswith("/"):
            close = None if name in endless else re.compile(rf"</{name}\s*+>", re.I).search(page, at)
            if close is None and name not in endless:
                endless.add(name)
            if close is None and name == "head":
                close = re.compile(r"(?=<body)", re.I).search(page, at)
            at = close.end() if close else (end if name in ("script", "style", "noscript", "template") else at)
            continue
        if name == "a":
            state["link"] = 0 if closing else 1
            continue
        if name == "br":
            words.append(" ")
            continue
        if name not in BLOCK:
            if name in ("img", "input"):
                words.append(" ")
            continue
        flush()
        if closing:
            while depth[name]:
                ended = stack.pop()[0]
                depth[ended] -= 1
                if ended == name:
                    break
            continue
        if name in VOID:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] in ({name} | ({"dt", "dd"} if name in ("dt", "dd") else {"td", "th"} if name in ("tr", "td", "th") else set())):
            depth[stack.pop()[0]] -= 1  # these end where the next begins
        elif name != "p" and stack and stack[-1][0] == "p":
            depth[stack.pop()[0]] -= 1  # no block element lies in a paragraph
        whole, partly, called_main, hidden = _attributes(raw, name)
        _, apart, main, named = stack[-1] if stack else ("", False, False, False)
        in_main = main or name in MAIN or called_main and not partly
        # outside of the article any such word marks an element off, inside only a name that says nothing else
        marked = (whole or partly and not main) and name not in ("html", "body", *MAIN)
        own = hidden or marked or name in APART and not (name == "header" and main)
        stack.append((name, apart or own, in_main, named or partly and main))
        depth[name] += 1
    flush()
    return out


def feature_rows(found: list[Block]) -> list[tuple]:
    has_main = any(b.in_main and not b.apart for b in found)
    edge = Block("", 0, 0.0, False, False, False)
    rows = []
    for before, b, after in zip([edge, *found[:-1]], found, [*found[1:], edge]):
        rows.append((b.words, b.link_density, before.words, before.link_density, after.words, after.link_density, int(b.apart), int(b.in_main), int(has_main), int(b.named)))
    return rows


class Tree:
    """A classification tree by Gini impurity; ties go to the earlier feature and the lesser threshold."""

    def __init__(self, rows: list[tuple], labels: list[int], depth: int = 7):
        self.value = int(2 * sum(labels) >= len(labels))
        self.split = None
        if depth == 0 or len(set(labels)) == 1:
            return
        best = None
        for f in range(len(rows[0])):
            values = sorted({r[f] for r in rows})
            for low, high in zip(values, values[1:]):
                cut = (low + high) / 2
                left = [y for r, y in zip(rows, labels) if r[f] <= cut]
                right = [y for r, y in zip(rows, labels) if r[f] > cut]
                gini = sum(len(s) - sum(s) ** 2 / len(s) - (len(s) - sum(s)) ** 2 / len(s) for s in (left, right))
                if best is None or gini < best[0] - 1e-9:
                    best = (gini, f, cut)
        if best is None:
            return
        _, f, cut = best
        sides = [[(r, y) for r, y in zip(rows, labels) if (r[f] <= cut) == side] for side in (True, False)]
        self.split = (f, cut)
        self.left, self.right = (Tree([r for r, _ in s], [y for _, y in s], depth - 1) for s in sides)

    def predict(self, row: tuple) -> int:
        node = self
        while node.split:
            node = node.left if row[node.split[0]] <= node.split[1] else node.right
        return node.value


@lru_cache(maxsize=1)
def tree() -> Tree:
    rows = [(*r[:-1], 0) for r in LABELLED] + [(*r[:-1], 1) for r in NAMED]
    return Tree(rows, [r[-1] for r in (*LABELLED, *NAMED)])


def main_text(page: str) -> str:
    found = blocks(page)
    t = tree()
    return "\n\n".join(b.text for b, row in zip(found, feature_rows(found)) if t.predict(row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(ids: list, urls: list, htmls: list) -> Iterator[tuple]:
        for i, u, h in zip(ids, urls, htmls):
            text = main_text(h or "")
            yield i, u, text, len(text)

    return stream(pick(pages, ("page_id", "long"), ("url", "string"), ("html", "string")), run, "page_id long, url string, text string, n_chars long")
