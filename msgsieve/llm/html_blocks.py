"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into text blocks at block-level tags.  A block's features are
its word count and link density, those of its neighbours, and where it stands
(container tags and the words of class, id and role).  A decision tree, grown
here from the labelled rows of ``LABELLED``, tells article text from the rest.
Pages are read one by one in the scan; nothing is shuffled.

Defined cases: a null or empty page has an empty text.  Unclosed and crossed
tags are tolerated; a "<" that opens no tag is text.  A page is read once from
left to right, in time proportional to its length whatever its markup; behind
a quote that never closes in a tag, quotes of that page up to there hide no
">".  Character references to numbers of any length are decoded.  Repeated rows are
extracted alike.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from msgsieve.llm.common import as_columns

# Element and attribute words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul""".split())
SILENT = frozenset("script style noscript template svg math iframe object textarea select head title canvas audio video".split())
RAW = frozenset("script style textarea title".split())
FRAME = frozenset("nav footer aside form menu dialog button fieldset header".split())
MAIN = frozenset("article main".split())
ENDS_P = BLOCK - frozenset("button label option body html head title".split())
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIDE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo
cookie cookies copyright dialog disclaimer discussion disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice
notification overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social
sponsor sponsored subscribe subscription tags toolbar topbar widget alert""".split())
MAIN_WORDS = frozenset("article content entry main post story text".split())

TALK_WORDS = frozenset("comment comments discussion disqus replies reply respond".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption span a b i em strong".split())

START = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile(r"""[>"']""")
ZEROS, HUGE = re.compile(r"&#0{8,}"), re.compile(r"&#[0-9]{9,};?")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# words, link density, words before, density before, words after, density after, frame, side, main, heading, page has main -> article text?
FEATURES = "words density words_before density_before words_after density_after frame side main heading has_main".split()
LABELLED = [
    # Pages with a main container: what stands in it and in no frame is the article.
    (80, 0.0, 60, 0.0, 90, 0.0, 0, 0, 1, 0, 1, 1), (1, 0.0, 70, 0.0, 40, 0.0, 0, 0, 1, 0, 1, 1), (6, 0.0, 8, 0.0, 50, 0.0, 0, 0, 1, 1, 1, 1), (3, 0.0, 30, 0.0, 0, 0.0, 0, 0, 1, 0, 1, 1),
    (25, 0.5, 60, 0.0, 70, 0.0, 0, 0, 1, 0, 1, 1), (4, 1.0, 45, 0.0, 45, 0.0, 0, 0, 1, 0, 1, 1), (12, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 1, 1, 1), (150, 0.02, 9, 0.0, 4, 0.0, 0, 0, 1, 0, 1, 1),
    (9, 0.0, 9, 0.0, 9, 0.0, 0, 0, 1, 0, 1, 1), (40, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 0, 1, 1), (2, 0.0, 0, 0.0, 2, 0.0, 0, 0, 1, 0, 1, 1), (60, 0.3, 5, 1.0, 5, 1.0, 0, 0, 1, 0, 1, 1),
    (30, 0.0, 70, 0.0, 20, 0.0, 0, 1, 1, 0, 1, 0), (8, 0.0, 70, 0.0, 60, 0.0, 0, 1, 1, 0, 1, 0), (90, 0.0, 80, 0.0, 40, 0.0, 0, 1, 1, 0, 1, 0), (5, 1.0, 40, 0.0, 5, 1.0, 1, 0, 1, 0, 1, 0),
    (20, 0.0, 60, 0.0, 60, 0.0, 1, 0, 1, 0, 1, 0), (45, 0.0, 20, 0.0, 8, 0.0, 1, 1, 1, 0, 1, 0), (4, 0.0, 20, 0.0, 30, 0.0, 0, 1, 1, 1, 1, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0, 1, 0), (2, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0, 1, 0), (18, 0.0, 1, 1.0, 12, 0.0, 0, 1, 0, 0, 1, 0), (25, 0.0, 50, 0.0, 0, 0.0, 1, 0, 0, 0, 1, 0),
    (14, 0.0, 90, 0.0, 0, 0.0, 1, 0, 0, 0, 1, 0), (70, 0.0, 1, 1.0, 10, 0.0, 0, 0, 0, 0, 1, 0), (12, 0.0, 60, 0.0, 3, 0.0, 0, 0, 0, 0, 1, 0), (6, 0.2, 12, 0.0, 50, 0.0, 0, 0, 0, 1, 1, 0),
    (100, 0.0, 30, 0.0, 30, 0.0, 0, 1, 0, 0, 1, 0), (3, 1.0, 3, 1.0, 80, 0.0, 0, 0, 0, 0, 1, 0), (40, 0.1, 40, 0.1, 40, 0.1, 1, 1, 0, 0, 1, 0),
    # Pages without one: blocks with few links, short ones too, and links that stand in text; blocks of links among links are menus.
    (60, 0.0, 40, 0.0, 70, 0.0, 0, 0, 0, 0, 0, 1), (25, 0.05, 2, 1.0, 60, 0.0, 0, 0, 0, 0, 0, 1), (18, 0.0, 50, 0.0, 3, 0.5, 0, 0, 0, 0, 0, 1), (4, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0, 0, 1),
    (5, 0.0, 2, 1.0, 50, 0.0, 0, 0, 0, 1, 0, 1), (7, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0, 1, 0, 1), (120, 0.2, 60, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 1), (8, 0.0, 45, 0.0, 25, 0.0, 0, 0, 0, 0, 0, 1),
    (30, 0.1, 6, 0.0, 4, 0.0, 0, 0, 0, 0, 0, 1), (45, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (9, 0.0, 0, 0.0, 70, 0.0, 0, 0, 0, 1, 0, 1), (16, 0.0, 20, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0), (10, 0.9, 3, 1.0, 60, 0.0, 0, 0, 0, 0, 0, 0), (30, 0.8, 40, 0.0, 30, 0.8, 0, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0),
    (5, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0, 0, 0, 1), (6, 0.5, 50, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 1), (2, 0.0, 1, 0.0, 5, 0.0, 0, 0, 0, 0, 0, 1), (60, 0.7, 8, 0.9, 9, 0.9, 0, 0, 0, 0, 0, 0),
    (50, 0.0, 40, 0.0, 30, 0.0, 0, 1, 0, 0, 0, 0), (12, 0.0, 40, 0.0, 30, 0.0, 1, 0, 0, 0, 0, 0), (80, 0.0, 40, 0.0, 30, 0.0, 1, 0, 0, 0, 0, 0), (5, 0.0, 60, 0.0, 60, 0.0, 0, 1, 0, 0, 0, 0),
    (3, 0.67, 4, 0.0, 5, 0.0, 0, 0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (4, 0.75, 30, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 1), (3, 1.0, 40, 0.0, 40, 0.0, 0, 0, 0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 2, 0.0, 0, 0, 0, 1, 0, 1), (3, 0.0, 2, 1.0, 2, 0.0, 0, 0, 0, 1, 0, 1), (4, 0.0, 2, 1.0, 9, 0.0, 0, 0, 0, 0, 0, 1), (3, 0.67, 5, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (6, 0.0, 4, 0.7, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 20, 0.0, 0, 0, 0, 0, 0, 0), (2, 1.0, 2, 1.0, 4, 0.0, 0, 0, 0, 1, 0, 0), (2, 1.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0, 0, 0), (1, 1.0, 30, 0.0, 1, 1.0, 0, 0, 0, 0, 0, 0),
    (4, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0, 1, 0, 0), (6, 1.0, 60, 0.0, 70, 0.0, 1, 0, 0, 0, 0, 0),
]


@dataclass
class Node:
    share: float
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> Node:
    """Binary tree by Gini impurity; limits lie halfway between neighbouring values."""
    node = Node(float(labels.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = (np.inf, 0, 0.0)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            side = rows[:, f] <= limit
            cost = sum(len(x) * x.mean() * (1 - x.mean()) for x in (labels[side], labels[~side]))
            if cost < best[0] - 1e-12:
                best = (cost, f, float(limit))
    if best[0] == np.inf:
        return node
    side = rows[:, best[1]] <= best[2]
    node.feature, node.limit = best[1], best[2]
    node.low, node.high = grow(rows[side], labels[side], depth - 1), grow(rows[~side], labels[~side], depth - 1)
    return node


@lru_cache(1)
def article_tree() -> Node:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def is_article(tree: Node, features: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.low if features[tree.feature] <= tree.limit else tree.high
    return tree.share > 0.5


def _words_of(attributes: str, whole: bool) -> set[str]:
    """Words of class, id and role; with ``whole`` the names as they stand, else also their pieces."""
    found: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        found.update(x.lower() for x in (value.split() if whole else PIECE.findall(value)))
    return found


def _decoded(raw: str) -> str:
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = HUGE.sub("\ufffd", ZEROS.sub("&#0", raw))  # numbers of any length
    return unescape(raw)


class _Tags:
    """Tags of a page from left to right; every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.unclosed = -1  # up to here quotes hide nothing: one that opens here never closes

    def _end(self, at: int) -> int:
        """Place after the ``>`` that ends a tag whose attributes start at ``at``; -1 without any."""
        first = self.page.find(">", at)
        if first < 0 or at <= self.unclosed:
            return first + 1 or -1
        while found := STOP.search(self.page, at):
            if found[0] == ">":
                return found.end()
            at = self.page.find(found[0], found.end()) + 1
            if not at:
                self.unclosed = found.start()
                break
        return first + 1

    def __iter__(self) -> Iterator[tuple[str, str, str, str]]:
        """(text before, slash, tag in lower case, attributes); the last one is text alone."""
        page, begin, look = self.page, 0, 0
        while found := START.search(page, look):
            if found[1]:
                end = page.find("-->", found.end())
                end = end + 3 if end >= 0 else len(page)
            elif (end := self._end(found.end()) if found[3] else page.find(">", found.end()) + 1 or -1) < 0:
                # No tag ends any more; a comment may still begin.
                comment = page.find("<!--", found.start())
                yield page[begin:comment if comment >= 0 else len(page)], "", "", ""
                return
            self.at = end
            yield page[begin:found.start()], found[2] or "", (found[3] or "").lower(), page[found.end():end - 1] if found[3] else ""
            begin = look = self.at
        yield page[begin:], "", "", ""

    def skip(self, tag: str) -> None:
        """Go behind the end tag of ``tag``, or to the end of the page."""
        close = re.compile(rf"</{tag}\b", re.I).search(self.page, self.at)
        self.at = (self.page.find(">", close.end()) + 1 if close else 0) or len(self.page)


# tag, silent, frame, side, main, heading, link, innermost container that may turn out to be the page
Open = tuple[str, bool, bool, bool, bool, bool, bool, int]


def text_blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, bool]]:
    """(text, words, words in links, frame, side, main, heading) of each block with text, in page order.

    A form, or an element with a side word, that holds an article and more
    than half of the page's words is the page itself and no form or sidebar;
    so is one around the ``main`` element, and a form with most words of a
    page without articles.  Comments and teasers stay out also as articles.
    """
    blocks, parts, links = [], [], 0
    stack: list[Open] = [("", False, False, False, False, False, False, -1)]
    state = stack[0]
    opened: Counter[str] = Counter()
    articles = 0
    # Containers that may be the page: the one around, words in it, whether it is a form, whether it holds main or an article.
    around: list[int] = []
    sizes: list[int] = []
    is_form: list[bool] = []
    holds_main: list[bool] = []
    holds_article: list[bool] = []

    def close() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = text.count(" ") + 1
                blocks.append((text, n, links, *state[2:6], state[7]))
                if state[7] >= 0 and not state[2] and not state[3]:
                    sizes[state[7]] += n
        parts, links = [], 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not state[1]:
            text = _decoded(raw)
            parts.append(text)
            if state[6]:
                links += len(text.split())

    def leave(tag: str) -> bool:
        nonlocal state
        if not opened[tag]:
            return False
        depth = len(stack) - 1
        while stack[depth][0] != tag:
            depth -= 1
        if any(x[0] in BLOCK for x in stack[depth:]):
            close()
        for x in stack[depth:]:
            opened[x[0]] -= 1
        del stack[depth:]
        state = stack[-1]
        return True

    tags = _Tags(page)
    for before, slash, tag, rest in tags:
        add(before)
        if not tag:
            continue
        if slash:
            if not leave(tag) and tag in BLOCK:
                close()
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in BLOCK:
            close()
        if tag in ENDS_P and any(x[0] == "p" for x in stack[-4:]):
            leave("p")
        if tag in SELF_ENDING and stack[-1][0] in SELF_ENDING[tag]:
            leave(stack[-1][0])
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        words = _words_of(rest, tag in PLAIN) if "=" in rest else ()
        named = bool(words) and not SIDE_WORDS.isdisjoint(words) and tag not in ("body", "html", "article", "main")
        talk = named and not TALK_WORDS.isdisjoint(words)
        main = tag in MAIN or (bool(words) and not named and not MAIN_WORDS.isdisjoint(words) and tag in ("div", "section", "td"))
        _, silent, frame, side, in_main, heading, link, doubtful = state
        if tag in MAIN and not frame and not side:
            articles += 1
            if doubtful >= 0:
                (holds_main if tag == "main" else holds_article)[doubtful] = True
        frame = frame or (tag in FRAME and tag != "form" and not (tag == "header" and in_main))
        if tag == "form" or named and not talk:
            around.append(doubtful)
            sizes.append(0)
            is_form.append(tag == "form")
            holds_main.append(False)
            holds_article.append(False)
            doubtful = len(sizes) - 1
        side = side or talk
        state = (tag, silent or tag in SILENT, frame, side, in_main or main, heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6"), link or tag == "a", doubtful)
        stack.append(state)
        opened[tag] += 1
        if tag in RAW:
            tags.skip(tag)
            opened[tag] -= 1
            stack.pop()
            state = stack[-1]
    close()
    for x in range(len(sizes) - 1, -1, -1):  # a container comes behind the one around it
        if around[x] >= 0:
            sizes[around[x]] += sizes[x]
            holds_main[around[x]] |= holds_main[x]
            holds_article[around[x]] |= holds_article[x]
    total = sum(n for _, n, _, frame, side, *_ in blocks if not frame and not side)
    beside = [False] * len(sizes)
    for x, n in enumerate(sizes):
        page_itself = holds_main[x] or 2 * n > total and (holds_article[x] or is_form[x] and not articles)
        beside[x] = not page_itself or around[x] >= 0 and beside[around[x]]
    return [(text, n, linked, frame, side or doubtful >= 0 and beside[doubtful], main, heading) for text, n, linked, frame, side, main, heading, doubtful in blocks]


def main_text(page: str | None) -> str:
    """Article blocks of a page, joined by an empty line."""
    blocks = text_blocks(page or "")
    has_main = any(b[5] and not b[3] and not b[4] for b in blocks)
    shape = [(0, 0.0), *((b[1], min(1.0, b[2] / b[1])) for b in blocks), (0, 0.0)]
    tree = article_tree()
    kept = [b[0] for i, b in enumerate(blocks, 1)
            if is_article(tree, (*shape[i], *shape[i - 1], *shape[i + 1], b[3], b[4], b[5], b[6], has_main))]
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page (page_id, url, html)."""
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                piece = batch.iloc[at:at + 500]
                yield pd.DataFrame({"page_id": piece["page_id"].astype("Int64"), "url": piece["url"], "text": [main_text(x) for x in piece["html"]]})

    return as_columns(pages, page_id="long", url="string", html="string").mapInPandas(extract, "page_id long, url string, text string")
