"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once into blocks, the stretches of text between block-level tags. Each block has its word
count and link density, those of its neighbours, and what its open elements say: whether one of them is
furniture (by tag, role, class or id, or hidden), whether it lies in the page's article, and whether it is
a heading. A decision tree, grown from the small labelled table below, keeps or drops each block.

Defined cases: a null or empty page gives an empty text; markup may be broken or unclosed; a page of any
length is read whole; repeated rows give equal texts; other columns are carried along by ``extract``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import added, column_values

#: Element names of HTML by their part in a page.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template svg math iframe object canvas audio video textarea title select datalist".split())
FURNITURE = frozenset("nav footer aside form menu dialog button label fieldset search".split())
ARTICLE = frozenset("article main".split())
SOLE = frozenset("p li dt dd option tr td th".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-ad comment comments commentlist disqus consent cookie cookies footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies reply respond recommended share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar widget widgets alert rail paywall".split()
)
ARTICLE_WORDS = frozenset("content article-body articlebody article-content entry-content post-content post-body story-body main-content maincontent".split())

STRUCTURE = frozenset("article main body".split())
TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9:_-]*")
EDGE = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
LONG_REFERENCE = re.compile(r"&#[0-9]{8,};?")
PART = re.compile(r"[\s_]+|-")


@dataclass
class Block:
    text: str
    words: int
    links: float
    furniture: bool
    article: bool
    heading: bool


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes name furniture, and whether they name the article."""
    furniture = article = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for word in value.split():
                article |= word in ARTICLE_WORDS
                furniture |= word in FURNITURE_WORDS or any(x in FURNITURE_WORDS for x in PART.split(word))
        elif name == "role":
            furniture |= value in FURNITURE_ROLES
            article |= value in ("main", "article")
        elif name == "style":
            furniture |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            furniture = True
    return furniture and not article, article


class Markup:
    """A page's tokens, each character looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.blind = False  # a quote in some tag is never closed: from there on quotes hide no ">"
        self.absent: set[str] = set()  # elements without a further end tag

    def _end(self, at: int) -> int:
        """Where the tag that began before ``at`` ends, after its ">"; -1 if nowhere."""
        page, place = self.page, at
        while not self.blind:
            edge = EDGE.search(page, place)
            if not edge:
                break
            if edge.group() == ">":
                return edge.end()
            place = page.find(edge.group(), edge.end()) + 1
            if not place:
                break
        self.blind = True
        return page.find(">", at) + 1 or -1

    def tokens(self) -> Iterator[tuple[str, bool, str, str]]:
        """(name, whether it closes, attributes, text): tags by their names in lower case, text without one."""
        page, at, end = self.page, 0, len(self.page)
        last = page.rfind(">")
        while at < end:
            mark = page.find("<", at)
            if mark < 0 or mark > last and not page.startswith("<!--", mark):
                yield "", False, "", page[at:]
                return
            if mark > at:
                yield "", False, "", page[at:mark]
            at = mark
            tag = TAG.match(page, at)
            if tag:
                close = self._end(tag.end())
                if close < 0:
                    yield "", False, "", page[at:]
                    return
                closing = page[at + 1] == "/"
                name, attributes, at = tag.group()[1 + closing :].lower(), page[tag.end() : close - 1], close
                if name in UNREAD and not closing and not attributes.rstrip().endswith("/"):
                    at = self._after(name, at)
                elif name not in UNREAD:
                    yield name, closing, attributes, ""
                continue
            for opening, ending in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
                if page.startswith(opening, at):
                    close = page.find(ending, at + len(opening))
                    if opening == "<![CDATA[":
                        yield "", False, "", page[at + 9 : close if close >= 0 else end].replace("&", "&amp;")
                    at = close + len(ending) if close >= 0 else end
                    break
            else:
                yield "", False, "", "<"
                at += 1

    def _after(self, name: str, at: int) -> int:
        """Where reading goes on after an element whose content is not read."""
        if name not in self.absent:
            close = re.compile(rf"</{name}\s*>", re.I).search(self.page, at)
            if close:
                return close.end()
            self.absent.add(name)
        return len(self.page) if name in ("script", "style", "textarea", "title") else at


def _plain(text: str) -> str:
    """``text`` with its character references decoded; numbers past any character are the replacement sign."""
    return html.unescape(LONG_REFERENCE.sub("\ufffd", text) if "&#" in text else text) if "&" in text else text


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open element, in furniture, in article
    places: dict[str, list[int]] = {}  # where on the stack a name is open
    held: list[int] = []  # where on the stack what holds the article is open
    texts: list[str] = []
    link_texts: list[str] = []
    in_link, breaks = False, 0

    def flush() -> None:
        nonlocal breaks
        text = " ".join("".join(texts).split())
        if text:
            n, linked = len(text.split()), len(" ".join(link_texts).split())
            name, furniture, article = stack[-1] if stack else ("", False, False)
            out.append(Block(text, n, min(1.0, linked / n), furniture, article, name in HEADING))
        texts.clear()
        link_texts.clear()
        breaks = 0

    def pop() -> None:
        name = stack.pop()[0]
        places[name].pop()
        if name in STRUCTURE:
            held.pop()

    for name, closing, attributes, text in Markup(page).tokens():
        if not name:
            plain = _plain(text)
            texts.append(plain)
            if in_link:
                link_texts.append(plain)
            if not plain.isspace():
                breaks = 0
            continue
        if name == "br":
            texts.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if name == "a":
            in_link = not closing
        block = name in BLOCK
        if block:
            flush()
            in_link = False
        if closing:  # a stray end tag does not close what holds the article
            if places.get(name) and (name in ("html", "body", "main") or not held or places[name][-1] >= held[-1]):
                for _ in range(len(stack) - places[name][-1]):
                    pop()
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in SOLE and stack and stack[-1][0] == name:
            pop()
        furniture, article = _marks(attributes) if attributes else (False, False)
        if name in ("body", "html"):
            furniture = False
        _, in_furniture, in_article = stack[-1] if stack else ("", False, False)
        in_article |= article or name in ARTICLE
        furniture |= name in FURNITURE or name == "header" and not in_article
        if block or furniture or article:
            places.setdefault(name, []).append(len(stack))
            if name in STRUCTURE:
                held.append(len(stack))
            stack.append((name, in_furniture or furniture, in_article))
    flush()
    return out


#: The labelled table the tree is grown from, a line a block: in furniture, place (1 in the article, 0 where
#: the page has none, -1 outside it), heading, words, link density, words and link density of the block
#: before and of the block after; then 1 for main text.
LABELLED = """
1 0 0  1 1.0  0 0.0  1 1.0  0
1 0 0  2 1.0  1 1.0  2 1.0  0
1 0 0  9 0.0  1 1.0  14 0.0  0
1 0 0  40 0.0  30 0.0  25 0.0  0
1 0 0  120 0.0  90 0.0  80 0.0  0
1 0 1  4 0.0  30 0.0  50 0.0  0
1 0 0  15 0.1  70 0.0  0 0.0  0
1 0 0  300 0.0  200 0.0  100 0.0  0
1 -1 0  1 1.0  1 1.0  1 1.0  0
1 -1 0  9 0.0  1 1.0  14 0.0  0
1 -1 0  40 0.0  30 0.0  25 0.0  0
1 -1 0  120 0.0  90 0.0  80 0.0  0
1 -1 1  4 0.0  30 0.0  50 0.0  0
1 -1 0  15 0.1  70 0.0  0 0.0  0
1 -1 0  300 0.0  200 0.0  100 0.0  0
1 1 0  1 1.0  1 1.0  1 1.0  0
1 1 0  9 0.0  60 0.0  80 0.0  0
1 1 0  40 0.0  30 0.0  25 0.0  0
1 1 0  60 0.0  80 0.0  90 0.0  0
1 1 1  4 0.0  30 0.0  50 0.0  0
1 1 0  15 0.1  70 0.0  0 0.0  0
1 1 0  170 0.0  3 0.0  4 0.0  0
1 1 0  300 0.0  200 0.0  100 0.0  0
1 1 0  20 0.0  10 0.0  12 0.0  0
0 1 0  1 0.0  80 0.0  120 0.0  1
0 1 0  2 0.0  1 0.0  1 0.0  1
0 1 0  2 0.0  9 0.0  0 0.0  1
0 1 0  9 0.0  12 0.0  9 0.0  1
0 1 1  8 0.0  1 1.0  9 0.0  1
0 1 1  5 0.0  40 0.0  60 0.0  1
0 1 1  3 0.0  9 0.0  0 0.0  1
0 1 0  35 0.0  8 0.0  60 0.0  1
0 1 0  60 0.0  30 0.0  7 0.0  1
0 1 0  250 0.0  35 0.0  3 0.0  1
0 1 0  900 0.0  1 0.0  0 0.0  1
0 1 0  45 0.2  60 0.0  70 0.0  1
0 1 0  20 0.4  60 0.0  70 0.0  1
0 1 0  6 1.0  80 0.0  70 0.0  1
0 1 0  12 0.9  40 0.1  70 0.0  1
0 1 0  5 1.0  20 0.0  30 0.0  1
0 1 0  3 1.0  4 1.0  3 1.0  0
0 1 0  4 1.0  3 1.0  5 1.0  0
0 1 0  5 1.0  4 1.0  2 1.0  0
0 1 0  2 1.0  3 1.0  6 1.0  0
0 1 0  3 0.0  3 0.0  3 0.0  1
0 1 0  4 0.0  2 0.0  5 0.0  1
0 1 0  2 0.0  4 0.0  2 0.0  1
0 1 0  1 0.0  2 0.0  400 0.0  1
0 1 0  15 0.0  4 0.0  2 0.0  1
0 1 0  3 0.0  5 0.0  16 0.0  1
0 1 0  11 0.0  3 0.0  4 0.0  1
0 1 0  7 0.0  3 0.0  30 0.0  1
0 1 0  24 0.0  2 0.0  3 0.0  1
0 1 0  18 0.0  6 0.0  55 0.0  1
0 1 1  2 0.0  0 0.0  3 0.0  1
0 1 1  9 0.0  6 1.0  3 0.0  1
0 1 0  6 0.0  3 1.0  3 1.0  1
0 1 0  14 0.3  4 0.0  6 0.0  1
0 1 0  8 0.0  0 0.0  0 0.0  1
0 1 0  300 0.0  0 0.0  8 0.0  1
0 -1 0  5 0.0  3 0.0  4 0.0  0
0 -1 0  2 0.0  0 0.0  3 0.0  0
0 -1 0  400 0.0  9 0.0  0 0.0  0
0 -1 0  20 0.3  6 0.0  12 0.0  0
0 -1 1  3 0.0  0 0.0  4 1.0  0
0 -1 0  40 0.0  3 1.0  10 0.0  0
0 -1 0  9 0.0  3 1.0  8 0.0  0
0 -1 0  9 0.0  60 0.0  80 0.0  0
0 -1 0  150 0.0  60 0.0  10 0.0  0
0 -1 0  2 1.0  2 1.0  2 1.0  0
0 -1 0  3 0.0  0 0.0  90 0.0  0
0 -1 1  6 0.0  30 0.0  0 0.0  0
0 -1 1  6 0.0  3 1.0  50 0.0  0
0 -1 0  60 0.0  8 0.0  80 0.0  0
0 0 0  60 0.0  8 0.0  80 0.0  1
0 0 0  25 0.1  60 0.0  40 0.0  1
0 0 0  180 0.0  0 0.0  0 0.0  1
0 0 0  30 0.0  2 1.0  4 1.0  1
0 0 0  16 0.2  4 0.0  3 0.0  1
0 0 0  2 0.0  70 0.0  90 0.0  1
0 0 0  6 0.0  70 0.0  90 0.0  1
0 0 0  6 0.0  25 0.0  3 0.0  1
0 0 0  4 0.1  22 0.0  20 0.0  1
0 0 1  7 0.0  3 1.0  60 0.0  1
0 0 1  4 0.0  5 0.0  20 0.0  1
0 0 1  8 0.0  40 0.0  35 0.0  1
0 0 1  8 0.0  2 1.0  3 1.0  0
0 0 0  5 0.0  2 1.0  3 1.0  0
0 0 0  4 0.0  6 0.2  2 1.0  0
0 0 0  8 0.0  3 0.0  4 0.0  0
0 0 0  3 1.0  3 1.0  3 1.0  0
0 0 0  3 1.0  60 0.0  3 1.0  0
0 0 0  2 1.0  3 0.0  40 0.0  0
0 0 0  12 0.8  10 0.9  8 0.7  0
0 0 0  30 0.7  4 1.0  5 1.0  0
0 0 0  6 0.0  4 1.0  0 0.0  0
"""


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> dict | int:
    """A binary decision tree by Gini impurity; ties go to the first feature and the lowest cut."""
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] < cut
            score = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[left], y[~left]))
            if best is None or score < best[0] - 1e-12:
                best = (score, f, float(cut), left)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, cut, left = best
    return {"f": f, "cut": cut, "low": grow(x[left], y[left], depth - 1), "high": grow(x[~left], y[~left], depth - 1)}


def features(furniture: bool, place: int, heading: bool, words: int, links: float, before: int, links_before: float, after: int, links_after: float) -> tuple[float, ...]:
    """What the tree sees: neighbours by their link density and, together with the block, by how much of
    all their words are in links; word counts above 40 count as 40."""
    all_words = max(words + before + after, 1)
    around = (words * links + before * links_before + after * links_after) / all_words
    return (furniture, place, around, links, min(words, 40), heading, max(min(before, 40) * (1 - links_before), min(after, 40) * (1 - links_after)))


def trained_tree() -> dict | int:
    rows = [[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()]
    return grow(np.array([features(*r[:-1]) for r in rows]), np.array([r[-1] for r in rows]))


def classify(tree: dict | int, seen: tuple[float, ...]) -> int:
    while isinstance(tree, dict):
        tree = tree["low"] if seen[tree["f"]] < tree["cut"] else tree["high"]
    return tree


TREE = trained_tree()


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    has_article = any(b.article for b in found)
    sizes = [(0, 0.0), *[(b.words, b.links) for b in found], (0, 0.0)]
    kept = []
    for i, b in enumerate(found):
        place = 1 if b.article else -has_article
        if classify(TREE, features(b.furniture, place, b.heading, b.words, b.links, *sizes[i], *sizes[i + 2])):
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with text and n_chars; columns of those names are replaced."""

    def start() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def read(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [main_text(p) for p in column_values(batch, "html", 64)]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return read

    return added(pages, "text string, n_chars long", start)


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).drop("html")
