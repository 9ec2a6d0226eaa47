"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A classifier's cost for calling a block content or
boilerplate becomes its capacity to the source or the sink; neighbouring blocks and
blocks near each other in the DOM are tied by smoothness edges. The minimum cut is the
cheapest labelling, found by max-flow after the blocks whose own cost outweighs all
their edges are settled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.llm.common import map_arrow, slices

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no text of the page.
SILENT_TAGS = frozenset("script style template head title noscript iframe object svg annotation annotation-xml select option textarea button datalist canvas audio video".split())
# What a head may hold; any other start tag, or text of its own, ends a head left open.
HEAD_TAGS = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An open one of these ends where another begins.
IMPLIED_END = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
LIST_TAGS = frozenset("ul ol menu dl table".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promos promotion promoted banner sidebar sidebars rail widget "
    "widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login register search share sharing social related recommended recommendations comment comments commentlist disqus reply replies "
    "discussion respond pagination pager toolbar copyright legal skip hidden".split()
)
# Of these, the words that a section of an article may be about.
TOPIC_WORDS = frozenset("discussion legal register search notice notices copyright promotion consent".split())
MAIN_WORDS = frozenset("article articlebody content main post entry story body text".split())
# Evidence of the page's structure, in the classifier's units (ln odds).
ASIDE, MAIN, OUTSIDE, ARTICLE_HEADER, MAIN_WORD, PROSE = -12.0, 6.0, -6.0, -1.0, 2.0, 1.5
PROSE_TAGS = HEADINGS | frozenset("p pre blockquote td dd figcaption".split())
# Capacity of an edge between neighbours with the same parent; halved for each step more
# of distance in the DOM, and a tenth of it across the border of an aside or an article.
SMOOTH = 1.5
BORDER = 0.1
# Pages that the classifier is fitted on (a bounded sample by the hash of their ids).
FIT_PAGES = 400
# Weights before fitting, and those towards which it is held: constant, ln chars, link
# share, ends like a sentence, commas a word, list item, heading, capitals, digits.
PRIOR = (-1.5, 0.5, -4.0, 1.0, 1.0, -0.5, 0.5, -0.5, -0.5)


class Block:
    __slots__ = ("parts", "chars", "linked", "path", "aside", "main", "header", "word", "tag", "item")

    def __init__(self, path, state, tag, item):
        self.parts: list[str] = []
        self.chars = self.linked = 0
        self.path, self.tag, self.item = path, tag, item
        self.aside, self.main, self.header, self.word = state

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _words(value: str | None) -> set[str]:
    # navBar, nav-bar and nav_bar are the same words; has-sidebar says nothing of the element itself
    own = re.sub(r"(?<!\S)(?:has|with|without|no)[-_]\S+", " ", value or "")
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", own).lower()))


class _Reader(HTMLParser):
    """Blocks of a page in order, each with its place in the DOM and what its
    ancestors say of it: (aside, main, header of an article, main word)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int, tuple, bool]] = []  # tag, number, state, silent
        self.count = 0
        self.now: Block | None = None

    def _end_head(self, tag: str):
        """Ends an open head, and what is open in it, where the body must have begun. What a
        noscript or template of the head holds does not end it, nor do inline tags of a title."""
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == "head"), -1)
        if at < 0 or tag in HEAD_TAGS:
            return
        inside = self.open[at + 1 :]
        if tag != "body" and any(x[0] != "title" for x in inside):
            return
        if not inside or tag == "body" or tag in BLOCK_TAGS:
            del self.open[at:]
            self.now = None

    def handle_starttag(self, tag, attrs):
        self._end_head(tag)
        if tag in VOID_TAGS:
            if tag in BLOCK_TAGS:
                self.now = None
            elif tag == "br" and self.now:
                self.now.parts.append(" ")
            return
        if tag in IMPLIED_END:
            self._imply(tag)
        aside, main, header, word = self.open[-1][2] if self.open else (False, False, False, False)
        silent = (self.open[-1][3] if self.open else False) or tag in SILENT_TAGS
        a = dict(attrs)
        words = _words(a.get("class")) | _words(a.get("id"))
        role = (a.get("role") or "").lower()
        inner = main  # inside a main element or an article
        if tag in MAIN_TAGS or role in ("main", "article") or a.get("itemprop") == "articleBody":
            if aside == "form":  # a form around the whole page
                aside = False
            elif aside is not True and tag != "article":  # a layout named after its sidebar
                aside = False
            main = True
        if tag == "header":
            if main:
                header = True
            else:
                aside = True
        elif tag == "form" and aside is not True:
            aside = aside or "form"
        elif tag in ASIDE_TAGS or role in ASIDE_ROLES or "hidden" in a or a.get("aria-hidden") == "true":
            aside = True
        named = words & ASIDE_WORDS
        if tag in ("html", "body", "main") or role == "main" or (tag == "section" and inner and len(named) == 1 and named <= TOPIC_WORDS):
            named = set()
        if named and aside is not True:  # the outermost element outside an article, by its number
            aside = "word" if main else aside if type(aside) is int else -(self.count + 1)
        elif words & MAIN_WORDS:
            word = True
            if aside == "form":
                aside = False
        self.count += 1
        self.open.append((tag, self.count, (aside, main, header, word), silent))
        if tag in BLOCK_TAGS:
            self.now = None

    def _imply(self, tag):
        ends = IMPLIED_END[tag]
        for k in range(len(self.open) - 1, -1, -1):
            own = self.open[k][0]
            if own in ends:
                del self.open[k:]
                self.now = None
                return
            if own in BLOCK_TAGS and (tag == "p" or own in LIST_TAGS):
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.now = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in BLOCK_TAGS and tag not in BLOCK_TAGS:
                return  # a stray end of an inline tag

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._end_head("")
        if self.open and self.open[-1][3]:
            return
        if self.now is None:
            if not data.strip():
                return
            holders = [x for x in self.open if x[0] in BLOCK_TAGS]
            state = self.open[-1][2] if self.open else (False, False, False, False)
            self.now = Block(tuple(x[1] for x in holders), state, holders[-1][0] if holders else "", any(x[0] in ("li", "dt", "dd") for x in holders))
            self.blocks.append(self.now)
        self.now.parts.append(data)
        n = len(data.strip())
        self.now.chars += n
        if any(x[0] == "a" for x in self.open):
            self.now.linked += n


def read_blocks(html: str | None) -> list[Block]:
    """The page's blocks. A tag that the end of the page cuts off is no text."""
    page = html or ""
    cut = page.rfind("<")
    if cut > page.rfind(">") and re.match(r"<[a-zA-Z/!?]", page[cut : cut + 2]):
        page = page[:cut]
    reader = _Reader()
    reader.feed(page)
    reader.close()
    blocks = [b for b in reader.blocks if b.text()]
    # Articles in an element that words call an aside are the page's own if they are the most
    # text: more than in other such elements and than what is in none.
    size, plain = Counter(), [b for b in blocks if not b.aside]
    for b in blocks:
        if b.main and type(b.aside) is int:
            size[b.aside] += b.chars
    own = max(size, key=size.get, default=None)
    if size[own] <= sum(b.chars for b in [b for b in plain if b.main] or plain):
        own = None
    for b in blocks:
        b.aside = bool(b.aside) and not (b.main and own is not None and b.aside == own)
    return blocks


def features(block: Block) -> list[float]:
    text = block.text()
    n, words = len(text), text.count(" ") + 1
    return [
        1.0,
        math.log(n),
        min(1.0, block.linked / max(1, block.chars)),
        float(text[-1] in ".!?…:;\"'”»"),
        min(1.0, text.count(",") / words),
        float(block.item),
        float(block.tag in HEADINGS),
        sum(c.isupper() for c in text) / n,
        sum(c.isdigit() for c in text) / n,
    ]


def fit_classifier(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic regression by gradient descent, classes weighted equally, held near
    ``PRIOR`` (which it returns where either class is missing)."""
    w = np.array(PRIOR)
    if not len(y) or y.min() == y.max():
        return w
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    scale = np.maximum(np.abs(x).max(axis=0), 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (((p - y) * weight) @ x + 0.01 * (w - PRIOR)) / scale
    return w


def structure(block: Block, has_main: bool) -> float:
    """ln odds that the block's ancestors give it."""
    score = ASIDE if block.aside else 0.0
    if block.main:
        score += MAIN
    elif has_main:
        score += OUTSIDE
    if block.header and block.tag not in HEADINGS:
        score += ARTICLE_HEADER
    return score + (MAIN_WORD if block.word else 0.0) + (PROSE if block.tag in PROSE_TAGS else 0.0)


def edges(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness: each block to the next, and to the next that has its parent, by
    their distance in the DOM."""
    tied: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        near = {i - 1} if i else set()
        parent = b.path[-2] if len(b.path) > 1 else 0
        if parent in last:
            near.add(last[parent])
        last[parent] = i
        for j in near:
            a = blocks[j].path
            shared = 0
            while shared < min(len(a), len(b.path)) and a[shared] == b.path[shared]:
                shared += 1
            far = len(a) + len(b.path) - 2 * shared
            border = bool(blocks[j].aside) != bool(b.aside) or blocks[j].main != b.main
            tied[j, i] = SMOOTH * 2.0 ** -max(0, far - 2) * (BORDER if border else 1.0)
    return tied


def minimum_cut(odds: list[float], tied: dict[tuple[int, int], float]) -> list[bool]:
    """True for the source side (content): the labelling of least cost, where calling
    block i content costs max(0, -odds), boilerplate max(0, odds), and an edge whose
    ends differ its capacity. A block at 0 with no pull is boilerplate."""
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in tied.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    pull, label = list(odds), [None] * n
    queue = deque(range(n))
    while queue:  # a block that outweighs all its edges keeps its own label in any minimum cut
        i = queue.popleft()
        if label[i] is None and abs(pull[i]) > sum(near[i].values()):
            label[i] = pull[i] > 0
            for j, c in near[i].items():
                pull[j] += c if label[i] else -c
                near[j].pop(i)
                queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left}
        room[source], room[sink] = {}, {}
        for i in left:
            room[source][i], room[i][source] = max(0.0, pull[i]), 0.0
            room[i][sink], room[sink][i] = max(0.0, -pull[i]), 0.0
        while True:  # shortest augmenting paths
            came, todo = {source: source}, deque([source])
            while todo and sink not in came:
                u = todo.popleft()
                for v, c in room[u].items():
                    if c > 1e-12 and v not in came:
                        came[v] = u
                        todo.append(v)
            if sink not in came:
                break
            path, v = [], sink
            while v != source:
                path.append((came[v], v))
                v = came[v]
            least = min(room[u][v] for u, v in path)
            for u, v in path:
                room[u][v] -= least
                room[v][u] += least
        for i in left:
            label[i] = i in came
    return [bool(x) for x in label]


def main_text(html: str | None, weights) -> str:
    """The content blocks of a page, joined by one line feed; empty if there are none."""
    blocks = read_blocks(html)
    has_main = any(b.main and not b.aside for b in blocks)
    w = [float(x) for x in weights]
    odds = [sum(a * b for a, b in zip(w, features(b), strict=True)) + structure(b, has_main) for b in blocks]
    return "\n".join(b.text() for b, keep in zip(blocks, minimum_cut(odds, edges(blocks)), strict=True) if keep)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = FIT_PAGES) -> np.ndarray:
    """The block classifier, from at most ``most`` pages: blocks in an article against
    blocks in menus, footers and other asides. Without such pages: the prior weights."""
    rows = pages.select(qcol(id_col).alias("page_id"), qcol(html_col).alias("html")).filter("html is not null").withColumn("k", F.xxhash64("page_id", "html"))
    # the sample is drawn from hashes; only its pages are then read whole, once each
    drawn = F.broadcast(rows.select("k").distinct().orderBy("k").limit(most))
    sample = rows.join(drawn, "k", "left_semi").dropDuplicates(["k"]).select("page_id", "html")
    k = len(PRIOR)

    def run(batches):
        for b in slices(batches, "html"):
            rows = [[float(bool(x.main and not x.aside)), *features(x)] for html in b.column(1).to_pylist() for x in read_blocks(html) if x.main or x.aside]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["row"])

    rows = [r["row"] for r in map_arrow(sample, run, "row array<double>").collect()]
    data = np.array(sorted(rows), float).reshape(-1, k + 1)
    return fit_classifier(data[:, 1:], data[:, 0])


def extract(pages: DataFrame, weights, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the main text) and ``n_chars`` (its code points).

    A null or empty page has the empty text. Pages are independent: repeated rows give
    equal results, an empty table an empty one; columns ``text`` and ``n_chars`` of the
    input are replaced, all others pass through. Nothing of a long page is dropped.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    at, fixed = keep.index(html_col), [float(x) for x in weights]
    d = pages.select(*map(qcol, keep))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema), "text string"])

    def run(batches):
        for b in slices(batches, html_col):
            out = [main_text(h, fixed) for h in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*keep, "text"])

    return map_arrow(d, run, schema).withColumn("n_chars", F.char_length("text").cast("bigint"))


def op10_html(pages: DataFrame) -> DataFrame:
    """The main text of every page."""
    own = pages.select("page_id", "url", "html")
    return extract(own, fit(own)).select("page_id", "url", "text", "n_chars")
