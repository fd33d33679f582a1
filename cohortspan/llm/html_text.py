"""Main text of web pages: the best-scoring contiguous region of words and tags.

A page is read once as a sequence of blocks of words and the tags between them. Every word scores what its place says
(positive in prose), every tag costs something (more where it ends an article than between paragraphs), and one linear
scan finds the contiguous region with the highest sum. Elements whose tag or names mark them as no part of an article
(menus, page headers, footers, sidebars, notices, adverts, forms, reader comments) add no words wherever they stand;
inside the region they are stepped over at the cost of one tag.

All weights come from labelled pages: a set of labelled layouts kept here (``LAYOUTS``) and a sample of the table's own
pages that mark their article themselves. A name (class, id, role) weighs the log ratio of blocks inside
and outside articles that it stands around; a logistic regression adds the link share, length, ending and tag of a block; a
tag costs the log of how often it stands outside articles against inside.

Blocks end at block tags; inside, white space becomes one space and ``br`` counts as white space. Character references
are decoded after tags are found, so escaped markup stays text. Nothing else is dropped: the whole page is read.

Edge cases: a null or empty page, or one without an article, gives an empty text. Text without any tag is an article if its
words score so. Tags left open, closed twice or cut off at the end of the page are read as browsers do: block tags end
open paragraphs, unknown end tags are ignored, and script, style or comment without an end take the rest of the page.
Of several best regions the first is taken. Rows are judged on their own: repeated rows and rows without an id come out
as they are, an empty table as an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import html
import itertools
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.llm.common import tidy

# Pages that mark their article themselves and are learnt from: at most so many, each of at most so many characters.
SAMPLE_PAGES = 200
SAMPLE_CHARS = 100_000

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_RAW = "script|style|textarea|iframe|title"
_TAG = re.compile(
    rf"""<!--.*?(?:--!?>|\Z)
    |<(?P<raw>{_RAW})\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attributes>{_ATTRIBUTES})>
    |</?[a-z][^>]*(?:>|\Z)
    |<[!?/][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
# A start tag ends these if they are open, looking no further up than its scope.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
IN_HEAD = frozenset("base link meta".split())
# Elements that are no part of an article whatever their names.
NEVER = frozenset(
    "head nav menu footer aside button select option optgroup dialog map noscript template svg object canvas audio video".split()
)
MAIN = frozenset(("article", "main"))
# Tags that say something about the words in them; others (div, span, p, ...) are told by names and blocks only.
TELLING = frozenset("header table ul ol dl blockquote pre figure figcaption address".split())
TELLING_BLOCKS = HEADINGS | frozenset("p li pre td body blockquote figcaption".split())
# First parts of names that state what a wrapper has, not what it is.
STATES = frozenset("has with without no is show hide js col".split())
# An element whose names weigh less than this is left out; below the second even if it holds an article element. A form
# whose content has a name above the third is a page, not a form.
REJECTED, SURELY_REJECTED, MAINLIKE = -1.0, -2.0, 1.5
# Names weigh, words score and tags cost within these bounds.
NAME_WEIGHTS = (-3.0, 3.0)
WORD_SCORES = (-2.0, 2.0)
TAG_COSTS = (0.02, 1.5)
# Marks tags inside an article or main element, which cost something else than outside.
INSIDE = "@"


@dataclass
class Element:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    hidden: bool = False
    in_main: bool = False


@dataclass
class Block:
    """Words between two block tags: text, element, link words, and the tags since the block before."""

    element: int
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)


def name_parts(value: str) -> Iterator[str]:
    """Parts of class names and ids, in lower case and singular: 'siteFooter' gives 'site', 'footer', 'sitefooter'."""
    for name in value.split():
        parts = [p.lower() for p in _NAME_PART.findall(name)]
        if not parts or parts[0] in STATES:
            continue
        if len(parts) > 1:
            parts.append("".join(parts))
        for part in parts:
            yield part[:-1] if len(part) > 2 and part.endswith("s") else part


_known_attributes: dict[str, tuple[tuple[str, ...], bool]] = {}


def attributes(text: str) -> tuple[tuple[str, ...], bool]:
    """What the attributes of an element say: its names, and whether it is hidden."""
    found = _known_attributes.get(text)
    if found is None:
        names: list[str] = []
        hidden = False
        for key, value in _ATTRIBUTE.findall(text):
            key, value = key.lower(), html.unescape(value.strip("\"'"))
            if key in ("class", "id"):
                names.extend(name_parts(value))
            elif key in ("role", "itemprop"):
                names.append(f"{key}={value.strip().lower()}")
            elif key == "hidden" or key == "style" and _HIDDEN.search(value):
                hidden = True
        if len(_known_attributes) >= 20_000:
            _known_attributes.clear()
        found = _known_attributes[text] = (tuple(dict.fromkeys(names)), hidden)
    return found


class Page:
    """Elements and blocks of a page, in page order."""

    def __init__(self, source: str):
        self.elements = [Element("", -1)]
        self.blocks: list[Block] = []
        self._open = [0]
        self._links = 0
        self._block = Block(0)
        at = 0
        for tag in _TAG.finditer(source):
            if tag.start() > at:
                self._text(source[at : tag.start()])
            at = tag.end()
            name = tag["name"]
            if name is None:
                continue
            name = name.lower()
            if tag["end"]:
                self._end(name)
            else:
                self._start(name, tag["attributes"])
        if at < len(source):
            self._text(source[at:])
        self._next(None)

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self._block.pieces.append((self._open[-1], text, self._links > 0))

    def _next(self, tag: str | None) -> None:
        """A block tag: the words so far are a block, if there are any."""
        block = self._block
        if any(text and not text.isspace() for _, text, _ in block.pieces):
            self.blocks.append(block)
            self._block = Block(self._open[-1])
        else:
            block.pieces.clear()
            block.element = self._open[-1]
        if tag is not None:
            self._tag(tag)

    def _tag(self, tag: str) -> None:
        here = self.elements[self._open[-1]]
        self._block.tags.append(tag + INSIDE * (here.in_main or here.tag in MAIN))

    def _cut(self, place: int) -> None:
        for e in self._open[place:]:
            self._links -= self.elements[e].tag == "a"
        del self._open[place:]

    def _end_open(self, tags: set[str], scope: set[str] | None) -> None:
        for place in range(len(self._open) - 1, 0, -1):
            tag = self.elements[self._open[place]].tag
            if tag in tags:
                self._cut(place)
                return
            if tag in scope if scope is not None else tag in BLOCKS:
                return

    def _start(self, tag: str, text: str) -> None:
        if tag == "br":
            self._block.pieces.append((self._open[-1], " ", False))
            self._tag(tag)
            return
        if tag in VOID and tag != "hr" or tag == "svg" and text.endswith("/"):
            return
        if self.elements[self._open[-1]].tag == "head" and tag not in IN_HEAD:
            self._cut(len(self._open) - 1)
        is_block = tag in BLOCKS
        if is_block:
            self._end_open({"p"}, None)
            if tag in ENDS:
                self._end_open(*ENDS[tag])
            elif tag in HEADINGS:
                self._end_open(set(HEADINGS), None)
            self._next(tag)
        else:
            self._tag(tag)
        if tag in VOID:
            return
        parent = self._open[-1]
        names, hidden = attributes(text) if "=" in text or "hidden" in text.lower() else ((), False)
        above = self.elements[parent]
        self.elements.append(Element(tag, parent, names, hidden, above.in_main or above.tag in MAIN))
        self._open.append(len(self.elements) - 1)
        self._links += tag == "a"
        if is_block:
            self._block.element = self._open[-1]

    def _end(self, tag: str) -> None:
        if tag in VOID:
            return
        is_block = tag in BLOCKS
        for place in range(len(self._open) - 1, 0, -1):
            found = self.elements[self._open[place]].tag
            if found == tag:
                if is_block:
                    self._next("/" + tag)
                else:
                    self._tag("/" + tag)
                self._cut(place)
                if is_block:
                    self._block.element = self._open[-1]
                return
            if not is_block and found in BLOCKS:
                return


def named(element: Element) -> list[str]:
    return [f"name {n}" for n in element.names]


def about(page: Page, block: Block, words: int, linked: int, text: str, marked: bool) -> list[str]:
    """What is known about the words of a block from the block itself."""
    element = page.elements[block.element]
    share = "none" if not linked else "some" if 2 * linked < words else "most"
    length = "1" if words < 2 else "2" if words < 5 else "5" if words < 15 else "15"
    if element.in_main or element.tag in MAIN:
        place = "inside"
    else:
        place = "outside" if marked else "unmarked"
    return [
        f"link {share}",
        f"words {length}",
        f"block {element.tag if element.tag in TELLING_BLOCKS else 'other'}",
        f"ends {text[-1:] in '.!?:…。'}",
        f"main {place}",
        *sorted({f"in {tag}" for tag in above(page, block.element) if tag in TELLING}),
    ]


def above(page: Page, element: int) -> Iterator[str]:
    """Tags of an element and of those that hold it."""
    while element > 0:
        yield page.elements[element].tag
        element = page.elements[element].parent


@dataclass(frozen=True)
class Weights:
    """Weights of the names around a word and of what its block says, and the cost of every tag."""

    names: dict[str, float]
    known: dict[str, float]
    costs: dict[str, float]

    def of_name(self, name: str) -> float:
        """The weight of a name; of one not seen, that of the longest known name that it begins or ends with."""
        found = self.names.get(name)
        if found is None:
            bare = name.removeprefix("name ")
            parts = [bare[:k] for k in range(4, len(bare))] + [bare[-k:] for k in range(4, len(bare))]
            parts = [p for p in parts if f"name {p}" in self.names]
            found = self.names[f"name {max(parts, key=len)}"] if parts else 0.0
            if len(self.names) < 100_000:
                self.names[name] = found
        return found

    def cost(self, tag: str) -> float:
        found = self.costs.get(tag)
        return self.costs[INSIDE * tag.endswith(INSIDE)] if found is None else found


def own_weights(page: Page, weights: Weights) -> list[float]:
    return [sum(map(weights.of_name, named(e))) for e in page.elements]


def left_out(page: Page, own: list[float]) -> list[bool]:
    """For every element, whether its words are no part of an article wherever it stands."""
    elements = page.elements
    holds = {kind: [False] * len(elements) for kind in ("main", "article", "name")}
    for k, e in enumerate(elements):
        kinds = []
        if e.tag == "main" or "role=main" in e.names or "itemprop=articlebody" in e.names:
            kinds.append("main")
        if e.tag == "article" and own[k] >= REJECTED:
            kinds.append("article")
        if own[k] > MAINLIKE:
            kinds.append("name")
        for kind in kinds:
            above = e.parent
            while above > 0 and not holds[kind][above]:
                holds[kind][above] = True
                above = elements[above].parent
    out = [False] * len(elements)
    for k, e in enumerate(elements):
        if k and out[e.parent]:
            out[k] = True
        elif e.tag in NEVER or e.hidden or (e.tag == "header" and not e.in_main):
            out[k] = True
        elif e.tag == "form":
            out[k] = not any(held[k] for held in holds.values())
        elif e.tag not in ("", "html", "body", "main") and not holds["main"][k]:
            out[k] = own[k] < (SURELY_REJECTED if holds["article"][k] else REJECTED)
    return out


def contents(page: Page, out: list[bool]) -> Iterator[tuple[Block, str, int, int]]:
    """Blocks with their text without what is left out, number of words, and of words in links."""
    for block in page.blocks:
        there = [(text, link) for e, text, link in block.pieces if not out[e]]
        words = "".join(text for text, _ in there).split()
        linked = sum(len(text.split()) for text, link in there if link)
        yield block, " ".join(words), len(words), linked


def best_region(scores: Iterable[tuple[float, float]]) -> tuple[int, int]:
    """First block and the one after the last of the region with the highest sum.

    ``scores`` has for each block the cost of the tags before it and the sum of its words. A linear scan keeps the best
    sum of a region that ends here; a region starts and ends with a block, so tags outside it cost nothing.
    """
    best, region, running, start = 0.0, (0, 0), 0.0, 0
    for k, (cost, words) in enumerate(scores):
        running -= cost
        if running <= 0:
            running, start = 0.0, k
        running += words
        if running > best:
            best, region = running, (start, k + 1)
    return region


def main_text(source: str | None, weights: Weights) -> str:
    """Text of the article in a page, empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    own = own_weights(page, weights)
    out = left_out(page, own)
    total = own[:]
    for k, e in enumerate(page.elements):
        if k:
            total[k] += total[e.parent]
    marked = any(e.tag in MAIN and not out[k] for k, e in enumerate(page.elements))
    low, high = WORD_SCORES
    texts, scores, cost, step = [], [], 0.0, 0.0
    for block, text, words, linked in contents(page, out):
        if not text:
            # However much is left out in a row, it is one step.
            step = max([step, *map(weights.cost, block.tags)])
            continue
        cost = step + sum(map(weights.cost, block.tags))
        step = 0.0
        facts = about(page, block, words, linked, text, marked)
        names = min(max(total[block.element], low), high)
        score = weights.known[""] + names + sum(weights.known.get(f, 0.0) for f in facts)
        texts.append(text)
        scores.append((cost, words * min(max(score, low), high)))
    first, last = best_region(scores)
    return " ".join(texts[first:last])


# Labelled layouts: +n stands for n words of the article, -n for n words that are no part of it.
LAYOUTS = """
<body><div id="header"><a>-2</a></div><div id="menu"><a>-1</a> <a>-1</a> <a>-2</a></div><div id="content"><h1>+6</h1><p>+40</p><p>+25</p><p>+3</p></div><div id="sidebar"><h3>-2</h3><p>-12</p></div><div id="footer">-9</div></body>
<body><div class="navbar topbar"><a>-1</a> <a>-1</a></div><div class="container"><div class="post"><h2>+7</h2><div class="entry-content"><p>+30</p><ul><li>+5</li><li>+8</li></ul><p>+18</p></div></div><div class="comments" id="comments"><h3>-2</h3><div class="comment"><p class="comment-author">-2</p><p class="comment-text">-25</p></div><div class="comment reply"><p>-31</p></div></div></div><div class="copyright">-6</div></body>
<body><div class="cookie-notice banner" role="alert"><p>-18</p></div><div class="masthead site-header">-4</div><main><h1>+5</h1><p>+22</p><div class="ad">-9</div><p>+34</p><blockquote><p>+12</p></blockquote></main><div class="related"><h4>-2</h4><a>-5</a><a>-6</a></div></body>
<body><div class="breadcrumbs"><a>-1</a> <a>-2</a></div><article class="story"><h1>+8</h1><p class="byline">+4</p><p>+45</p><div class="share social">-3</div><p>+28</p><div class="newsletter signup"><p>-11</p></div><p>+7</p></article><div class="popular trending"><ol><li><a>-6</a></li><li><a>-7</a></li></ol></div></body>
<body><table><tr><td class="leftnav"><a>-1</a><br><a>-2</a></td><td class="maintext"><p>+50</p><p>+21</p></td><td class="advert advertisement">-8</td></tr></table></body>
<body>+60</body>
<body><h1>+5</h1><p>+20</p><p>+2</p><p>+30</p></body>
<body><h1>+5</h1>+44<br>+23<br>+9</body>
<body><center><font>+35</font></center><hr><p>+27</p></body>
<body><pre>+55</pre></body>
<div><p>+38</p><p>+12</p></div>
<body><div class="wrapper"><div class="x"><a>-1</a><a>-1</a><a>-2</a><a>-1</a></div><div class="y"><p>+33</p><p>+19 <a>+3</a> +6</p><p>+41</p></div><div class="z"><a>-3</a><a>-4</a><a>-2</a></div></div></body>
<body><ul><li><a>-1</a></li><li><a>-2</a></li><li><a>-1</a></li></ul><div><h2>+6</h2><p>+29</p><p>+4</p><h3>+3</h3><p>+36</p></div><ul><li><a>-4</a></li><li><a>-3</a></li></ul></body>
<body><div role="navigation"><a>-1</a><a>-1</a></div><div role="banner">-5</div><div role="main"><h1>+4</h1><p>+31</p><p>+17</p></div><div role="complementary"><p>-20</p></div><div role="search">-2</div><div role="contentinfo">-8</div><div role="dialog"><p>-14</p></div></body>
<body><div itemprop="articleBody"><p>+26</p><p>+39</p></div><div class="author-bio"><p>-15</p></div><div class="tags"><a>-1</a><a>-1</a></div></body>
<body><div class="alert message warning">-13</div><div class="article-body"><p>+24</p><p>+32</p></div><div class="promo sponsored"><p>-16</p></div><div class="disclaimer legal"><p>-22</p></div></body>
<body><div class="popup modal overlay"><p>-12</p></div><div class="post-content text"><p>+37</p><p>+15</p></div><div id="disqus_thread"><p>-19</p></div><div id="respond"><p>-8</p></div></body>
<body><div class="consent gdpr privacy"><p>-21</p></div><div id="main"><div class="title">+6</div><div class="body"><p>+42</p><p>+11</p></div></div><div class="widget"><p>-10</p></div><div class="pagination pager"><a>-1</a><a>-1</a></div></body>
<body><div class="skip-link"><a>-3</a></div><div class="toolbar">-2</div><section class="content"><p>+28</p><figure><figcaption>+9</figcaption></figure><p>+33</p></section><section class="discussion feedback"><p>-27</p><p>-14</p></section><section class="recommended"><p>-9</p></section></body>
<body><div class="subscribe paywall"><p>-13</p></div><div class="story-body"><p>+23</p><table><tr><td>+3</td><td>+2</td></tr></table><p>+29</p></div><div class="outbrain taboola sponsor"><a>-8</a></div><div class="login">-4</div></body>
<body><div class="announcement notification info"><p>-15</p></div><article><header><h1>+7</h1></header><section><p>+31</p></section><section><p>+26</p></section></article><section class="reviews responses"><article class="comment review"><p>-24</p></article><article class="comment response"><p>-33</p></article></section></body>
<body><div class="kopfzeile">-3</div><div class="menü navigation"><a>-1</a><a>-1</a></div><div class="inhalt artikel"><h1>+5</h1><p>+27</p><p>+35</p></div><div class="werbung anzeige">-11</div><div class="kommentare kommentar"><p>-22</p></div><div class="hinweis"><p>-12</p></div><div class="seitenleiste"><p>-9</p></div><div class="fußzeile impressum">-7</div></body>
<body><div class="entete">-3</div><div class="contenu texte"><h1>+5</h1><p>+28</p><p>+34</p></div><div class="publicite pub">-11</div><div class="commentaires commentaire"><p>-22</p></div><div class="avis"><p>-12</p></div><div class="pied">-7</div></body>
<body><div class="cabecera">-3</div><div class="contenido texto articulo"><h1>+5</h1><p>+28</p><p>+34</p></div><div class="publicidad anuncio">-11</div><div class="comentarios comentario"><p>-22</p></div><div class="aviso"><p>-12</p></div><div class="lateral">-9</div><div class="pie">-7</div></body>
<body><div class="site-nav mainnav"><a>-1</a><a>-1</a></div><div class="hero"><h1>+6</h1></div><div class="page"><div class="row"><div class="column primary"><p>+30</p><p>+22</p></div><div class="column secondary rail aside"><p>-11</p></div></div></div><div class="bottom footer-links"><a>-2</a><a>-1</a></div></body>
<body><div class="main-menu"><a>-1</a><a>-1</a></div><div class="page-header">-4</div><div class="page-content"><h1 class="post-title">+6</h1><p>+33</p><div class="content-ad text-ad">-7</div><p>+24</p><div class="post-share">-3</div></div><div class="article-comments post-comments"><p>-26</p></div><div class="page-footer main-footer">-9</div></body>
<body><div class="main-nav content-nav"><a>-2</a><a>-1</a></div><div class="site-main"><div class="article-header"><h1 class="article-title headline">+7</h1></div><div class="article-text article-content"><p>+29</p><p>+38</p></div><div class="article-footer entry-footer post-footer"><a>-2</a></div></div><div class="main-sidebar content-sidebar sidebar-right"><p>-13</p></div><div class="site-footer">-6</div></body>
<body><div class="box notice-box"><p>-10</p></div><div class="story-text"><p>+21</p><p>+30</p></div><div class="box ad-box ad-container ads adsense">-8</div><div class="comment-list comment-section user-comments"><p>-18</p><p>-20</p></div><div class="box footer-box">-5</div></body>
<body><div class="bar">-2</div><div class="lead">+9</div><div class="text">+48</div><div class="text">+3</div><div class="text">+29</div><div class="meta">-3</div></body>
<body><div><span>-1</span></div><div><span>+39</span><br><span>+12</span></div><div><span>+28</span></div><div><a>-2</a><a>-2</a></div></body>
<body><div>+34</div><div>+4</div><div>+26</div><div><a>-3</a></div><div><a>-2</a></div></body>
<body><div class="top bar x"><a>-1</a></div><div class="box section left"><h2>+4</h2><p>+31</p><ul class="list links"><li>+6</li><li>+5</li></ul><div class="info bottom z">+14</div><p class="tag user author">+5</p></div><div class="box section right secondary"><a>-4</a><a>-3</a></div></body>
<body><div class="y x top"><p>+26</p><p>+3</p></div><div class="z right box section"><p>+22</p><p class="list link">+6</p><div class="bar thread">+12</div></div></body>
<body><nav>-4</nav><article><h1>+3</h1><ul><li><a>+2</a></li><li><a>+4</a></li><li><a>+3</a></li></ul></article><footer>-5</footer></body>
<body><article><h2>+4</h2><p>+22</p><p>+1</p><p><a>+4</a></p><ul><li><a>+2</a></li><li><a>+2</a></li></ul></article><div class="side"><a>-3</a></div></body>
<body><main><h1>+3</h1><div>+24</div><div><a>+2</a> <a>+2</a></div><p>+2</p></main></body>
<body><p>-3</p><article><p>+25</p><p>+16</p><ul><li><a>+3</a></li><li><a>+2</a></li></ul></article><p>-6</p><div><p>-9</p></div></body>
<body><div class="top"><a>-2</a></div><main><p>+19</p><div class="toc"><a>-2</a><a>-3</a></div><h2>+3</h2><p>+40</p></main><div><p>-8</p></div></body>
"""


def words_for(count: int, rng: random.Random) -> str:
    """So many words; ten or more end in a full stop."""
    made = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(count)]
    return " ".join(made) + "." * (count >= 10)


@dataclass
class Lesson:
    """What labelled blocks tell: names and facts, label and weight of each, and tags inside and outside articles."""

    names: list[list[str]] = field(default_factory=list)
    facts: list[list[str]] = field(default_factory=list)
    labels: list[bool] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    inside: Counter = field(default_factory=Counter)
    outside: Counter = field(default_factory=Counter)

    def add(self, page: Page, labels: list[bool], hide_main: bool = False) -> None:
        """The blocks of a page with their labels; ``hide_main`` makes believe that the page does not mark its article."""
        path: list[list[str]] = []
        never: list[bool] = []
        for k, e in enumerate(page.elements):
            path.append(path[e.parent] + named(e) if k else [])
            never.append(k > 0 and (never[e.parent] or e.tag in NEVER or e.hidden))
        marked = any(e.tag in MAIN for e in page.elements)
        before = False
        for (block, text, words, linked), label in zip(contents(page, [False] * len(path)), labels, strict=True):
            # Tags between two blocks of the article stand inside it.
            tags = [t.removesuffix(INSIDE) for t in block.tags] if hide_main else block.tags
            (self.inside if before and label else self.outside).update(tags)
            before = label
            if never[block.element]:
                continue
            facts = about(page, block, words, linked, text, marked)
            if hide_main:
                facts = ["main unmarked" if f.startswith("main ") else f for f in facts]
            self.names.append(path[block.element])
            self.facts.append(facts)
            self.labels.append(label)
            self.weights.append(1.0 + np.log(words))


def regression(facts: list[list[str]], labels: np.ndarray, weights: np.ndarray, offset: np.ndarray, penalty: float) -> dict[str, float]:
    """Weight of every fact, and of none under the empty name: Newton's method with a penalty on all but the latter."""
    place = {f: k for k, f in enumerate(sorted({f for one in facts for f in one}))}
    x = np.zeros((len(facts), len(place) + 1))
    x[:, -1] = 1.0
    for k, one in enumerate(facts):
        for f in one:
            x[k, place[f]] += 1.0
    theta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta + offset, -30, 30)))
        gradient = x.T @ (weights * (p - labels)) + ridge * theta
        if np.abs(gradient).max() < 1e-9:
            break
        theta -= np.linalg.solve((x * (weights * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(ridge), gradient)
    return {f: float(theta[k]) for f, k in place.items()} | {"": float(theta[-1])}


def layouts() -> Iterator[tuple[Page, list[bool]]]:
    rng = random.Random(12)
    for line in LAYOUTS.strip().splitlines():
        signs = re.findall(r"[+-](?=\d)", line)
        page = Page(re.sub(r"[+-](\d+)", lambda m: f"\x01{words_for(int(m[1]), rng)}", line))
        labels, used = [], iter(signs)
        for block in page.blocks:
            own = [next(used) == "+" for _, text, _ in block.pieces for _ in range(text.count("\x01"))]
            block.pieces = [(e, text.replace("\x01", ""), link) for e, text, link in block.pieces]
            labels.append(own[0])
        yield page, labels


def marks_itself(page: Page) -> list[bool] | None:
    """Labels of a page with exactly one article element, else of one with exactly one main element."""
    for tag in ("article", "main"):
        if sum(e.tag == tag for e in page.elements) == 1:
            inside = [False] * len(page.elements)
            for k, e in enumerate(page.elements):
                inside[k] = k > 0 and (inside[e.parent] or e.tag == tag) and e.tag not in NEVER and e.tag != "form"
            return [inside[b.element] for b in page.blocks]
    return None


def fit(sources: Iterable[str], smoothing: float = 0.1, penalty: float = 0.5) -> Weights:
    """Weights from the labelled layouts and from those of ``sources`` that mark their article themselves.

    Names are weighed first, each alone: what they say must not depend on the blocks that they stand around.
    """
    kept, own = Lesson(), Lesson()
    for page, labels in layouts():
        kept.add(page, labels)
    for source in sources:
        page = Page(source)
        labels = marks_itself(page)
        if labels is not None:
            own.add(page, labels)
            own.add(page, labels, hide_main=True)
    # The table's own pages weigh as much as the layouts at most, however many they are.
    share = min(1.0, sum(kept.weights) / max(1.0, sum(own.weights)))
    labels = np.array(kept.labels + own.labels, float)
    weights = np.array(kept.weights + [v * share for v in own.weights])
    around = kept.names + own.names
    seen = {True: Counter(), False: Counter()}
    for k, one in enumerate(around):
        for name in set(one):
            seen[bool(labels[k])][name] += 1 if k < len(kept.labels) else share
    names = {
        name: float(np.clip(np.log((seen[True][name] + smoothing) / (seen[False][name] + smoothing)), *NAME_WEIGHTS))
        for name in seen[True] | seen[False]
    }
    offset = np.array([sum(names[f] for f in one) for one in around])
    known = regression(kept.facts + own.facts, labels, weights, np.clip(offset, *WORD_SCORES), penalty)
    costs = {"": 0.5, INSIDE: 0.1}
    for tag in {*kept.inside, *kept.outside, *own.inside, *own.outside}:
        inside, outside = (kept_part[tag] + share * own_part[tag] for kept_part, own_part in ((kept.inside, own.inside), (kept.outside, own.outside)))
        costs[tag] = float(np.clip(np.log1p((outside + 0.5) / (inside + 0.5)), *TAG_COSTS))
    return Weights(names, known, costs)


def sample(pages: DataFrame, column: str = "html", rows: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """At most ``rows`` different pages that mark their article, of at most ``chars`` characters each: those of least hash.

    The hashes are chosen first, so no task sends pages to the driver that are not in the sample.
    """
    source = F.col(column)
    marked = pages.select(source.alias("source"), F.xxhash64(source).alias("h")).where(
        source.rlike("(?i)<(article|main)[\\s>]") & (F.char_length(source) <= chars)
    )
    least = [r["h"] for r in marked.select("h").distinct().orderBy("h").limit(rows).collect()]
    if not least:
        return []
    chosen = marked.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("source").alias("source"))
    return [r["source"] for r in chosen.orderBy("h").limit(rows).collect()]


def extract(pages: DataFrame, weights: Weights | None = None, column: str = "html", keep: Iterable[str] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every page, its main ``text`` and ``n_chars``, its code points."""
    keep = list(keep)
    model = fit(sample(pages, column)) if weights is None else weights

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(source.as_py(), model) for source in batch.column("_source")]
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.record_batch(
                [*columns, pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    schema = T.StructType(
        [T.StructField(c, pages.schema[c].dataType) for c in keep]
        + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )
    return pages.select(*keep, F.col(column).alias("_source")).mapInArrow(tidy(texts), schema)
