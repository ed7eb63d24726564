"""Main text of web pages by a maximum-scoring run of words and tags.

A page is read as a list of words and tags. Words score positive, tags negative, and one
linear scan finds the run of highest total: the content region. The weights are fitted on
labelled pages: pages whose markup names its content by exactly one <article> or <main>. A
tag that stands outside labelled content costs more than one that stands inside, and words
whose nearest container holds content in labelled pages weigh more than others. Menus, forms,
notices and the like are left out by their element or by the words of their class, id or
role: neither their words nor their tags count, so that a box in mid-article does not end
the run. Nor do tags inside an <article> or <main> that holds content, or those of lists and
tables inside another element that does (html and body apart).

A name is sure if it is one of those words ("comments"), and a hint if it has one as a part
("has-sidebar", "site-footer"). A box with a hint stays if it holds half of the words that are
left without the surely named boxes, and what is in an <article> or <main> stays in any case.
A surely named box takes its articles with it only if the articles and mains outside of such
boxes have more words than those in it, as they have beside comments or teasers.

Defined results: a null or empty page, and one without words, give an empty text. Null ids
and urls are kept. Rows are independent, so repeated rows and ties do not matter (of equal
totals the first, shortest run wins). Unclosed elements end with their parent. Columns
other than page_id, url and html are not read. Memory is bounded by the longest page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED_PAGES = 400
DEAREST_TAG = 8.0
SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements of HTML by their part in the layout.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select")
DROPPED = frozenset((*RAW, "head", "nav", "header", "footer", "aside", "form", "button", "dialog",
                     "menu", "object", "canvas", "audio", "video", "option", "label", "math"))
BLOCKS = frozenset(("address", "article", "blockquote", "body", "dd", "details", "div", "dl", "dt",
                    "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr",
                    "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody",
                    "tfoot", "thead", "tr", "ul", *DROPPED))
SPACING = frozenset(("br", "td", "th", "wbr"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
                  "param", "source", "track", "wbr"))
PAGE = frozenset(("html", "body"))
CONTENT = frozenset(("article", "main"))
PARAGRAPHS = frozenset(("blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "p", "pre"))
LISTS = frozenset(("dd", "dl", "dt", "li", "ol", "table", "tbody", "td", "tfoot", "th", "thead",
                   "tr", "ul"))
# Words of a class, id or role that name something beside the article.
BESIDE = frozenset(("ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb",
                    "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie",
                    "cookies", "disclaimer", "footer", "header", "hidden", "login", "masthead",
                    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
                    "notices", "pagination", "popup", "promo", "promoted", "promotion", "related",
                    "reply", "replies", "respond", "search", "share", "sharing", "sidebar",
                    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar",
                    "widget", "widgets"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|[^<]+|<",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-zA-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


class Token(NamedTuple):
    """A tag (`tag` set) or a piece of text, the container it is in, and whether it is left out.

    `free`: a tag inside an element that holds content already, which costs nothing.
    """

    tag: str
    text: str
    n_words: int
    container: str
    dropped: bool
    labelled: bool
    free: bool = False


class Weights(NamedTuple):
    """Score of a word by container, and cost of a tag; `None` keys are for unseen ones."""

    word: dict[str | None, float]
    tag: dict[str | None, float]


class _Open(NamedTuple):
    name: str
    kind: str  # "sure" or "hint" for a named box, else "content" or ""
    dropped: bool  # by its element
    labelled: bool
    article: int  # its place among the open elements, 0 if there is none
    scope: int


class _Scope:
    """A part of a page that is judged as a whole: a named box, or an article or main."""

    def __init__(self, parent: int, kind: str, labelled: bool):
        self.parent, self.kind, self.labelled = parent, kind, labelled
        self.words = 0


def _left_out(scopes: list[_Scope]) -> list[bool]:
    """Which parts are left out by the names of what they are in. Parents come first."""
    inner = [s.words if s.kind == "content" else 0 for s in scopes]
    for k in range(len(scopes) - 1, 0, -1):
        inner[scopes[k].parent] += inner[k]
    named, outside = [False], 0
    for s in scopes[1:]:
        named.append(named[s.parent] or s.kind == "sure")
        outside += s.words if s.labelled and not named[-1] else 0

    def judged(stays: list[bool]) -> list[bool]:
        out, whole = [False], [False]
        for k, s in enumerate(scopes[1:], 1):
            up, all_ = out[s.parent], whole[s.parent]
            if s.kind == "sure":
                up, all_ = True, all_ or outside > inner[k]
            elif s.kind == "hint":
                up = up or not stays[k]
            else:
                up = up and all_
            out.append(up)
            whole.append(all_)
        return out

    sure = judged([True] * len(scopes))
    words = [0 if gone else s.words for s, gone in zip(scopes, sure, strict=True)]
    for k in range(len(scopes) - 1, 0, -1):
        words[scopes[k].parent] += words[k]
    return judged([2 * n >= words[0] for n in words])


def tokens(page: str) -> list[Token]:
    """The words and tags of a page in order, with what surrounds them."""
    found: list[Token] = []
    of: list[int] = []  # the scope of each token
    stack, scopes = [_Open("", "", False, False, 0, 0)], [_Scope(0, "", False)]
    holding = [""]  # for each open element: what it is to the tags inside, once it holds words
    held = Counter()

    def close(depth: int) -> None:
        held.subtract(holding[depth:])
        del stack[depth:], holding[depth:]

    def hold(k: int) -> None:
        name = stack[k].name
        if name and name not in PAGE and name not in PARAGRAPHS and not holding[k]:
            holding[k] = "content" if name in CONTENT else "other"
            held[holding[k]] += 1

    def free(name: str) -> bool:
        return held["content"] > 0 or name in LISTS and held["other"] > 0

    at, n = 0, len(page)
    while at < n:
        match = _TOKEN.match(page, at)
        at = match.end()
        name, top = (match[2] or "").lower(), stack[-1]
        if not name:
            text = match[0]
            if not text.startswith(("<!", "<?")):
                n_words = len(text.split())
                found.append(Token("", text, n_words, top.name, top.dropped, top.labelled))
                of.append(top.scope)
                if n_words and not top.dropped:
                    scopes[top.scope].words += n_words
                    k = len(stack) - 1
                    hold(k)
                    while stack[k].name in PARAGRAPHS and stack[k].kind != "sure":
                        k -= 1
                        hold(k)
                    if top.article:
                        hold(top.article)
            continue
        if match[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            ended = stack[depth or -1]  # a tag that ends a dropped box belongs to it
            if depth:
                close(depth)
            found.append(Token(name, "", 0, "", ended.dropped, stack[-1].labelled, free(name)))
            of.append(ended.scope)
            continue
        if name == "p" or name == "li":  # these end an open one of their kind
            if stack[-1].name == name:
                close(len(stack) - 1)
                top = stack[-1]
        kind = "content" if name in CONTENT else _named(match[3]) if name not in PAGE else ""
        dropped, scope = top.dropped or name in DROPPED, top.scope
        if kind and not dropped:
            scope = len(scopes)
            scopes.append(_Scope(top.scope, kind, top.labelled or name in CONTENT))
        found.append(Token(name, "", 0, "", dropped, top.labelled, free(name)))
        of.append(scope)
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
        elif name in BLOCKS and name not in VOID and not match[3].rstrip().endswith("/"):
            article = len(stack) if name == "article" else 0 if kind == "sure" else top.article
            labelled = top.labelled or name in CONTENT
            stack.append(_Open(name, kind, dropped, labelled, article, scope))
            holding.append("")
    out = _left_out(scopes)
    if any(out):
        found = [t._replace(dropped=True) if out[s] else t for t, s in zip(found, of, strict=True)]
    return found


def _named(attributes: str) -> str:
    """What class, id and role say: "sure" or a "hint" that it is beside the article, or ""."""
    if "=" not in attributes:
        return ""
    names = " ".join(" ".join(m) for m in _NAMES.findall(attributes)).lower()
    if not BESIDE.isdisjoint(names.split()):
        return "sure"
    return "" if BESIDE.isdisjoint(_PARTS.findall(names)) else "hint"


def fit(pages: Iterable[str]) -> Weights:
    """Weights from pages that name their content; pages that do not are passed over."""
    words, tags = Counter(), Counter()
    for page in pages:
        read = tokens(page or "")
        if sum(t.tag in CONTENT for t in read) not in (1, 2):
            continue
        for t in read:
            if t.dropped:  # has no part in a score
                continue
            if t.tag:
                tags[t.tag, t.labelled] += 1
            elif t.n_words:
                words[t.container, t.labelled] += t.n_words
    word: dict[str | None, float] = {None: 0.5}
    for key in {k for k, _ in words}:
        word[key] = (words[key, True] + 0.5) / (words[key, True] + words[key, False] + 1)
    tag: dict[str | None, float] = {None: 2.0}
    for key in {k for k, _ in tags}:
        odds = (tags[key, False] + 0.5) / (tags[key, True] + 0.5)
        tag[key] = 0.1 + min(DEAREST_TAG, 4 * max(0.0, math.log(odds) + 1))
    for key in CONTENT:  # they stand at the border of what they label
        tag[key] = 0.1
    return Weights(word, tag)


def region(read: list[Token], weights: Weights) -> tuple[int, int]:
    """The run [start, end) of highest total score."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    word, tag = weights
    for k, t in enumerate(read):
        if t.dropped:
            pass
        elif t.tag:
            total -= 0.0 if t.free else tag.get(t.tag, tag[None])
        elif t.n_words:
            total += t.n_words * word.get(t.container, word[None])
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, best_at = total, (start, k + 1)
    return best_at


def extract(page: str | None, weights: Weights) -> str:
    """The main text: blocks of the content region, joined by an empty line."""
    read = tokens(page or "")
    start, end = region(read, weights)
    blocks, block = [], []
    for t in read[start:end]:
        if t.tag in BLOCKS:
            blocks.append(block)
            block = []
        elif t.tag in SPACING:
            block.append(" ")
        elif not t.tag and not t.dropped:
            block.append(t.text)
    blocks.append(block)
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n\n".join(t for t in texts if t)


def labelled_pages(pages: DataFrame, limit: int = LABELLED_PAGES) -> list[str]:
    """At most `limit` pages that name their content, by the hash of their ids."""
    some = pages.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select(
        "page_id", F.xxhash64("html").alias("hash"), "html"
    )
    order = F.xxhash64("page_id"), F.col("page_id"), F.col("hash")
    # Chosen by their ids alone, so that no partition sends its pages to the driver.
    named = some.select("page_id", "hash").distinct().orderBy(*order).limit(limit)
    chosen = some.join(named, ["page_id", "hash"]).dropDuplicates(["page_id", "hash"])
    return [r["html"] for r in chosen.orderBy(*order).collect()]


def extracted(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars for each page."""
    fitted = weights or fit(labelled_pages(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), fitted) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    columns = [F.col("page_id").cast("long").alias("page_id"), "url", "html"]
    return pages.select(*columns).mapInArrow(run, SCHEMA)
