"""The main text of a page by its line-block distribution.

Markup is stripped to one line per block element. A line weighs its text length up to ``FULL``, less
for links and for want of punctuation. Markup only weighs: lines in parts named as something else
(navigation, notices, adverts, comments) weigh a small share, lines outside a marked article too, and
lines inside one weigh ``MARKED`` at least. Lines that are noise beside the heaviest take no part;
the weights of the others are summed over sliding windows of lines. A stretch begins where the
sums surge and ends where they dive; it is the main text if its sums come near the page's largest.
At its edges, and in gaps between two stretches, light lines are kept if they stand in the same
container as the heavy ones beside them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 3
#: Weights: of a long line, of any line in a marked article at least, of headings and other lines at least.
FULL, MARKED, HEADING, SHORT = 200, 80, 30, 10
#: What part of its weight a line keeps without punctuation, in a part whose name says it is something
#: else, in an element that is never the article, outside the marked article.
UNPUNCTUATED, NAMED, NEVER, UNMARKED = 0.6, 0.005, 0.0005, 0.005
#: Shares of the heaviest line below which a line is noise or light, and of the largest sum at which a
#: stretch begins and ends and which it must reach; and the least sum that is a text.
NOISE, LIGHT, DIVE, SURGE, LEAST = 0.024, 0.25, 0.1, 0.3, 0.5
SLICE = 64

_ATTRS = r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+"
_TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRS})>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_MARK = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"[.,;:!?\u2026\u3001\u3002\uff01\uff0c\uff1f\u0964\u061f\u060c]")

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "select", "object", "video", "audio", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
SPACED = {"br", "td", "th", "img", "input", "button"}
OUTSIDE = {"head", "nav", "aside", "footer", "form", "menu", "dialog", "button", "fieldset", "search", "label"}
PLAIN = {"html", "body", "main"}
CONTAINERS = {"article", "aside", "body", "center", "div", "footer", "form", "header", "main", "nav", "section", "td"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that may hold the whole page.
MAYBE = {"form"}
SHUT_BY_BLOCK = {"p"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words of class names and ids that mark what is not the article.
PARTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "sidebar", "side", "rail", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "crumbs", "footer", "foot", "masthead", "topbar", "toolbar", "related", "recommended", "recommendations", "widget", "widgets", "pagination", "pager", "search", "skip", "copyright", "legal", "disclaimer"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion"}
HEADS = {"header", "head", "top"}
NOT_PARTS = {"with", "has", "no", "without", "content", "main", "container", "wrapper", "wrap", "page", "layout", "article", "body"}


class _Block:
    __slots__ = ("text", "linked", "out", "article", "container", "heading")

    def __init__(self, out: int, article: int, container: int, heading: bool):
        self.text, self.linked, self.out, self.article, self.container, self.heading = [], 0, out, article, container, heading


def _outside(name: str, attrs: str, in_article: bool) -> int:
    """Whether an element holds something else than the article: 2 if its kind says so, 1 if only its
    name, 0 if nothing does."""
    if name in MAYBE:
        return 1
    if name in OUTSIDE or name == "header" and not in_article:
        return 2
    if not attrs or name in PLAIN:
        return 0
    out = 0
    for m in _MARK.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if key == "role" and value.strip() in ROLES:
            return 2
        if key in ("class", "id"):
            for one in value.split():
                words = set(_WORDS.findall(one))
                if words & COMMENTS and not words & {"no", "has", "with"}:
                    return 2
                if name != "article" and words & PARTS and not words & NOT_PARTS:
                    out = 1
                if name != "article" and not in_article and words & HEADS and not words & NOT_PARTS:
                    out = 1
    return out


def lines(page: str) -> list[_Block]:
    """The blocks of a page in order, with what stands around each."""
    out: list[_Block] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: name, outside, whether an article began here
    outside, articles, links, headings = [0, 0, 0], 0, 0, 0  # how many of each are open
    block = _Block(0, 0, 0, False)
    number, containers, opened = 0, [0], 0

    def cut() -> None:
        nonlocal block
        if block.text:
            out.append(block)
        block = _Block(2 if outside[2] else int(outside[1] > 0), number if articles else 0, containers[-1], headings > 0)

    def pop() -> None:
        nonlocal articles, links, headings
        name, was_out, was_article = stack.pop()
        outside[was_out] -= 1
        articles -= was_article
        links -= name == "a"
        headings -= name in HEADINGS
        if name in CONTAINERS:
            containers.pop()

    def put(text: str) -> None:
        if text:
            block.text.append(text)
            if links:
                block.linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        i = page.find("<", at)
        if i < 0:
            rest = page[at:]
            put(rest)
            break
        if i > at:
            put(page[at:i])
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), i):
            end = page.find(">", i)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, i) or _LOOSE.match(page, i)
        if m is None:
            if re.match(r"</?[a-zA-Z]", page[i : i + 3]):  # a tag that is cut off
                break
            put("<")
            at = i + 1
            continue
        at = m.end()
        closing, name, attrs = m[1], m[2].lower(), m[3]
        if closing:
            if name in VOID:
                continue
            if any(x[0] == name for x in stack):
                if name in BLOCK:
                    while True:
                        top = stack[-1][0]
                        pop()
                        if top == name:
                            break
                else:  # an inline end tag closes nothing across a block
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            while len(stack) > k:
                                pop()
                            break
                        if stack[k][0] in BLOCK:
                            break
            if name in BLOCK:
                cut()
            elif name in SPACED:
                put(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if not attrs.rstrip().endswith("/"):
                close = page.find(">", end.end()) if end else -1
                at = size if close < 0 else close + 1
            if name == "title":
                cut()
            continue
        if name in BLOCK:
            while stack and stack[-1][0] in SHUT_BY_BLOCK or stack and stack[-1][0] not in BLOCK:
                pop()
            if name == "li":
                while stack and stack[-1][0] == "li":
                    pop()
            if name == "body":
                while stack and stack[-1][0] == "head":
                    pop()
        elif name in SPACED:
            put(" ")
        if name in VOID or attrs.endswith("/"):
            if name in BLOCK:
                cut()
            continue
        begins = (name in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main\b", attrs))) and not _outside(name, attrs, articles > 0)
        if begins and not articles:
            number += 1
        away = _outside(name, attrs, articles > 0)
        stack.append((name, away, begins))
        outside[away] += 1
        articles += begins
        links += name == "a"
        headings += name in HEADINGS
        if name in CONTAINERS:
            opened += 1
            containers.append(opened)
        if name in BLOCK:
            cut()
        elif away:
            cut()
    cut()
    return out


def weight(text: str, b: _Block, marked: bool) -> float:
    """What a line weighs by its length, links, punctuation and markup."""
    free = 1 - min(1.0, b.linked / len(text))
    w = min(len(text), FULL) * free
    w = max(w, HEADING if b.heading else SHORT) if free > 0.2 else 0.0
    if not b.heading and not _STOP.search(text):
        w *= UNPUNCTUATED
    if b.article:
        w = max(w, MARKED)
    elif marked:
        w *= UNMARKED
    return w * (1, NAMED, NEVER)[b.out]


def main_lines(weights: list[float], containers: list[int], headings: list[bool]) -> list[int]:
    """The numbers of the lines of the main text, by the distribution of their weights."""
    top = max(weights, default=0)
    own = [i for i, w in enumerate(weights) if w > 0 and w >= NOISE * top]
    sums = [sum(weights[i] for i in own[k : k + WINDOW]) for k in range(len(own))]
    most = max(sums, default=0)
    if most < LEAST:
        return []
    near = [any(x >= DIVE * most for x in sums[max(0, k - WINDOW + 1) : k + 1]) for k in range(len(own))]
    stretch, begin = [0] * len(own), 0  # which stretch a line is in, if it is the main text
    while begin < len(own):
        end = begin
        while end < len(own) and near[end] == near[begin]:
            end += 1
        if near[begin] and max(sums[begin:end]) >= SURGE * most:
            stretch[begin:end] = [begin + 1] * (end - begin)
        begin = end
    heavy = [bool(s) and weights[i] >= LIGHT * top for s, i in zip(stretch, own)]
    before, after, last = [], [], None  # the heavy lines next to each
    for k, h in enumerate(heavy):
        before.append(last)
        last = k if h else last
    last = None
    for k in range(len(own) - 1, -1, -1):
        after.append(last)
        last = k if heavy[k] else last
    after.reverse()
    kept = []
    for k, i in enumerate(own):
        a, b = (x is not None and containers[own[x]] == containers[i] for x in (before[k], after[k]))
        if heavy[k] or a and b or stretch[k] and (a or b):
            kept.append(k)
    while kept and headings[own[kept[-1]]] and len(kept) > 1 and containers[own[kept[-1]]] != containers[own[kept[-2]]]:
        kept.pop()  # a heading of what follows the text
    return [own[k] for k in kept]


def extract(page: str | None) -> str:
    """The main text: blocks joined by an empty line, white space inside a block as one space."""
    found = [(text, b) for b in lines(page or "") if (text := _SPACE.sub(" ", entities.unescape("".join(b.text))).strip())]
    marked = any(b.article and not b.out for _, b in found)
    weights = [weight(text, b, marked) for text, b in found]
    return "\n\n".join(found[i][0] for i in main_lines(weights, [b.container for _, b in found], [b.heading for _, b in found]))


def main_text(pages: DataFrame, id_col: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``(id, *keep, text string, n_chars long)`` for every row; a null page is empty, and a page
    without an article gives an empty text. Rows that repeat an id or a page each keep their row;
    columns that are not kept are not looked at; an empty table gives an empty result. Whole pages,
    however long, one pass, no shuffle."""
    names = [f"k{i}" for i in range(len(keep))]
    slim = pages.select(F.col(id_col).alias("id"), F.col(html).alias("html"), *(F.col(c).alias(n) for c, n in zip(keep, names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                texts = [extract(x) for x in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("id"), *(rows.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", *names, "text", "n_chars"])

    out = slim.select("id", *names, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return slim.mapInArrow(run, out).select(F.col("id").alias(id_col), *(F.col(n).alias(c) for c, n in zip(keep, names)), "text", "n_chars")
