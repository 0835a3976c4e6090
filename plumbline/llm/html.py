"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of words and tags.  Each scores the logarithm of how much more often its kind
occurs inside the article than outside, learnt from pages that mark their article: words mostly
above zero, tags mostly below.  One linear scan finds the contiguous run with the largest sum, and
its words, less what stands in elements that are never article text, are the page's main text.

Kinds know the element they stand in - menu, form, advert and so on, by tag name or by words of the
class, id or role.  Such parts are left out wherever they stand; where a name may as well be that of
a section of the article (discussion, related, message ...), its learnt weight decides.  Only
scripts and styles are skipped unread; text of math, object, noscript or svg counts like any other.
The article mark is read to learn from, and to keep an article together around its left-out parts.
Fitting takes the `sample` marked pages that come first by a hash of their id.

Edge cases: null and empty html gives an empty text, as does a page without any positive word;
tags left open end with the element around them, at the next landmark or with the page, and a < that
no > closes is text; very long pages are read whole, in time linear in their length; without marked pages the weights are +1 for words and -1 for tags; repeated
rows get a row each; an empty table gives an empty result; columns other than page_id, url and html
are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches

SAMPLE = 2000
SMOOTH = 0.5

_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ENDS = re.compile(r"[>\"']")
#: Elements whose content is no text and reaches to their closing tag.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main "
    "menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may hold a part of the page, by tag ...
_HOLDERS = frozenset("div section table ul ol dl aside nav header footer form head menu dialog main "
                     "article figure details fieldset button title label select textarea p span "
                     "td".split())
_MARKS = frozenset(("article", "main"))
_BAD_TAGS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer",
             "aside": "aside", "form": "form", "fieldset": "form", "button": "form",
             "label": "form", "select": "form", "textarea": "form", "dialog": "notice", "head": "head", "title": "head"}
#: ... and by words of their names.
_BAD_WORDS = {
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager "
                    "tabs toolbar".split(), "menu"),
    **dict.fromkeys("header masthead banner topbar".split(), "header"),
    **dict.fromkeys("footer copyright colophon bottombar".split(), "footer"),
    **dict.fromkeys("sidebar aside recommended recommendations widget widgets teaser "
                    "trending complementary".split(), "aside"),
    **dict.fromkeys("ad ads adv advert adverts advertisement advertising sponsor sponsored "
                    "sponsors promo promotion promoted adsense".split(), "advert"),
    **dict.fromkeys("cookie cookies consent gdpr notification popup modal overlay subscribe "
                    "subscription newsletter paywall signup".split(), "notice"),
    **dict.fromkeys("comment comments reply replies respond disqus".split(), "comments"),
    **dict.fromkeys("form login sharing social".split(), "form")}
#: Words that may as well name a section of an article: each has a kind and a weight of its own, and
#: what stands in it is judged as plain words are where no marked page has it.
_UNSURE = frozenset("related popular notice notices alert disclaimer warning message discussion "
                    "reviews search share".split())


def _part(tag: str, attributes: str) -> str:
    """The part of a page that an element opens, or nothing."""
    if tag in _MARKS:
        return ""
    if tag in _BAD_TAGS:
        return _BAD_TAGS[tag]
    unsure = ""
    if tag in _HOLDERS and attributes:
        for m in _NAMES.finditer(attributes):
            for w in _PARTS.findall(m[1] or m[2] or m[3] or ""):
                if (w := w.lower()) in _BAD_WORDS:
                    return _BAD_WORDS[w]
                if w in _UNSURE:
                    unsure = unsure or "?" + w
    return unsure


def _tag_ends(html: str) -> tuple[list[int], list[int]]:
    """The places of > and quotes, and for each where a tag ends that goes on there: at the first
    > outside quotes, -1 if there is none."""
    at = [m.start() for m in _ENDS.finditer(html)]
    ends = [-1] * (len(at) + 1)
    following: dict[str, int] = {}
    for i in range(len(at) - 1, -1, -1):
        c = html[at[i]]
        if c == ">":
            ends[i] = at[i]
        else:
            ends[i] = ends[following[c] + 1] if c in following else -1
            following[c] = i
    return at, ends


class _Open:
    """The open elements that may hold a part.  Every step takes constant time, or as much as it
    removes or settles for good, so that a page is read in time linear in its length."""

    def __init__(self):
        self.elements: list[tuple[str, str, str]] = []  # tag, part it opens, part in force
        self.tags: Counter[str] = Counter()
        self.first = 0  # elements before this one hold no part

    @property
    def part(self) -> str:
        return self.elements[-1][2] if self.elements else ""

    def push(self, tag: str, own: str) -> None:
        if not own and self.first == len(self.elements):
            self.first += 1
        # the outer part counts, unless it is unsure and the inner one is not
        around = self.part
        self.elements.append((tag, own, own if own and around[:1] in ("", "?") else around))
        self.tags[tag] += 1

    def close(self, tag: str) -> None:
        """End the innermost element of that tag and all within; nothing if none is open."""
        while self.tags[tag]:
            last = self.elements.pop()[0]
            self.tags[last] -= 1
            if last == tag:
                break
        self.first = min(self.first, len(self.elements))

    def drop_parts(self) -> None:
        """End the elements that open a part, not those around them or within."""
        rest = []
        for tag, own, _ in self.elements[self.first:]:
            if own:
                self.tags[tag] -= 1
            else:
                rest.append((tag, "", ""))
        self.elements[self.first:] = rest
        self.first = len(self.elements)


class Page:
    """tokens: (kind, text or None, part, new block, inside a marked article)."""

    def __init__(self, html: str):
        self.tokens: list[tuple[str, str | None, str, bool, bool]] = []
        self.marks, self.marked, self.block = 0, 0, True
        self.open = _Open()
        marks, ends = _tag_ends(html)
        begin = at = 0  # of the text that has not become a token yet
        while (at := html.find("<", at)) >= 0:
            tag = _TAG.match(html, at + 1)
            end = ends[bisect_left(marks, tag.end())] if tag else -1
            if end < 0 and html[at + 1:at + 2] not in ("!", "?", "/"):
                at += 1  # no markup
                continue
            self._text(html[begin:at])
            if end >= 0:
                raw = None if tag[1] else _RAW.get(tag[2].lower())
                if raw:
                    self.tokens.append((tag[2].lower(), None, self.open.part, False, self.marked > 0))
                    last = raw.search(html, end)
                    at = last.end() if last else len(html)
                else:
                    self._tag(tag[2].lower(), bool(tag[1]), html[tag.end():end])
                    at = end + 1
            else:  # a comment or a declaration
                close = "-->" if html.startswith("!--", at + 1) else ">"
                end = html.find(close, at + 1 + len(close))
                at = end + len(close) if end >= 0 else len(html)
                self.tokens.append(("!", None, self.open.part, False, self.marked > 0))
            begin = at
        self._text(html[begin:])

    def _text(self, text: str) -> None:
        if text:
            self.tokens.append(("", text, self.open.part, self.block, self.marked > 0))
            self.block = False

    def _tag(self, tag: str, closes: bool, attributes: str) -> None:
        if tag in _BLOCKS:
            self.block = True
        if tag in _MARKS or tag == "body":
            if not closes and not self.marked:  # a landmark ends what was left open before it
                self.open.drop_parts()
            self.marks += not closes and tag == "article"
            if tag != "body":
                self.marked = max(self.marked + (-1 if closes else 1), 0)
        if closes:
            self.open.close(tag)
        elif tag in _HOLDERS and tag not in _VOID and not attributes.endswith("/"):
            own = _part(tag, attributes)
            if own or tag not in ("p", "span", "td", "label"):
                self.open.push(tag, own)
        self.tokens.append((("/" if closes else "") + tag, None, self.open.part, False,
                            self.marked > 0))

    def kinds(self) -> Iterator[tuple[str, int]]:
        """Each token's kind and how many words or tags it stands for."""
        for kind, text, part, _, _ in self.tokens:
            if text is None:
                yield f"<{kind} {part}", 1
            else:
                yield f"word {part}", len(text.split())


Weights = dict[str, float]


def weight(weights: Weights, kind: str) -> float:
    """A kind that no marked page had scores by its form, in an unsure part as outside of it."""
    got = weights.get(kind)
    if got is None and "?" in kind:
        kind = kind[:kind.index("?")]
        got = weights.get(kind)
    return got if got is not None else 1.0 if kind == "word " else -1.0


def left_out(weights: Weights, part: str) -> bool:
    """Whether words of the part are no article text: of unsure parts, the weights decide."""
    return bool(part) and (part[0] != "?" or weight(weights, f"word {part}") < 0)


def best_run(scores: list[float]) -> tuple[int, int]:
    """[begin, end) of the contiguous run with the largest sum; empty if no sum is positive."""
    best, run, begin, out = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, begin = 0.0, i
        run += s
        if run > best:
            best, out = run, (begin, i + 1)
    return out


def extract(html: str, weights: Weights) -> str:
    """The main text: blocks of the best run in page order, joined by one space."""
    page = Page(html)
    out = {part: left_out(weights, part) for part in {t[2] for t in page.tokens}}
    # inside a marked article, what is left out anyway must not cut the run in two
    scores = [0.0 if marked and out[part] else n * weight(weights, kind)
              for (kind, n), (_, _, part, _, marked) in zip(page.kinds(), page.tokens, strict=True)]
    begin, end = best_run(scores)
    blocks: list[list[str]] = []
    for i in range(begin, end):
        _, text, part, block, _ = page.tokens[i]
        if text is None or out[part]:
            continue
        if block or not blocks or i > 0 and out[page.tokens[i - 1][2]]:
            blocks.append([])
        blocks[-1].append(text)
    done = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return " ".join(b for b in done if b)


def _count_batches(batches: Iterator) -> Iterator:
    inside, outside = Counter(), Counter()
    for b in batches:
        for html in b.column(0).to_pylist():
            page = Page(html)
            if page.marks != 1:
                continue
            for (kind, n), token in zip(page.kinds(), page.tokens, strict=True):
                if token[0].strip("/") not in _MARKS:
                    (inside if token[4] else outside)[kind] += n
    kinds = sorted(inside | outside)
    yield pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()),
         pa.array([outside[k] for k in kinds], pa.int64())], names=["kind", "inside", "outside"])


def train(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Log ratios of each kind's share inside and outside the articles of marked pages."""
    small_batches(pages.sparkSession)
    marked = pages.where(F.col("html").rlike("(?i)<article[\\s>]")).select("page_id").distinct(
        ).orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = pages.join(F.broadcast(marked), "page_id").select("html").where(
        "html is not null").mapInArrow(_count_batches, "kind string, inside long, outside long"
                                       ).groupBy("kind").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).orderBy(
        F.desc(F.col("inside") + F.col("outside")), "kind").limit(5000).collect()
    all_in, all_out = sum(r["inside"] for r in rows), sum(r["outside"] for r in rows)
    if not all_in or not all_out:
        return {}
    return {r["kind"]: math.log((r["inside"] + SMOOTH) / (all_in + SMOOTH * len(rows)))
            - math.log((r["outside"] + SMOOTH) / (all_out + SMOOTH * len(rows))) for r in rows}


def _extract_batches(batches: Iterator, weights: Weights) -> Iterator:
    for b in batches:
        texts = [extract(h, weights) if h else "" for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """(page_id, url, text, n_chars), a row per page."""
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        partial(_extract_batches, weights=weights),
        f"page_id {kind}, url string, text string, n_chars long")
