"""Operator 8, HTML extraction by tag-path ratios.

A page is read into text blocks, each with its root-to-leaf tag path. Text
length and punctuation are summed per path and divided by the number of blocks
of the path; the logarithms of both ratios are smoothed over the page order and
fused by their sum. Elements that seldom hold the article (menus, forms, notices, comments
and so on, by tag, role, class or id) weigh in by a factor, as do articles; they are not
removed, so a page inside a form, or in a box with an unlucky name, is read all
the same. Blocks whose fused ratio reaches a share of the page's mean are
content.

The container that holds most of the content's text then gives all its blocks
that no such element sets apart, so that headings and short paragraphs of the
article stay. Content outside it stays too: the smallest element that holds all
content gives all its blocks, or, where that is the page itself, each further
branch of the page with content, and the page's own text beside its content.

Pages are judged one by one; no shuffle. Defined results: a null or empty page
gives the empty text; broken or cut markup is read as far as it goes; repeated
rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
#: Elements whose text is never shown as text.
SILENT = frozenset("head title style script noscript template iframe object embed svg canvas audio video input".split())
#: Elements that seldom hold the main text; headers only outside of articles.
ASIDE = frozenset("nav header footer aside form button select textarea dialog menu label".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Factors of a block's ratio: for each such element around it (more than three count as three), and inside an article.
ASIDE_WEIGHT, ASIDE_MOST, ARTICLE_WEIGHT = 0.001, 3, 4.0
_HEADER = re.compile(r"(?:^|[-_\s])(?:headers?|masthead|banners?)(?:$|[-_\s\d])")
_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|menus?|nav(?:bar|igation)?|"
    r"breadcrumbs?|footers?|foot|sidebars?|side|aside|widgets?|cookies?|consent|gdpr|notices?|popups?|modal|overlay|"
    r"newsletter|subscribe|signup|login|search|forms?|comments?|commentlist|replies|responses|disqus|discussion|share|sharing|social|related|"
    r"recommend(?:ed|ations)?|pagination|pager|toolbar|copyright|disclaimer|toc)(?:$|[-_\s\d])"
)
#: Elements that may stand in a head; any other ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template object head html".split())
#: Open elements that a start tag ends.
_IMPLIED = {
    "p": frozenset({"p"}), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}),
}
_FENCES = frozenset("ul ol table td th div article section aside main body blockquote form".split())
_CLOSES_P = BLOCK - {"br", "option", "html", "head", "body", "caption", "tr", "td", "th", "tbody", "thead", "tfoot", "title", "legend", "summary"}
_SPACE = re.compile(r"\s+")
_CUT_TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
#: Smoothing over neighbours (of logarithms, so that a box beside the article is not lifted by it), and the share of the page's mean that a path must reach.
SMOOTH = np.array([1.0, 2.0, 4.0, 2.0, 1.0]) / 10
THRESHOLD = 0.35
#: Elements that are the page itself, and those that are too small to be containers.
_PAGE = frozenset(["", "html", "body"])
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote td tr".split())


class _Block(NamedTuple):
    """A text with the tags, ids and numbers of elements in ASIDE of its open elements, and that number at the text."""

    text: str
    tags: tuple[str, ...]
    ids: tuple[int, ...]
    asides: tuple[int, ...]
    aside: int


class _Open(NamedTuple):
    tag: str
    id: int
    silent: bool
    aside: int


class _Blocks(HTMLParser):
    """Text blocks in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Open("", 0, False, 0)]
        self.count = 0
        self.in_head = False
        self.parts: list[str] = []
        self.blocks: list[_Block] = []

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            kept = [x for x in self.open if x.tag in BLOCK or not x.tag]
            self.blocks.append(_Block(text, tuple(x.tag for x in kept), tuple(x.id for x in kept), tuple(x.aside for x in kept), self.open[-1].aside))

    def _drop(self, at: int) -> None:
        if any(x.tag in BLOCK for x in self.open[at:]) or self.open[-1][2:] != self.open[at - 1][2:]:
            self.flush()
        del self.open[at:]

    def _is_aside(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body", "article", "main") or not attrs and tag not in ASIDE:
            return False
        own = dict(attrs)
        names = f"{own.get('class') or ''} {own.get('id') or ''}".lower()
        role = (own.get("role") or "").lower()
        if tag in ASIDE and tag != "header" or role in ASIDE_ROLES and role != "banner" or _NAME.search(names) or "hidden" in own or own.get("aria-hidden") == "true":
            return True
        heads = tag == "header" or role == "banner" or bool(_HEADER.search(names))
        return heads and not any(x.tag in ("article", "main") for x in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.in_head and tag not in _IN_HEAD:
            at = next((k for k, x in enumerate(self.open) if x.tag == "head"), None)
            self.in_head = at is not None
            if self.in_head and (tag == "body" or at == len(self.open) - 1):
                self._drop(at)
        if tag in BLOCK:
            self.flush()
        closes = _IMPLIED.get(tag, frozenset()) | (frozenset({"p"}) if tag in _CLOSES_P else frozenset())
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at].tag
            if name in closes:
                self._drop(at)
                break
            if name in _FENCES:
                break
        if tag in VOID:
            return
        top = self.open[-1]
        silent, aside = top.silent or tag in SILENT, top.aside + self._is_aside(tag, attrs)
        if (silent, aside) != top[2:]:
            self.flush()
        self.count += 1
        self.in_head |= tag == "head"
        self.open.append(_Open(tag, self.count, silent, aside))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.flush()
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._drop(at)
                return
            if self.open[at].tag in ("article", "main", "body", "nav", "aside", "footer", "form") and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if not self.open[-1].silent:
            self.parts.append(data)


def blocks_of(html: str) -> list[_Block]:
    reader = _Blocks()
    reader.feed(_CUT_TAG.sub("", html))
    reader.close()
    reader.flush()
    return reader.blocks


def _weights(blocks: list[_Block]) -> np.ndarray:
    """What the elements around each block make of its ratio."""
    inside = [not {"article", "main"}.isdisjoint(b.tags) for b in blocks]
    return ASIDE_WEIGHT ** np.minimum([b.aside for b in blocks], ASIDE_MOST) * np.where(inside, ARTICLE_WEIGHT, 1.0)


def content_scores(blocks: list[_Block]) -> np.ndarray:
    """Fused, smoothed tag-path ratios, one per block."""
    paths: dict[tuple[str, ...], int] = {}
    own = np.array([paths.setdefault(b.tags, len(paths)) for b in blocks])
    length = np.array([len(b.text) for b in blocks], float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) for b in blocks], float)
    n = np.bincount(own).astype(float)
    per_path = [np.log(np.bincount(own, x) / n)[own] for x in (length, marks + 0.5)]
    smooth = [np.convolve(np.pad(x, 2, mode="edge"), SMOOTH, mode="valid") for x in per_path]
    return np.exp(smooth[0] + smooth[1]) * _weights(blocks)


def content_blocks(blocks: list[_Block]) -> np.ndarray:
    """Whether each block's ratio reaches the threshold: a share of the mean over the page's text."""
    scores = np.sqrt(content_scores(blocks))
    return scores >= THRESHOLD * np.average(scores, weights=_weights(blocks) * [len(b.text) for b in blocks])


def _outside(content: list[_Block], container: int) -> tuple[set[int], set[int]]:
    """Elements that give all their blocks, and those that give their own text only, for content that the container lacks."""
    depth, others = _shared(content), [b for b in content if container not in b.ids]
    if content[0].tags[depth - 1] not in _PAGE:
        groups = {0: content}
    else:
        groups = {}
        for b in others:
            groups.setdefault(next((i for t, i in zip(b.tags, b.ids, strict=True) if t not in _PAGE), b.ids[-1]), []).append(b)
    whole, own = set(), set()
    for group in groups.values() if others else ():
        tags, ids = group[0].tags[: _shared(group)], group[0].ids
        named = [i for i, t in enumerate(tags) if t in ("article", "main")]
        at = max(named or [i for i, t in enumerate(tags) if t not in _LEAVES])
        (own if tags[at] in _PAGE else whole).add(ids[at])
        if any(t not in _PAGE for t in tags):
            whole.add(ids[len(tags) - 1])
    return whole, own


def _holder(block: _Block) -> int:
    """Place of the innermost element of a block that can be a container."""
    return next(k for k in range(len(block.tags) - 1, -1, -1) if block.tags[k] not in _LEAVES)


def _shared(content: list[_Block]) -> int:
    """Number of elements, from the root on, that hold all the blocks."""
    return sum(len(set(x)) == 1 for x in zip(*(b.ids for b in content), strict=False))


def main_text(html: str | None) -> str:
    """The article's text: blocks in page order, joined by one space."""
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    chosen = content_blocks(blocks)
    content = [b for b, c in zip(blocks, chosen, strict=True) if c]
    # The smallest element with most of the content's text; an article or main element that holds it wins.
    held: dict[int, int] = {}
    for b in content:
        for element in b.ids:
            held[element] = held.get(element, 0) + len(b.text)
    names = {e: t for b in content for t, e in zip(b.tags, b.ids, strict=True)}
    wide = [e for e, w in held.items() if 2 * w >= held[0]]
    named = [e for e in wide if names[e] in ("article", "main")]
    container = max(named or [e for e in wide if names[e] not in _LEAVES])
    whole, own = _outside(content, container)
    whole.add(container)

    def joins(b: _Block) -> bool:
        """Whether a container gives the block: no further element sets it apart."""
        at = _holder(b)
        return any(e in whole and a == b.aside for e, a in zip(b.ids, b.asides, strict=True)) or (b.ids[at] in own and b.asides[at] == b.aside)

    return " ".join(b.text for b, c in zip(blocks, chosen, strict=True) if c or joins(b))


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_SCHEMA)

    picked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
