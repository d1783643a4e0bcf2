"""Main text of web pages by tag-path ratios.

A page is parsed into text nodes, each with its path of tags from the root. Per path the lengths and
the punctuation of its nodes are summed and divided by their number: boilerplate paths, such as lists of
links, hold many short nodes without punctuation, content paths fewer and longer ones. The two ratios are
fused by their product, smoothed over neighbouring nodes in page order, and paths above a threshold taken
from their spread are content. The part of the page that holds most of the content is its article; the
blocks in it that are not marked as something else make up the text. On a page without ``article`` or
``main`` the content outside that part, the text it stands in and the headings above it belong to it too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcairn.llm.tokens import text_slices

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements whose content is never text of an article.
SKIPPED = {
    "script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "canvas", "audio", "video", "map",
    "nav", "menu", "footer", "aside", "form", "button", "select", "textarea", "input", "label", "fieldset", "dialog", "datalist",
}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title"}
# Elements that run inside a block; every other one begins and ends a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
# A start tag that ends an open element of these kinds, as HTML's rules for left-out end tags say.
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dd", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "ul",
}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
FENCES = {"table", "ul", "ol", "dl", "td", "th", "div", "article", "section", "body", "html", "main", "blockquote"}
# Elements that may stand in a head; any other start tag, or text, ends a head that was left open.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements that stand in a run of text, and those beside one of them that are of the same run.
FLOW = {
    "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "figure", "figcaption",
}
BESIDE = HEADINGS | {"p", "pre"} | FLOW - {"ul", "ol", "li", "td"}
# Words in class, id or role that mark an element as something else than the article.
MARKED = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tions?)?|banners?|nav|navbar|navigation|menus?|"
    r"breadcrumbs?|side-?bars?|foot(?:er)?|masthead|site-?header|page-?header|top-?bar|cookies?|consent|gdpr|notices?|notifications?|alerts?|"
    r"popups?|pop-?ups?|modals?|overlays?|newsletters?|subscri(?:be|ption)s?|sign-?up|log-?in|forms?|search(?:-?(?:box|form|bar))?|comments?|"
    r"commentlist|disqus|repl(?:y|ies)|responses?|discussion|related|recommend(?:ed|ations?)?|read-?more|see-?also|shar(?:e|ing)|social|"
    r"widgets?|tags?|tag-?cloud|pagination|pager|skip(?:-link)?|toolbars?|copyright|legal|disclaimer|complementary|contentinfo|"
    r"outbrain|taboola|print-?only|hidden|visually-?hidden|sr-only|screen-reader-text)(?:$|[-_\s])",
    re.IGNORECASE,
)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…、。！，：；？،؟।]")
SPACES = re.compile(r"\s+")
SMOOTH = 1  # neighbours on either side


class _Page(HTMLParser):
    """Text nodes in page order: (path number, block number, text, marked, element chain)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, marked, element number
        self.elements = [(-1, "", 0)]  # parent element, tag, depth
        self.nodes: list[tuple[int, int, str, bool]] = []  # element, block, text, marked
        self.block = 0
        self.in_head = False

    def _marked(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def _pop_to(self, at: int) -> None:
        if any(tag not in INLINE for tag, _, _ in self.stack[at:]):
            self.block += 1
        del self.stack[at:]

    def _end_open(self, kinds: set[str], fences: set[str]) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in kinds:
                self._pop_to(at)
                return
            if self.stack[at][0] in fences:
                return

    def _leave_head(self, tag: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == "head":
                self._pop_to(at)
                break
            if self.stack[at][0] in ("title", "noscript", "template") and tag != "body":
                return
        self.in_head = False

    def handle_starttag(self, tag, attrs):
        if self.in_head and tag not in IN_HEAD:
            self._leave_head(tag)
        if tag in ENDS_P:
            self._end_open({"p"}, FENCES | {"button"})
        if tag in CLOSES:
            kinds = CLOSES[tag]
            while True:
                before = len(self.stack)
                self._end_open(kinds, FENCES - kinds)
                if len(self.stack) == before:
                    break
        if tag not in INLINE:
            self.block += 1
        parent = self.stack[-1][2] if self.stack else 0
        number = len(self.elements)
        self.elements.append((parent, tag, self.elements[parent][2] + 1))
        if tag in VOID:
            if tag == "br" and self.nodes:
                self.nodes.append((parent, self.block, " ", self._marked()))
            return
        names = {k: v or "" for k, v in attrs}
        marked = self._marked() or tag in SKIPPED or "hidden" in names or names.get("aria-hidden") == "true"
        if not marked and tag == "header":  # a page's header, not one inside an article
            marked = not any(t in ("article", "main") for t, _, _ in self.stack)
        nested = tag == "article" and any(t == "article" for t, _, _ in self.stack)
        if not marked and (nested or tag not in ("html", "body", "article", "main")):
            named = " ".join(names.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label"))
            marked = bool(named.strip()) and bool(MARKED.search(CAMEL.sub("-", named)))
        if not marked and "style" in names:
            marked = bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", names["style"], re.IGNORECASE))
        self.stack.append((tag, marked, number))
        self.in_head = self.in_head or tag == "head"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.handle_starttag("br", [])
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self._pop_to(at)
                return
            if tag in INLINE and self.stack[at][0] not in INLINE:
                return  # an inline end tag does not close a block
            if tag == "p" and self.stack[at][0] in FENCES:
                return
        if tag not in INLINE:
            self.block += 1

    def handle_data(self, data):
        if self.in_head and self.stack and self.stack[-1][0] == "head" and data.strip():
            self._leave_head("")
        if not self._marked():
            self.nodes.append((self.stack[-1][2] if self.stack else 0, self.block, data, False))


def _smoothed(values: np.ndarray, width: int = SMOOTH) -> np.ndarray:
    kernel = np.exp(-0.5 * np.arange(-width, width + 1) ** 2)
    padded = np.pad(values, width, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _holds(page: _Page, outer: int, element: int) -> bool:
    while element > outer:  # an element's number is above its parent's
        element = page.elements[element][0]
    return element == outer


def _add_beside(page: _Page, article: int, blocks: list[tuple[int, str]], kept: list[bool]) -> None:
    """Keep the blocks of the run of text that a list, table or quotation stands in."""
    run = article
    while run > 0 and page.elements[run][1] in FLOW:
        run = page.elements[run][0]
    if run == article:
        return
    for i, (element, _) in enumerate(blocks):
        while element > run and page.elements[element][1] in INLINE | BESIDE:
            element = page.elements[element][0]
        kept[i] = kept[i] or element == run


def _add_headings(page: _Page, blocks: list[tuple[int, str]], kept: list[bool], scope: int) -> None:
    """Keep the headings in ``scope`` between kept blocks, right before one, or above one in the same element."""
    first = kept.index(True)
    holders: set[int] = set()  # elements that hold a kept block further on
    for i in range(len(blocks) - 1, -1, -1):
        element = blocks[i][0]
        if not kept[i] and holders:
            heading = element
            while heading > 0 and page.elements[heading][1] in INLINE:
                heading = page.elements[heading][0]
            if page.elements[heading][1] in HEADINGS and _holds(page, scope, heading):
                kept[i] = i > first or kept[i + 1] or page.elements[heading][0] in holders
        if kept[i]:
            while element >= 0 and element not in holders:
                holders.add(element)
                element = page.elements[element][0]


def content_blocks(html: str | None) -> list[str]:
    """Texts of the blocks of a page's article, in page order."""
    page = _Page()
    page.feed(html or "")
    page.close()
    texts: dict[int, list[str]] = defaultdict(list)
    owner: dict[int, int] = {}
    for element, block, text, marked in page.nodes:
        if not marked:
            texts[block].append(text)
            if text.strip():
                owner.setdefault(block, element)
    blocks = [(owner[b], SPACES.sub(" ", "".join(texts[b])).strip()) for b in sorted(owner)]
    if not blocks:
        return []
    # Ratios per tag path: text and punctuation for each node that the path has in the page.
    paths: list[tuple[str, ...]] = []
    known: dict[int, tuple[str, ...]] = {0: ()}
    for element, _ in blocks:
        chain = []
        while element not in known:
            chain.append(element)
            element = page.elements[element][0]
        for e in reversed(chain):
            tag = page.elements[e][1]
            known[e] = known[page.elements[e][0]] + (() if tag in INLINE else (tag,))
        paths.append(known[chain[0]] if chain else known[element])
    sums: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for path, (_, text) in zip(paths, blocks):
        entry = sums[path]
        entry[0] += len(text)
        entry[1] += len(PUNCTUATION.findall(text))
        entry[2] += 1
    fused = np.array([np.log1p(s[0] / s[2]) * (1 + s[1] / s[2]) for s in (sums[p] for p in paths)])
    smooth = _smoothed(fused)
    threshold = min(float(smooth.std()), float(smooth.max()) / 2)
    weights = np.array([len(t) for _, t in blocks], dtype=float)
    chosen = smooth >= threshold
    # The article is the deepest element that holds nine tenths of the chosen text.
    held: dict[int, float] = defaultdict(float)
    for (element, _), weight, yes in zip(blocks, weights, chosen):
        if yes:
            while element >= 0:
                held[element] += weight
                element = page.elements[element][0]
    total = held[0]
    article = max((e for e, w in held.items() if w >= 0.9 * total), key=lambda e: (page.elements[e][2], -e))
    while article > 0 and page.elements[article][1] in INLINE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "pre"}:
        article = page.elements[article][0]
    # Whole articles: an element that is one is never cut inside.
    up, whole = article, False
    while up > 0 and not whole:
        whole = page.elements[up][1] in ("article", "main")
        article, up = up if whole else article, page.elements[up][0]
    kept = [_holds(page, article, element) for element, _ in blocks]
    scope = 0
    if whole:
        scope = article
        while scope > 0 and page.elements[scope][1] != "main":
            scope = page.elements[scope][0]
    else:
        kept = [inside or bool(yes) for inside, yes in zip(kept, chosen | (fused >= threshold))]
        _add_beside(page, article, blocks, kept)
    if not whole or scope:
        _add_headings(page, blocks, kept, scope)
    return [text for (_, text), yes in zip(blocks, kept) if yes]


def _extract(columns: list[str]):
    def run(batches):
        for batch in batches:
            pages = batch["_html"].tolist()
            for a, b in text_slices(pages):
                out = batch.iloc[a:b].copy()
                out["text"] = ["\n".join(content_blocks(p)) for p in pages[a:b]]
                yield out[columns]

    return run


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text (main text, blocks joined by a line feed) and n_chars of every page.

    Character references are decoded, white space inside a block becomes one space. A page without
    content, or a null or empty one, has an empty text; broken markup is read as HTML's rules for
    left-out tags say; pages of any length are read whole; repeated rows stay; an empty table gives no
    rows.
    """
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", text string"
    return rows.mapInPandas(_extract([*keep, "text"]), schema).withColumn("n_chars", F.length("text").cast("long"))
