"""Main text of web pages from flat text blocks.

A page is read as a flat run of text blocks. Each has its own and its neighbours' word count
and link density, and what its open elements say about it; a decision tree, grown here from
a small labelled table of pages, tells article blocks from the rest. Where elements say
nothing, word counts and link densities of the block and its neighbours decide. Reading a
page takes time in proportion to it: markup that never ends is looked for once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, spread

# Element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
DROPPED_TAGS = frozenset("head script style noscript template iframe textarea select button svg canvas object audio video datalist title".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Parts of class, id and role names that mark what is no article text.
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs byline captcha comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus feedback follow footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination paging paywall popup promo promoted promotion recommended related replies reply reviews search share sharing sidebar signup sitemap skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar widget".split()
)
_IMPLIED_END = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that an implied end does not reach beyond.
_NOTHING: frozenset[str] = frozenset()
_HOLDS = frozenset("ul ol dl table div article section main body select".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
#: A tag whose quotes never close: it ends at the next >.
_LOOSE = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>|(?P<text>[^<]+|<)", re.S)
_OPENS = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"""(?<![^\s=/>"'])([^\s=/>"']++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)""")
#: A character reference to a number beyond all code points.
_TOO_LARGE = re.compile(r"&#0*+(?:[1-9][0-9]{7,}|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,});?")
_SPACE = re.compile(r"[\s ]+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*(?:/[^>]*)?>", re.I) for tag in RAW_TAGS}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: bool
    article: bool
    heading: bool


def _marks(attrs: str) -> tuple[bool, bool]:
    """Whether an element's attributes mark it as boilerplate, and whether they hide it."""
    boiler = hidden = False
    lowered = attrs.lower()
    if "=" in attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                parts = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value).lower())
                boiler |= not BOILER_NAMES.isdisjoint(parts)
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower() or "visibility:hidden" in value.replace(" ", "").lower()
            elif name == "aria-hidden":
                hidden |= value.lower() == "true"
    hidden |= bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", lowered))
    return boiler, hidden


def blocks(html: str) -> list[Block]:
    """Flat text blocks in page order; white space inside one is a single space."""
    out: list[Block] = []
    #: name, dropped, boilerplate, in an article
    stack: list[tuple[str, bool, bool, bool]] = []
    #: places in the stack of each name, and of the names that stand in the way of an end tag: however deep, none is sought
    where: defaultdict[str, list[int]] = defaultdict(list)
    edges: dict[frozenset[str], list[int]] = {BLOCK_TAGS: [], _HOLDS: []}
    parts: list[str] = []
    linked, heading = 0, ("h1", "h2", "h3", "h4", "h5", "h6")

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            top = stack[-1] if stack else ("", False, False, False)
            out.append(Block(text, len(text.split(" ")), linked, top[2], top[3], any(s[0] in heading for s in stack[-3:])))
        linked = 0

    def close(tag: str, barrier: frozenset[str]) -> None:
        """Close the innermost open element of a name, unless one of the barrier is inside it."""
        places, inside = where[tag], edges.get(barrier, ())
        if not places or inside and inside[-1] > places[-1]:
            return
        for k in range(len(stack) - 1, places[-1] - 1, -1):
            where[stack.pop()[0]].pop()
            for edge in edges.values():
                if edge and edge[-1] == k:
                    edge.pop()

    at, last, loose = 0, html.rfind(">"), False
    while at < len(html):
        if at > last and _OPENS.match(html, at):  # no tag ends any more: the rest is text
            m, at, text, tag = None, len(html), html[at:], None
        else:
            m = (_LOOSE if loose and _OPENS.match(html, at) else _TOKEN).match(html, at)
            if m["text"] == "<" and not loose and _OPENS.match(html, at):
                loose = True  # quotes that do not close here close nowhere after it
                continue
            at, text, tag = m.end(), m["text"], m["tag"]
        if text is not None:
            if not (stack and stack[-1][1]):
                if "&" in text:
                    text = unescape(_TOO_LARGE.sub("\ufffd", text))
                parts.append(text)
                if where["a"]:
                    linked += len(text.split())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if block:
            flush()
        elif tag in ("br", "img", "wbr"):
            parts.append(" " if tag != "wbr" else "")
        if m["close"]:
            close(tag, _NOTHING if block else BLOCK_TAGS)  # an inline end tag closes nothing beyond its block
            continue
        attrs = m["attrs"]
        if tag in RAW_TAGS:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID_TAGS or attrs.rstrip().endswith("/") and not block and tag != "a":
            continue
        if tag == "a":  # links do not nest
            close("a", _NOTHING)
        for ends in _IMPLIED_END.get(tag, ()):
            close(ends, _HOLDS)
        _, dropped, boiler, article = stack[-1] if stack else ("", False, False, False)
        marked, hidden = _marks(attrs) if attrs else (False, False)
        inside = article or tag in ("article", "main")
        body = tag in ("html", "body", "article", "main")  # a page's or article's own marks say nothing about its text
        boiler = boiler or tag in BOILER_TAGS or (tag == "header" and not article) or (marked and not body and not (article and tag == "header"))
        where[tag].append(len(stack))
        for names, edge in edges.items():
            if tag in names:
                edge.append(len(stack))
        stack.append((tag, dropped or hidden or tag in DROPPED_TAGS, boiler, inside))
    flush()
    return out


FEATURES = ("boiler", "article", "heading", "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "page_has_article", "longest")


def features(page: list[Block]) -> np.ndarray:
    density = [b.linked / b.words for b in page]
    marked = any(b.article for b in page)
    longest = max((b.words for b in page), default=0)
    rows = []
    for k, b in enumerate(page):
        before, after = k - 1, k + 1
        rows.append(
            [b.boiler, b.article, b.heading, b.words, min(1.0, density[k])]
            + ([page[before].words, min(1.0, density[before])] if before >= 0 else [0, 0])
            + ([page[after].words, min(1.0, density[after])] if after < len(page) else [0, 0])
            + [marked, longest]
        )
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


#: Labelled pages, made for this purpose. A block is its word count, after a slash how many are
#: linked (none if left out), then marks: b boilerplate by its elements, a inside an article
#: element, h heading, + article text. A line is a page; neighbours follow from it.
LABELLED = """
1/1b,1/1b,2/2b,1/1b,8b,9ah+,70a+,4a+,120a+,35a+,12/1a+,14b
2/2b,3/3b,9,9ah+,30a+,1a+,2a+,6/6a+,25/15a+,3ah+,45a+,10ab,25ab,40/4ab,20
12,4/4b,1/1b,5ah+,7a+,90a+,2abh,18ab,30ab,3bh,22b,3/3b,11b
30,1/1,2/2,4h,16,8a+,14a+,9a+,45,28,35
6/6,4,33,9a+
5/5b,1/1b,16,60,12ah+,80a+,22/3a+,3a+,5h,60,28,9b
22/2,9,2/2,24,11ah+,40a+,8a+,55a+,70,3h,33,4/4,5/5,26/2
3/3b,20b,6ah+,6/6a+,5/5a+,50a+,28ab,3h,61,8b
35b,28b,7h+,60+,85+,40+,61b,3b,20b
2,1/1,3ah+,5a+,4
8,4ah+,6a+,10a+,7
3,2a+,3a+,2
5,1,14a+,12,13
14,10a+,12a+,13,6,9
9,7ah+,30a+,20a+,12,15
11,8ah+,20a+,9,10,6,7
20,10a+,40a+,22,21,18,12
12,24,38a+,16,15,23,9
24,13,9h,6ah+,60a+,14,9,5h,23,12
3/3,7h,20,9ah+,60a+,6h,14,7h,12,8
6h,9,12ah+,16a+,7h,8
1/1,1/1,2/2,1/1,9h+,60+,85+,40+,3h+,70+,55+,4/4,5/5,6/6,8
2/2,3/3,2/2,1/1,1/1,7h+,45+,120/4+,33+,90+,2h,5/5,6/6,7/7,9,2/2,3/3
22,1/1,2/2,2/2,1/1,8h+,75+,64+,18+,50+,3/3,2/2,4/4
18,1,3/3,2/2,3/3,11h+,140+,35+,60+,12/1
1/1,2/2,3/3,6h+,52+,38+,71+,2h,2,24,2,17,3,31,2,12,2/2,1/1,9
2/2,2/2,1/1,10h+,88+,66+,45+,3h,2,3,20,2,3,35,2,3,11,4/4,3/3
1,1,2,1,2,8h+,40+,66+,58+,31+,1,2,1,3
2,1,1,3,2,1,7h+,99+,120+,43+,80+,2,2,10
3/3,4/4,2/2,5h+,44+,4h+,51+,60+,5h+,39+,72+,12/10,15/12,10/10
1/1,1/1,8h+,65+,25/14+,80+,30/8+,44+,11/11,9/9,13/13,12/12,7
20/5,2/2,9h+,35+,28+,33+,47+,26+,3/3,8/8,20/16,18/15,14
4/4,2/2,6h+,9+,50+,8+,60+,7+,55+,2/2,2/2,3/3,10
2/2,1/1,12h+,30+,16+,28+,14+,40+,22+,35+,5/5,4/4,5/5,16
7h+,60+,44+,90+,38+,15+
9h+,25+,70+,6+,33+
5+
9+,20+,12+,40+
11+,5+,5+
35+,20+,50+
90+
1+
4+
2+,1+
1+,1+
3+,4+
1+,2+,1+
6+,2+,5+
1/1,1/1,1/1,1/1,2/2,3/3,4/4,2/2
2/2,5/5,12/10,40+,55+,9/8,3/3,2/2
14,2/2,2/2,3/3,41+,62+,58+,2,15,2,22,2,9,3/3,8
3,2/2,1,16/16,20/18,17/17,8/8,5
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the labelled pages.

    Pages without marks come again with them, since marks say more than any shape: an article
    element around the article text, one around the whole page, and boilerplate marks on all of
    it, inside an article element or not.
    """
    x, y = [], []

    def add(page: list[tuple[int, int, bool, bool, bool, bool]]) -> None:
        x.append(features([Block("", *block[:5]) for block in page]))
        y.extend(float(block[5]) for block in page)

    for line in LABELLED.split():
        page = [(int(n), int(linked or 0), "b" in marks, "a" in marks, "h" in marks, bool(kept)) for n, linked, marks, kept in re.findall(r"(\d+)(?:/(\d+))?([bah]*)(\+?)", line.replace(",", " "))]
        add(page)
        if not any(boiler or article for _, _, boiler, article, _, _ in page):
            add([(n, linked, False, kept, heading, kept) for n, linked, _, _, heading, kept in page if any(block[5] for block in page)])
            add([(n, linked, False, True, heading, True) for n, linked, _, _, heading, _ in page])
            add([(n, linked, True, True, heading, False) for n, linked, _, _, heading, _ in page])
            add([(n, linked, True, False, heading, False) for n, linked, _, _, heading, _ in page])
    return np.concatenate(x), np.array(y)


class Tree:
    """Binary classification tree by Gini impurity; equal splits go to the earlier feature and lower threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12):
        self.share = float(y.mean())
        self.feature = None
        if depth == 0 or self.share in (0.0, 1.0):
            return
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                p, q = y[left].mean(), y[~left].mean()
                cost = left.sum() * p * (1 - p) + (~left).sum() * q * (1 - q)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, cut)
        if best is None or best[0] >= len(y) * self.share * (1 - self.share) - 1e-12:
            return
        _, self.feature, self.cut = best
        left = x[:, self.feature] <= self.cut
        self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.share >= 0.5)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x), dtype=bool)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


@lru_cache(maxsize=1)
def classifier() -> Tree:
    return Tree(*labelled())


def main_text(html: str) -> str:
    page = blocks(html)
    if not page:
        return ""
    keep = classifier().predict(features(page))
    return "\n".join(b.text for b, k in zip(page, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html give an empty text. Pages are read one by one: repeats agree, null ids
    and urls pass through, other columns are not read.
    """
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, target.field(2).type)], schema=target)

    return spread(pages.select("page_id", "url", "html")).mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))
