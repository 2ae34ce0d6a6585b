"""Main text of web pages: text-to-tag ratio per line, smoothed and clustered.

The standard library's streaming parser gives events; every block of a page is a line with its text,
its number of tags and the elements around it. Lines whose smoothed ratio of text to tags reaches the
threshold form the content cluster, and the innermost element that holds all of that cluster is the content
region, or the article or main element around it, or the container that adds but headings and paragraphs. All lines of the
region that are not navigation, notices, adverts, forms or comments are the main text, so a short paragraph within an article
is kept. Words of class, id and role mark an element only if a name consists of nothing but such words (``ad-box``, not
``side-by-side``); other names that hold one count at the edges of a region that no article or main element bounds. Ids never
mark headings and paragraphs. Lists and lines of short links are menus wherever they stand.

Elements are numbered as they open and know the last number inside them, so what lies in an element is a range of numbers and
a page takes time in proportion to its length, whatever the depth.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

# Elements of HTML by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style head title noscript template iframe object embed svg math canvas audio video select option datalist textarea button".split())
ASIDE = frozenset("nav header footer aside form menu dialog search fieldset".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role that mark what is not the main text.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion popup modal overlay cookie "
    "cookies consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations sidebar side rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs pager pagination "
    "header masthead footer colophon copyright disclaimer comment comments commentlist disqus respond reply replies reviews "
    "complementary contentinfo search toolbar skip".split()
)
# Words that go with those and say nothing by themselves.
NEUTRAL = frozenset(
    "area bar block bottom box button buttons center col column container content cta form global group header holder inner item items "
    "left link links list local main module outer page pane panel post posts primary right row section secondary site slot small sticky "
    "tertiary title top unit wrap wrapper".split()
)
_OWN = frozenset("entry post article story content title".split())  # what stands before the header of an article itself
_RIGHTS = re.compile(r"(©|\(c\)|copyright\b)(?=.*(\d{4}|reserved))|all rights reserved", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
#: An open <p> ends where one of these begins; likewise for list items, cells and rows.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIGMA = 1.0


@dataclass
class Line:
    element: int  # innermost block
    aside: bool
    doubtful: bool
    tag: str = ""
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    links: int = 0
    linked: int = 0  # characters within links
    text: str = ""


@dataclass
class _Open:
    tag: str
    number: int
    hidden: bool
    aside: bool
    doubtful: bool
    block: int
    block_tag: str


class _Lines(HTMLParser):
    """Collects the lines of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Open("", 0, False, False, False, 0, "")
        self.open: list[_Open] = []
        self.kinds: Counter[str] = Counter()  # open elements by tag
        self.parent = [0]  # block around each element
        self.last = [0]  # last number within each element
        self.articles: set[int] = set()  # numbers of article and main elements
        self.lines: list[Line] = []
        self.line: Line | None = None

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are of no use here."""
        return j

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Any ``<![...>`` is a comment up to the next ``>``, as in browsers; the standard parser raises on unknown names."""
        return self.parse_bogus_comment(i, report)

    def _top(self) -> _Open:
        return self.open[-1] if self.open else self.root

    def _break(self) -> None:
        self.line = None

    def _line(self) -> Line:
        if self.line is None:
            top = self._top()
            self.line = Line(top.block, top.aside, top.doubtful, top.block_tag)
            self.lines.append(self.line)
        return self.line

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            if self.kinds["p"]:
                self._close("p", until=BLOCKS - {"p"})
            for other in _CLOSES.get(tag, ()):
                self._close(other, until={"ul", "ol", "dl", "table", "select"})
            self._break()
        top = self._top()
        hidden, aside, doubtful = top.hidden, top.aside, top.doubtful
        if not aside and not hidden:
            marked, maybe = self._marked(tag, attrs)
            aside, doubtful = tag in ASIDE or marked, doubtful or maybe
        hidden = hidden or tag in HIDDEN
        if not hidden:
            line = self._line()
            line.tags += 1
            line.links += tag == "a"
        if tag not in VOID:
            number = len(self.last)
            block = (number, tag) if tag in BLOCKS else (top.block, top.block_tag)
            self.open.append(_Open(tag, number, hidden, aside, doubtful, *block))
            self.parent.append(top.block)
            self.last.append(number)
            self.kinds[tag] += 1
            if tag in ("article", "main"):
                self.articles.add(number)
        elif tag == "br" and not hidden:
            self._line().parts.append(" ")
        if tag in BLOCKS:
            self._break()

    def _marked(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether the element is marked as no part of the text, and whether it may be."""
        if tag in ("html", "body", "main", "article"):
            return False, False
        maybe = False
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True, False
            if value and (name in ("class", "role") or (name == "id" and tag not in PROSE)):
                for token in _CAMEL.sub(r"\1-\2", value).lower().split():
                    words = set(_PART.findall(token))
                    if words & MARKS:
                        own = "header" in words and words & _OWN and not words & (MARKS - {"header"})
                        if words <= MARKS | NEUTRAL and not own:
                            return True, False
                        maybe = maybe or not own
        return False, maybe and tag not in PROSE

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self, tag: str, until: frozenset[str] | set[str] = frozenset()) -> None:
        if not self.kinds[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                for x in self.open[i:]:
                    self.last[x.number] = len(self.last) - 1
                    self.kinds[x.tag] -= 1
                del self.open[i:]
                return
            if self.open[i].tag in until:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._break()
        # an inline end tag never closes a block, and a paragraph's end no container
        stop = BLOCKS if tag not in BLOCKS else {"article", "main", "body", "table"} - {tag} if tag not in ("html", "body", "article", "main", "table") else frozenset()
        self._close(tag, stop)

    def handle_data(self, data: str) -> None:
        if not self._top().hidden:
            line = self._line()
            line.parts.append(data)
            if self.kinds["a"]:
                line.linked += len(_SPACE.sub(" ", data).strip())

    def close(self) -> None:
        super().close()
        for x in self.open:
            self.last[x.number] = len(self.last) - 1


_REACH = 2
_KERNEL = np.exp(-np.arange(-_REACH, _REACH + 1) ** 2 / (2 * SIGMA**2))


def _smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian mean of each value and its neighbours; at the ends of those that exist."""
    n = len(values)
    return np.convolve(values, _KERNEL)[_REACH : _REACH + n] / np.convolve(np.ones(n), _KERNEL)[_REACH : _REACH + n]


#: Characters of a link in a menu, on the mean, and the share of a menu's characters that are in links.
MENU_LINK, MENU_SHARE = 40, 0.8


def _menus(lines: list[Line], parent: list[int]) -> set[int]:
    """Ids of the lines that make menus: lists, and single lines other than headings and paragraphs, of short links."""
    groups: dict[tuple[bool, int], list[Line]] = {}
    for i, x in enumerate(lines):
        if x.links and x.tag not in PROSE or x.tag == "li":
            groups.setdefault((True, parent[x.element]) if x.tag == "li" else (False, i), []).append(x)
    out = set()
    for group in groups.values():
        size, links, linked = (sum(v) for v in zip(*((len(x.text), x.links, x.linked) for x in group)))
        if links > 1 and links >= len(group) and linked >= MENU_SHARE * size and linked <= MENU_LINK * links:
            out.update(id(x) for x in group)
    return out


def _region(parser: _Lines, body: list[Line], cluster: list[Line]) -> int:
    """Number of the element that holds the main text; 0 for the whole page."""
    first, last = min(x.element for x in cluster), max(x.element for x in cluster)
    # the elements around all of the cluster, the innermost first
    around, n = [], cluster[0].element
    while n:
        if n <= first and last <= parser.last[n]:
            around.append(n)
        n = parser.parent[n]
    every = np.sort([x.element for x in body])
    other = np.sort([x.element for x in body if x.tag not in PROSE])
    inside = lambda at, n: int(np.searchsorted(at, parser.last[n], "right") - np.searchsorted(at, n))
    # a part of an article stands for the whole article
    for n in around:
        if n in parser.articles:
            return n
    # one block alone is no region
    region = next((n for n in around if inside(every, n) > 1), 0)
    # a container whose other blocks are headings and paragraphs is the wider article
    for n in around[around.index(region) + 1 :] if region else ():
        if inside(other, n) > inside(other, region):
            break
        region = n
    return region


def main_text(html: str | None) -> str:
    """The main text of one page: blocks in page order, one per line; empty if there is none.

    Null and empty pages give an empty text. White space inside a block, line breaks too, becomes one space. Time and memory
    grow with the length of the page, for very long and very deep ones too.
    """
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    lines = []
    for line in parser.lines:
        line.text = _SPACE.sub(" ", "".join(line.parts)).strip()
        if line.text:
            lines.append(line)
    menus = _menus(lines, parser.parent)
    body = [x for x in lines if not x.aside and id(x) not in menus]
    if not body:
        return ""
    # a line that is left out has no text; it still parts what is before it from what is after
    ratio = np.array([0.0 if x.aside or id(x) in menus else len(x.text) / max(1, x.tags) for x in lines])
    smooth = _smooth(ratio)
    threshold = smooth.std()
    cluster = [x for x, s in zip(lines, smooth) if s >= threshold and not x.aside and id(x) not in menus] or body
    region = _region(parser, body, cluster)
    found = [x for x in body if not region or region <= x.element <= parser.last[region]]
    where = {id(x): i for i, x in enumerate(found)}
    start, end = where[id(cluster[0])], where[id(cluster[-1])]
    if region not in parser.articles:
        # at the edges doubtful names decide, and a notice of rights may follow the text
        found = [x for i, x in enumerate(found) if start <= i <= end or not (x.doubtful or i > end and _RIGHTS.match(x.text))]
    return "\n".join(x.text for x in found)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page; other columns are ignored, repeated rows treated alike."""
    schema = T.StructType(
        [pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def batches(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in frames:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=schema.names)

    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(batches, schema)
