"""Main text of web pages from text-to-tag ratios.

The events of the standard library's streaming parser are turned into lines, one per block element.
Each line has its text and the number of tags met since the line before; the ratio of characters to
tags is high in running text and low in menus and link lists. Ratios are smoothed with a Gaussian, so that
a short paragraph among long ones stays with them, and a threshold (a part of the ratios' standard
deviation) separates content from the rest. Lines are grouped into regions by the element that
holds them (an article or main element with all it contains, else the nearest container). Where a line
of an article or main element passes the threshold, all such elements are the content. Otherwise it
is every region with a line that passes, whole, all visible lines from the first line that passes
to the last (lists, tables and quotations in the text), and the article and main elements; where there is
none of these, the region with the most text.

Elements that are never content, by tag or role, have ratio 0 and no text: menus, headers and footers of the page,
side bars, scripts, styles, hidden elements and reader comments. So do elements that a name in class or id
marks as a notice, an advert, a side bar and the like, and forms, but these only if they hold less than `MOST` of the
text left: a mark is no verdict on the body of a page. A name counts as a whole, or by its first or last part
("sidebar-left", "cookie-notice"); names of states ("no-sidebar", "comments-open") do not count. Outside of
article and main elements, lists and tables of little but links are menus.

- A null page, an empty one and one without visible text give an empty text.
- Character references are decoded; white space in a block becomes one space; blocks are joined by a
  newline. A line break element is white space.
- Broken nesting, unclosed and unknown elements are accepted; pages of any length are read whole.
- A null `page_id` or `url` and repeated rows are passed through; extra columns are ignored.
- An empty table gives an empty result.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# Share of a page's text from which a marked element is content after all, and of links that make a list a menu.
MOST, LINKS = 0.5, 0.8
SIGMA = 1.5  # lines
THRESHOLD = 0.5  # standard deviations
# Characters that are fed to the parser at a time.
FEED = 1 << 16

# Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "option p pre section summary table tbody tfoot thead title tr ul".split()
)
# Elements that hold others and whose end tags matter.
CONTAINERS = frozenset(
    "article aside blockquote body button canvas center details dialog div dl fieldset figure footer form "
    "header iframe main menu nav noscript object ol script section select style svg table template "
    "textarea title ul".split()
)
ROOTS = frozenset(("article", "main"))
NEVER = frozenset(
    "aside button canvas dialog footer iframe menu nav noscript object script select style svg "
    "template textarea title".split()
)
# Words of class, id and role attributes.
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies disclaimer disqus footer login menu modal nav "
    "navbar navigation newsletter notice notices pagination popup promo promoted related respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
PAGE_WORDS = frozenset(("header", "masthead"))
COMMENT_WORDS = frozenset(("comment", "comments", "disqus", "respond"))
# Parts of names that tell the state of something else on the page.
STATE_WORDS = frozenset("no has with without open opened closed enabled disabled on off is not hide show".split())
LISTS = frozenset("ul ol dl table".split())
SPACED = frozenset(("br", "td", "th", "img", "input", "wbr"))
_PARTS = re.compile(r"[-_:.]+")
_CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def marks(names: str) -> set[str]:
    """The words that the names of a class or id attribute mark an element with."""
    found = set()
    for name in names.split():
        parts = [part for part in _PARTS.split(_CAPITAL.sub("-", name).lower()) if part]
        if parts and not STATE_WORDS & set(parts):
            found |= {parts[0], parts[-1]}
    return found


class PageLines(HTMLParser):
    """Lines of a page: text, tags since the line before, region, marked elements around; hidden ones have
    no text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple[int, ...]]] = []
        self.roots: set[int] = set()
        self.lists: set[int] = set()
        self.linked: dict[int, int] = {}  # characters of links by region
        self.links = 0  # open link elements
        self.marked = 0
        self.regions = 0
        self.parts: list[str] = []
        self.tags = 0
        # Open containers: tag, hidden, region, whether inside an article or main element, marked ones around.
        self.open: list[tuple[str, bool, int, bool, tuple[int, ...]]] = [("", False, 0, False, ())]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag in SPACED and tag != "wbr":
            self.parts.append(" ")
        if tag == "a":
            self.links = 1  # links do not nest
        if tag in CONTAINERS:
            self.links = 0 if tag in LISTS else self.links
            if tag == "body" and len(self.open) > 1:
                return
            self._enter(tag, dict(attrs))

    def handle_startendtag(self, tag, attrs):
        # In HTML a slash does not close an element; foreign elements have no text of their own.
        if tag in CONTAINERS and tag not in ("svg", "canvas", "object", "iframe"):
            self.handle_starttag(tag, attrs)
        elif tag in BLOCKS:
            self.end_line()
            self.tags += 1
        else:
            self.tags += 1
            if tag in SPACED and tag != "wbr":
                self.parts.append(" ")

    def _enter(self, tag: str, attrs: dict[str, str | None]) -> None:
        parent, hidden, region, inside, around = self.open[-1]
        roles = set((attrs.get("role") or "").lower().split())
        words = marks(attrs.get("class") or "") | marks(attrs.get("id") or "")
        main = tag in ROOTS or "main" in roles or "articlebody" in (attrs.get("itemprop") or "").lower()
        if main and parent == "form":
            # The form goes round the article.
            around = around[:-1]
        if tag in NEVER or (tag == "header" and not inside) or roles & NEVER_WORDS:
            hidden = True
        elif words & COMMENT_WORDS and tag != "body":
            hidden = True
        elif tag == "form" or (
            not main and tag != "body" and (words & NEVER_WORDS or (words & PAGE_WORDS and not inside))
        ):
            self.marked += 1
            around = (*around, self.marked)
        if "hidden" in attrs or _HIDDEN.search((attrs.get("style") or "").lower()):
            hidden = True
        if not inside:
            self.regions += 1
            region = self.regions
            if main:
                self.roots.add(region)
            elif tag in LISTS:
                self.lists.add(region)
        self.open.append((tag, hidden, region, inside or main, around))

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in CONTAINERS:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.links = 0
        if tag in CONTAINERS:
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at][0] == tag:
                    del self.open[at:]
                    break

    def handle_data(self, data):
        if not self.open[-1][1]:
            self.parts.append(data)
            if self.links:
                region = self.open[-1][2]
                self.linked[region] = self.linked.get(region, 0) + len("".join(data.split()))

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text or self.tags:
            self.lines.append((text, self.tags, self.open[-1][2], self.open[-1][4]))
            self.tags = 0

    def visible(self) -> list[tuple[str, int, int]]:
        """The lines, without the text of marked elements that are not most of the page and of menus."""
        total, of_marked, of_region = 0, {}, {}
        for text, _, region, around in self.lines:
            size = len(text) - text.count(" ")
            total += size
            of_region[region] = of_region.get(region, 0) + size
            for mark in around:
                of_marked[mark] = of_marked.get(mark, 0) + size
        gone = {mark for mark, size in of_marked.items() if size < MOST * total}
        menus = {region for region in self.lists if self.linked.get(region, 0) >= LINKS * of_region.get(region, 0) > 0}
        return [
            ("" if region in menus or not gone.isdisjoint(around) else text, tags, region)
            for text, tags, region, around in self.lines
        ]


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """The ratios after a Gaussian filter that renormalises at the ends."""
    reach = int(np.ceil(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    total = np.convolve(ratios, kernel, "same") if len(ratios) > len(kernel) else None
    if total is None:
        total = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
        weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    else:
        weight = np.convolve(np.ones(len(ratios)), kernel, "same")
    return total / weight


def main_text(html: str | None) -> str:
    """The main text of one page."""
    page = PageLines()
    for start in range(0, len(html or ""), FEED):
        page.feed(html[start : start + FEED])
    page.close()
    page.end_line()
    every = page.visible()
    lines = [line for line in every if line[0]]
    if not lines:
        return ""
    ratios = smoothed(np.array([len(text) / max(1, tags) for text, tags, _ in every]))
    threshold = THRESHOLD * ratios.std()
    passing = [at for at, (line, ratio) in enumerate(zip(every, ratios)) if line[0] and ratio >= threshold]
    content = {every[at][2] for at in passing}
    roots = page.roots & {region for _, _, region in lines}
    if content & roots:
        chosen, between = roots, range(0)
    else:
        chosen = content | roots
        between = range(passing[0], passing[-1]) if passing else range(0)
    if not chosen:
        size: dict[int, int] = {}
        for text, _, region in lines:
            size[region] = size.get(region, 0) + len(text)
        chosen = {max(size, key=lambda region: (size[region], -region))}
    kept = (text for at, (text, _, region) in enumerate(every) if text and (region in chosen or at in between))
    return "\n".join(kept)


def extract_text(pages: DataFrame) -> DataFrame:
    """`(page_id, url, text, n_chars)` of each page."""

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(text) for text in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    return pages.select("page_id", "url", "html").mapInArrow(extract, schema)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
