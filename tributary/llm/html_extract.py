"""Main-text extraction from HTML by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: the text of one block with its number of tags and of
characters inside links. Elements whose tag, class, id or role names boilerplate (scripts, styles, menus, headers and
footers of the page, asides, forms, notices, adverts, comments, hidden elements) give no lines. The text-to-tag ratio of
each line is smoothed with a Gaussian over its neighbours, and a one-dimensional two-means clustering of the logarithms
of the smoothed ratios separates content lines from the rest.

Regions are elements in which content lines have a large share of the text: of article and main elements that name
themselves content a twentieth is asked, of any other element half. If the article and main elements so found hold at
least half of all content text, they are the regions; else the largest other elements join them. The text is all lines
of the regions but those that are mostly links and have fewer than ``SENTENCE`` words; of these, content lines stay that
are headings or stand between two other content lines. So a menu without a name goes, and linked sentences, lists of
linked sources, and a linked heading, which its neighbours lift, stay. A page without regions gives its lines that are
not such links.

White space inside a block becomes one space, blocks are joined in page order by one space; short blocks of a region are
kept. Character references are decoded. Time and memory grow linearly with the page, however deep it nests.

Defined results: null or empty html, or a page without content, gives an empty text; an element left open reaches to the
end of its parent; a tag that the page's end cuts, or that a missing quote lets run to there, is dropped up to the next
angle bracket, and so are the tags after it; comments and declarations that don't end take all of the rest; repeated rows give a row each; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: Least share of content lines in the text of a region: of elements that name themselves content, and of others.
NAMED_SHARE, SHARE = 0.05, 0.5
#: Words from which on a line of links is not taken for an entry of a menu.
SENTENCE = 5

# Fixed values of HTML: elements without content, elements that break a line, and those whose text is never content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
SILENT = set(
    "script style noscript template head title iframe object svg math canvas audio video button select textarea form nav "
    "aside footer menu dialog search label fieldset".split()
)
#: Words in class, id or role that name boilerplate, those that do so only outside an article, and words that may stand
#: beside them: a name counts only if it has no other word, so that ``legal-analysis`` is content.
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo "
    "cookie cookies disqus footer gdpr hidden legal login masthead menu modal nav navbar navigation navigator newsletter "
    "notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets "
    "complementary dialog alert announcement paywall".split()
)
#: Elements of running text, and names that don't make those boilerplate inside an article.
PROSE = set("p li dd dt blockquote pre figcaption td th h1 h2 h3 h4 h5 h6 b i em strong span".split())
WEAK = set("legal related notice notices announcement alert message search reply replies respond login social promo recommended widget popup overlay pager".split())
OUTSIDE = {"header", "head", "site", "top", "bottom", "tags"}
BESIDE = set(
    "area articles bar block body bottom box button buttons card cards center column container content dark desktop fixed "
    "form grid group header hero icon icons id inline inner item items js label large layout left light link links list "
    "main media message mobile module news outer page panel popular post posts primary print reader readers right row "
    "secondary section sections site slot small sticky stories story strip tags text thread title top unit user users "
    "view wrap wrapper zone".split()
)
_NAMES = re.compile(r"[a-z]+")
#: A start tag of the first set ends an open element of the second set (fixed values of HTML).
ENDS_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend", "li", "dd", "dt", "option", "figcaption", "summary"}
SELF_ENDING = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
KEEPS_P = ("td", "th", "button", "object")
_EDGE = re.compile("[<>]")
_SHORT_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^<>]*)")
_SHORT_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*["']?([^"'\s<>]*)""")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _is_boilerplate(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    if tag in SILENT or tag == "header" and not in_article:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or ""):
        return True
    if tag in ("html", "body", "main"):
        return False
    if in_article and tag in PROSE:
        naming = BOILERPLATE - WEAK
    else:
        naming = {"comment", "comments", "ad", "advert", "advertisement", "sponsored", "promo", "related"} if tag == "article" else BOILERPLATE if in_article else BOILERPLATE | OUTSIDE
    for said in (x for key in ("class", "id", "role") for x in (attrs.get(key) or "").lower().split()):
        words = set(_NAMES.findall(said))
        if words & naming and words <= BOILERPLATE | OUTSIDE | BESIDE and not re.match(r"(has|with|no|without)[-_]", said):
            return True
    return False


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    linked: int
    element: int
    heads: bool  # a heading

    @property
    def is_links(self) -> bool:
        """Mostly links, and too short for a sentence or a title."""
        return 2 * self.linked > len(self.text) and self.text.count(" ") < SENTENCE - 1


class Lines(HTMLParser):
    """Collects the lines of a page that are not inside boilerplate, and the tree of its elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        #: Open elements (tag, inside boilerplate, inside an article, number), and where each tag is among them.
        self.stack: list[tuple[str, bool, bool, int]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        #: Whether the page has been read to its end, and a tag did not end before.
        self.final = self.broken = False
        #: Of each element, 0 being the page: its parent, and whether it names itself content.
        self.parent, self.named = [0], [False]

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.stack[-1][3] if self.stack else 0, self._open(*HEADINGS) >= 0))
            self.tags = self.linked = 0
        self.parts = []

    def _open(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def _pop_to(self, k: int) -> None:
        if any(tag in BLOCK for tag, *_ in self.stack[k:]):
            self._end_line()
        for tag, *_ in self.stack[k:]:
            self.places[tag].pop()
        del self.stack[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self._end_line()
        if tag in ENDS_P and (at := self._open("p")) >= 0 and self._open(*KEEPS_P) < at:
            self._pop_to(at)
        if tag in SELF_ENDING:
            at = self._open("dd", "dt") if tag in ("dd", "dt") else self._open(tag)
            if at >= 0 and self._open(*SELF_ENDING[tag]) < at:
                self._pop_to(at)
        _, silent, in_article, up = self.stack[-1] if self.stack else ("", False, False, 0)
        self.tags += not silent
        if tag == "br" and not silent:
            self.parts.append(" ")
        if tag in VOID:
            return
        silent = silent or _is_boilerplate(tag, dict(attrs), in_article)
        self.parent.append(up)
        self.named.append(tag in ("article", "main"))
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, silent, in_article or tag == "article", len(self.parent) - 1))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = self._open(tag)
        self.tags += at >= 0 and not self.stack[-1][1]
        if at >= 0:
            self._pop_to(at)
        elif tag == "p":
            self._end_line()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][1]:
            return
        self.parts.append(data)
        if self.places["a"]:
            self.linked += len(data.strip())

    def close(self) -> None:
        self.final = True
        super().close()
        self._end_line()

    # Markup that the page's end cuts. The parser would try each further tag up to the end of the page again.

    def parse_starttag(self, i: int) -> int:
        k = -1 if self.broken else super().parse_starttag(i)
        if k < 0 and self.final:
            self.broken = True
            return self._short_tag(i)
        return k

    def parse_endtag(self, i: int) -> int:
        if self.broken and not self.cdata_elem:
            return self._short_tag(i)
        return self._or_end(super().parse_endtag(i))

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._or_end(super().parse_comment(i, report))

    def parse_pi(self, i: int) -> int:
        return self._or_end(super().parse_pi(i))

    def parse_html_declaration(self, i: int) -> int:
        """Comments, CDATA sections, and declarations of any kind, which give nothing."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        at = self.rawdata.find(end, i + 2)
        return self._or_end(at + len(end) if at >= 0 else -1)

    def _or_end(self, k: int) -> int:
        """What does not end until the page does takes all of its rest."""
        return len(self.rawdata) if k < 0 and self.final else k

    def _short_tag(self, i: int) -> int:
        """Once a tag has not ended, tags end at the next angle bracket, whatever their quotes; one that meets another
        tag's beginning, or the page's end, is dropped."""
        edge = _EDGE.search(self.rawdata, i + 1)
        if edge is None or edge[0] == "<":
            return edge.start() if edge else len(self.rawdata)
        tag = _SHORT_TAG.match(self.rawdata, i, edge.start())
        if tag:
            name = tag[2].lower()
            if tag[1]:
                self.handle_endtag(name)
            else:
                self.handle_starttag(name, [(k.lower(), v) for k, v in _SHORT_ATTRIBUTE.findall(tag[3])])
                if name in self.CDATA_CONTENT_ELEMENTS:
                    self.set_cdata_mode(name)
        return edge.end()


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters outside links per tag, of each line."""
    return np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines], float)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    weight = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weight


def content_lines(values: np.ndarray, rounds: int = 20) -> np.ndarray:
    """True for the upper of two clusters of log ratios; all true if the values hardly differ."""
    x = np.log1p(values)
    low, high = x.min(), x.max()
    if high - low < np.log(4):
        return np.ones(len(x), bool)
    for _ in range(rounds):
        upper = x > (low + high) / 2
        new = x[~upper].mean(), x[upper].mean()
        if new == (low, high):
            break
        low, high = new
    return x > (low + high) / 2


def regions(lines: list[Line], content: np.ndarray, parent: list[int], named: list[bool]) -> np.ndarray:
    """For each element whether it is, or is inside, a region."""
    n = len(parent)
    good, whole = np.zeros(n), np.zeros(n)
    for line, is_content in zip(lines, content.tolist(), strict=True):
        whole[line.element] += len(line.text)
        good[line.element] += (len(line.text) - line.linked) * is_content
    for e in range(n - 1, 0, -1):  # a parent has a smaller number
        whole[parent[e]] += whole[e]
        good[parent[e]] += good[e]
    says = np.array(named)
    found = says & (good > 0) & (good >= NAMED_SHARE * whole)
    inside, held = found.copy(), 0.0
    for e in range(1, n):
        held += good[e] * (found[e] and not inside[parent[e]])
        inside[e] |= inside[parent[e]]
    if 2 * held < good[0] or not held:
        holds = np.zeros(n, bool)  # elements around a region that names itself take no lines beside it
        for e in range(n - 1, 0, -1):
            holds[parent[e]] |= holds[e] | inside[e]
        inside |= (good > 0) & (good >= SHARE * whole) & ~holds
        for e in range(1, n):
            inside[e] |= inside[parent[e]]
    return inside


def extract(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    content = content_lines(smooth(ratios(lines)))
    inside = regions(lines, content, parser.parent, parser.named)
    text = np.array([not x.is_links for x in lines])
    beside = np.concatenate(([False], content & text, [False]))
    between = beside[:-2] & beside[2:]
    good = inside[[x.element for x in lines]] & (text | content & (between | [x.heads for x in lines]))
    kept = [lines[k].text for k in np.flatnonzero(good)]
    return " ".join(kept or [x.text for x in lines if not x.is_links])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = batch["html"].map(lambda x: extract(x if isinstance(x, str) else None)).astype(object)
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text})

    picked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    out = picked.mapInPandas(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
