"""Main-text extraction: streaming parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser turns a page into lines, one for each block of text, with the number of tags it took, whether a
menu, header, footer, sidebar, notice, advert, form or comment section holds it, and its place among the page's containers. The
text-to-tag ratios of the lines are smoothed with a Gaussian window; lines above a threshold, a share of the ratios' standard deviation,
are seeds. Seeds with few lines between them form clusters, and clusters of little text go. The content region is what holds the clusters:
from the page downwards, the container with nearly all of their text; there, all from the first to the last of its parts of which a line reaches the threshold by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of an article.
DROPPED = frozenset("aside audio button canvas datalist dialog footer form head iframe input label menu nav noscript object option script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split())
NAMES = re.compile(
    r"^(ads?|advert\w*|adsense|banner|breadcrumbs?|byline|captcha|comments?|commentlist|consent|cookies?|disclaimer|disqus|footer|footnav|gdpr|header|hidden|login|masthead|menu|menus|modal|nav|navbar|navigation|newsletter|notices?|notification|overlay|pager|pagination|popup|promo\w*|recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar|sidebars|signup|sitemap|skip|social|sponsor\w*|subscribe|subscription|teaser|toc|toolbar|topbar|widget|widgets)$"
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Words that make a part's name a property of the layout around it, as in has-sidebar, comments-open, header-fixed.
MODIFIERS = frozenset("has no with without open closed fixed sticky".split())
#: What closes an open p, and which elements end their open sibling.
CLOSES_P = BLOCKS - {"body", "caption", "head", "html", "legend", "option", "tbody", "td", "tfoot", "thead", "title", "tr"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An end tag doesn't reach across these from within.
SCOPE = frozenset("article aside body div footer form header html main nav section table ul ol dl blockquote".split())
#: What holds the blocks of a text.
CONTAINERS = frozenset("article body center div html main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The smoothing window and the threshold in standard deviations.
SIGMA, SHARE = 1.0, 1.0
#: Lines between two seeds of a cluster, at most; the text of a cluster against the largest one's; the share of all seeds' text for which a
#: container takes the place of the one around it.
BETWEEN, LEAST, NEARLY = 2, 0.1, 0.75
ARTICLES = frozenset(("article", "main"))


@dataclass(frozen=True)
class Line:
    text: str
    tags: int
    dropped: bool
    container: int
    heading: bool = False


class Lines(HTMLParser):
    """Collects lines, and of each container its parent (-1: the page) and whether it is an article or main element.

    An element whose class or id alone names a part that is dropped is kept if it holds the main element, or articles on a page that
    has neither elsewhere.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, starts a dropped part, is an article, starts a part dropped by its name
        self.dropped = 0
        self.inside = 0  # open article and main elements
        self.containers: list[int] = [-1]
        self.parents: list[int] = []
        self.is_article: list[bool] = []
        self.named, self.n_named = [], 0  # numbers of the open parts that are dropped by their names
        self.holders: list[tuple[bool, tuple[int, ...]]] = []  # for each article or main element: is it main, such parts around it
        self.lines: list[tuple[Line, tuple[int, ...]]] = []
        self.text: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        if self.text:
            words = "".join(self.text).split()
            if words:
                heading = any(x[0] in HEADINGS for x in self.stack[-6:])
                self.lines.append((Line(" ".join(words), self.tags, self.dropped > 0, self.containers[-1], heading), tuple(self.named)))
                self.tags = 0
            self.text = []

    def pop(self) -> None:
        tag = self.stack[-1][0]
        if tag in BLOCKS or tag in CONTAINERS:
            self.flush()
        tag, drops, article, named = self.stack.pop()
        if tag in CONTAINERS or article:
            self.containers.pop()
        self.dropped -= drops
        if named:
            self.named.pop()
        self.inside -= article

    def drops(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        inside = self.inside > 0
        if tag in DROPPED or tag == "header" and not inside:
            return True
        if tag in ("html", "body", "main") or tag in HEADINGS:
            return False
        for name, value in attrs:
            if name == "role" and value and value.lower() in ROLES and not (inside and value.lower() == "banner"):
                return True
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
        return False

    def named_part(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body", "main") or tag in HEADINGS:
            return False
        inside = self.inside > 0
        for name, value in attrs:
            if name in ("class", "id") and value:
                for token in value.split():
                    words = [w.lower() for w in WORDS.findall(token)]
                    if MODIFIERS.isdisjoint(words) and any(NAMES.match(word) and not (inside and word in ("header", "byline")) and not (tag == "article" and word not in ("comment", "comments", "teaser", "related", "ad", "ads", "reply", "replies")) for word in words):
                        return True
        return False

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in CLOSES_P:
            self.close("p")
        for other in SIBLINGS.get(tag, ()):
            self.close(other)
        if tag in BLOCKS:
            self.flush()
        if tag == "br" or tag in ("td", "th"):
            self.text.append(" ")
        if tag in VOID:
            return
        drops = self.drops(tag, attrs)
        named = not drops and self.named_part(tag, attrs)
        main = tag == "main" or ("role", "main") in attrs
        article = not drops and not named and not self.dropped and (tag == "article" or main)
        self.stack.append((tag, drops, article, named))
        self.dropped += drops
        if tag in CONTAINERS or article:
            self.flush()
            self.parents.append(self.containers[-1])
            self.is_article.append(article)
            self.containers.append(len(self.parents) - 1)
        if named:
            self.named.append(self.n_named)
            self.n_named += 1
        if article:
            self.holders.append((main, tuple(self.named)))
            self.inside += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def close(self, tag: str) -> None:
        """Ends the innermost open element of this name within its scope, and what is open in it."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if name in SCOPE and tag not in SCOPE:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        self.close(tag)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        self.text.append(data)

    def parse_marked_section(self, i, report=1):
        """Skips <![...]]> and, where that doesn't end, up to the next >."""
        j = self.rawdata.find("]]>", i) if self.rawdata.startswith("<![CDATA[", i) else -1
        end = j + 3 if j >= 0 else self.rawdata.find(">", i) + 1
        return end if end > 0 else len(self.rawdata)

    def finish(self) -> list[Line]:
        self.close_all()
        kept = {n for main, named in self.holders if main for n in named}
        if not any(kept.issuperset(named) for _, named in self.holders):
            kept = {n for _, named in self.holders for n in named}
        return [x if x.dropped or kept.issuperset(named) else replace(x, dropped=True) for x, named in self.lines]

    def close_all(self) -> None:
        super().close()
        self.flush()
        while self.stack:
            self.pop()


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(np.ceil(2 * sigma))
    w = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    return np.convolve(x, w, "same") / np.convolve(np.ones(len(x)), w, "same") if len(x) > r * 2 else np.array([np.average(x, weights=np.exp(-((np.arange(len(x)) - i) ** 2) / (2 * sigma * sigma))) for i in range(len(x))])


def region(lines: list[Line], parents: list[int], is_article: list[bool], sigma: float = SIGMA, share: float = SHARE) -> list[int]:
    """The numbers of the lines that are content."""
    kept = [i for i, x in enumerate(lines) if not x.dropped]
    if not kept:
        return []
    own = np.array([0 if x.dropped else len(x.text) / max(x.tags, 1) for x in lines])
    ratio = smooth(own, sigma)
    limit = min(share * float(np.std(ratio)), max(ratio[i] for i in kept))
    clusters: list[list[int]] = []
    for i in kept:
        if ratio[i] >= limit:
            if not clusters or i - clusters[-1][-1] > BETWEEN + 1:
                clusters.append([])
            clusters[-1].append(i)
    sizes = [sum(len(lines[i].text) for i in c) for c in clusters]
    seeds = [i for c, n in zip(clusters, sizes) if n >= LEAST * max(sizes) for i in c]
    # how much of the seeds' text each container holds
    chains: dict[int, list[int]] = {}
    held: dict[int, int] = {}
    for i in seeds:
        for c in chain_of(lines[i].container, parents, chains):
            held[c] = held.get(c, 0) + len(lines[i].text)
    total, node = sum(len(lines[i].text) for i in seeds), -1
    while not (node >= 0 and is_article[node]):
        best = max((c for c in held if parents[c] == node), key=lambda c: (held[c], -c), default=-1)
        if best < 0 or held[best] < NEARLY * total:
            break
        node = best
    parts: dict[int, int] = {}  # line -> the part of the node that holds it, the node itself for its own lines
    for i in kept:
        chain = chain_of(lines[i].container, parents, chains)
        if node < 0 or node in chain:
            at = len(chain) if node < 0 else chain.index(node)
            parts[i] = chain[at - 1] if at else node
    if node >= 0 and is_article[node]:
        return list(parts)
    seeds = [i for i in seeds if i in parts]
    level = min(limit, max(own[i] for i in seeds))
    good = {parts[i] for i in seeds if own[i] >= level}
    out = [i for i in parts if parts[i] in good]
    out = [i for i in parts if out[0] <= i <= out[-1]]
    first = kept.index(out[0])
    while first > 0 and lines[kept[first - 1]].heading:  # headings right before the region
        first -= 1
        out.insert(0, kept[first])
    return out


def chain_of(c: int, parents: list[int], known: dict[int, list[int]]) -> list[int]:
    """A container and those around it, from within."""
    if c not in known:
        known[c], at = [], c
        while at >= 0:
            known[c].append(at)
            at = parents[at]
    return known[c]


def extract(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The main text: blocks in page order, joined by an empty line; empty for null, empty or textless pages. Pages may be of any length
    and needn't be well-formed."""
    parser = Lines()
    parser.feed(html or "")
    lines = parser.finish()
    return "\n\n".join(lines[i].text for i in region(lines, parser.parents, parser.is_article, sigma, share))


def extract_pages(df: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keys..., text string, n_chars long) for each row. Null pages count as empty; other columns are left out, rows may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.text_batches(batches, "__html"):
            texts = [extract(x) for x in common.column(b, "__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(common.column(b, k) for k in keys), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keys, "text", "n_chars"])

    rows = df.select(*keys, F.col(html_col).cast("string").alias("__html"))
    kinds = dict(rows.dtypes)
    return common.in_arrow(rows, run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text string, n_chars long")
