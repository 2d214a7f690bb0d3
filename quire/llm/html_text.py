"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser turns a page into lines, one for each block, with the number of tags met in it. Lines of
elements that HTML itself sets apart (menus, footers, asides, forms) have no part in what follows. Of the others:

1. A line's ratio is its characters for each of its tags, times a weight for what its elements tell: above 1 in `article`
   and `main`, below 1 where class, id or role names speak of something else (unless that element holds the whole page).
   Names count whole, with all their words, so that `related-work` tells nothing. Those that many articles bear, such as
   `search` or `notice`, count only beside an article or main, or where the element holds little prose.
2. The ratios' logarithms are smoothed along the page and split into two clusters; lines of the upper one are content. If
   the clusters are hardly apart, all lines are but those with a low weight.
3. Content lines at most GAP lines apart, or in one container, make a region; regions far smaller than the largest go.
4. Short lines are kept by their neighbours: those in a container of a region, those between its lines, and headings
   right before one, in the same container or around it. Lines with a low weight come in only by their own ratio.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import released

#: fixed values: elements by what they mean in HTML
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
NEVER = {"head", "title", "script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "menu", "dialog"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"html", "body", "article", "main", "section", "div", "table", "ul", "ol", "dl", "td", "th", "nav", "aside", "header", "footer", "form", "blockquote"}
#: fixed values: words of class, id and role names that tell of no content, surely or perhaps, and those that may stand beside them
SURELY = set("ad ads adbox adslot advert adverts advertisement advertising sponsored gdpr sidebar sidebars nav navbar navigation breadcrumb breadcrumbs masthead comment comments commentlist disqus replies pager pagination complementary contentinfo".split())
PERHAPS = set("banner sponsor promo promotion cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup menu menus header footer reply respond share sharing social related recommended widget widgets toolbar login search skip dialog form".split())
NEUTRAL = set("area article articles bar block body bottom box button buttons container content desktop global icon icons inner item items left link links list main mobile outer page panel post posts primary reader right secondary section site slot text top unit us user wrap wrapper".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"html", "body", "div", "section", "center", "details"}  # with article and main, which hold all containers in them
SIGMA = 1.0  # of the smoothing, in lines
INSIDE, BESIDE = 20.0, 0.01  # weights of a line in article or main, and of one whose element's names tell of no content
LEAST, APART = 0.1, 1.0  # added to a ratio before its logarithm; the least distance of clusters
PROSE = 80  # characters of a line that is prose if it isn't all links
GAP, SHARE = 3, 0.1  # lines between two of one region; the least size of a region, as a part of the largest


class _Element(NamedTuple):
    name: str
    out: bool  # set apart by HTML itself, here or further out
    container: int
    sealed: bool  # the container is an article or main
    flag: int  # the innermost element that names tell of; 0: none


class _Line(NamedTuple):
    text: str
    tags: int
    out: bool
    container: int
    sealed: bool
    flag: int
    heading: bool
    linked: bool  # all its text is that of links


class _Lines(HTMLParser):
    """Collects a page's lines. Each open element knows what it inherits, so a line costs the same at any depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Element("", False, 0, False, 0)]
        self.lines: list[_Line] = []
        self.containers, self.above = 0, [0]  # above: of each flagged element, the flagged one around it
        self.doubts = [False]  # of each flagged element: whether its names tell of no content perhaps only
        self.inside = [False]  # and whether it lies in an article or main
        self.ends: dict[int, int] = {}  # of each container that has closed, the last one in it; they are numbered as they open
        self.open: Counter[str] = Counter()
        self.parts, self.tags, self.plain = [], 0, False

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            e = self.stack[-1]
            self.lines.append(_Line(text, self.tags, e.out, e.container, e.sealed, e.flag, any(self.open[h] for h in HEADINGS), not self.plain))
            self.tags = 0
        self.parts, self.plain = [], False

    def _pop(self, k: int):
        if any(e.name not in INLINE for e in self.stack[k:]):
            self._flush()
        self.open.subtract(e.name for e in self.stack[k:])
        for i in range(k, len(self.stack)):
            if self.stack[i].container != self.stack[i - 1].container:
                self.ends[self.stack[i].container] = self.containers
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self._flush()
        closes = SELF_CLOSING.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if any(self.open[c] > 0 for c in closes):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].name in closes:
                    self._pop(k)
                    break
                if self.stack[k].name in SCOPES:
                    break
        if tag in VOID:
            return
        e = self.stack[-1]
        container, sealed, flag = e.container, e.sealed, e.flag
        if not sealed and (tag in CONTAINERS or tag in ("article", "main")):
            self.containers += 1
            container, sealed = self.containers, tag in ("article", "main")
        if not e.out and (told := self._flagged(tag, attrs)):
            self.above.append(flag)
            self.doubts.append(told == "perhaps")
            self.inside.append(bool(self.open["article"] or self.open["main"]))
            flag = len(self.above) - 1
        self.stack.append(_Element(tag, e.out or self._out(tag, attrs), container, sealed, flag))
        self.open[tag] += 1

    def _out(self, tag, attrs) -> bool:
        if tag in NEVER or tag == "header" and not (self.open["article"] or self.open["main"]):
            return True
        told = dict(attrs)
        return tag not in ("html", "body") and ("hidden" in told or told.get("aria-hidden") == "true")

    def _flagged(self, tag, attrs) -> str | None:
        """Whether an element's names tell of no content, surely or perhaps: those of which every word is of a known kind."""
        if not attrs or tag in ("html", "body", "article", "main"):
            return None
        told, own = dict(attrs), self.open["article"] or self.open["main"]  # a header in an article is its own
        out = None
        for name in " ".join(told.get(k) or "" for k in ("class", "id", "role")).split():
            words = {w.lower() for w in WORD.findall(name) if not w.isdigit()}
            surely, perhaps = words & SURELY, words & PERHAPS - ({"header"} if own else set())
            if (surely or perhaps) and not words - SURELY - PERHAPS - NEUTRAL:
                out = "surely" if surely else out or "perhaps"
        return out

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if not self.open[tag]:
            if tag == "p":
                self._flush()
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name == tag:
                self._pop(k)
                return
            if tag in INLINE and self.stack[k].name not in INLINE:
                return

    def handle_data(self, data):
        self.parts.append(data)
        self.plain = self.plain or not self.open["a"] and not data.isspace()

    def done(self) -> list[_Line]:
        self.close()
        self._flush()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means along the page; at its ends, of the lines that there are."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    sums = lambda x: np.convolve(np.pad(x, reach), kernel, "valid")
    return sums(ratios) / sums(np.ones(len(ratios))) if len(ratios) else ratios


def upper_cluster(values: np.ndarray) -> np.ndarray | None:
    """Two-means in one dimension: which values lie above the middle of both clusters' means; None if they are less than APART apart."""
    low, high = values.min(), values.max()
    if high - low < APART:
        return None
    cut = (low + high) / 2
    for _ in range(50):
        up = values > cut
        after = (values[up].mean() + values[~up].mean()) / 2
        if after == cut:
            break
        cut = after
    return values > cut


def believed(lines: list[_Line], above: list[int], doubts: list[bool], inside: list[bool]) -> list[int]:
    """Each line's flag, or the nearest around it, that counts: where names tell of no content perhaps only, the text must agree.

    Such an element counts if it stands beside an article or main, or if less than half of its text is prose, that is, in
    lines of PROSE characters that aren't all links.
    """
    size, prose = np.zeros(len(above)), np.zeros(len(above))
    for x in lines:
        size[x.flag] += len(x.text)
        prose[x.flag] += len(x.text) if len(x.text) >= PROSE and not x.linked else 0
    for f in range(len(above) - 1, 0, -1):
        size[above[f]] += size[f]
        prose[above[f]] += prose[f]
    apart = any(x.sealed for x in lines)
    counts = [0] * len(above)
    for f in range(1, len(above)):
        kept = not doubts[f] or apart and not inside[f] or 2 * prose[f] < size[f]
        counts[f] = f if kept else counts[above[f]]
    return [counts[x.flag] for x in lines]


def besides(flags: list[int], above: list[int]) -> np.ndarray:
    """Which lines lie in a flagged element that doesn't hold all lines; above: of each flag, the one around it (0: none)."""
    held = np.bincount(flags, minlength=len(above))
    for f in range(len(above) - 1, 0, -1):
        held[above[f]] += held[f] if above[f] else 0
    held[0] = len(flags)
    return held[flags] < len(flags)


def regions(content: np.ndarray, containers: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The content lines that belong to regions of size enough."""
    if not content.any():
        return content
    at = np.flatnonzero(content)
    run = np.cumsum(np.append(0, np.diff(at) > GAP + 1))
    name = {}  # of a container: its first run
    joined = list(range(int(run[-1]) + 1))

    def find(k):
        while joined[k] != k:
            joined[k] = joined[joined[k]]
            k = joined[k]
        return k

    for k, c in zip(run.tolist(), containers[at].tolist()):
        a, b = sorted((find(name.setdefault(c, k)), find(k)))
        joined[b] = a
    run = np.array([find(k) for k in run.tolist()])
    mass = np.bincount(run, size[at])
    out = np.zeros(len(content), bool)
    out[at[mass[run] >= SHARE * mass.max()]] = True
    return out


def selected(lines: list[_Line], above: list[int], ends: dict[int, int], doubts: list[bool], inside: list[bool]) -> np.ndarray:
    """Which of the lines, none of them out, are main text; the others: see _Lines."""
    size = np.array([len(x.text) for x in lines], float)
    containers = np.array([x.container for x in lines])
    beside = besides(believed(lines, above, doubts, inside), above)
    weight = np.where(beside, BESIDE, np.where([x.sealed for x in lines], INSIDE, 1.0))
    ratio = weight * size / np.maximum([x.tags for x in lines], 1)
    content = upper_cluster(smoothed(np.log(ratio + LEAST)))
    keep = regions(~beside if content is None else content, containers, size)
    homes = np.isin(containers, containers[keep & ~beside])
    plain = np.array([x.sealed or not x.linked for x in lines])
    keep |= homes & plain & ~beside
    for k in range(len(lines) - 2, -1, -1):
        if lines[k].heading and not beside[k] and keep[k + 1] and containers[k] <= containers[k + 1] <= ends.get(int(containers[k]), containers[k + 1]):
            keep[k] = True
    at = np.flatnonzero(keep)
    for a, b in zip(at[:-1], at[1:]):
        if b - a <= GAP + 1:
            keep[a:b] |= ~beside[a:b]
    return keep


def main_text(html: str, step: int = 1 << 16) -> str:
    """The page's main text: its lines in page order, joined by one space; empty if there is none."""
    parser = _Lines()
    for k in range(0, len(html), step):
        parser.feed(html[k : k + step])
    lines = [x for x in parser.done() if not x.out]
    return " ".join(x.text for x, keep in zip(lines, selected(lines, parser.above, parser.ends, parser.doubts, parser.inside)) if keep) if lines else ""


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; null and empty pages have an empty text.

    Broken markup never fails: elements close where HTML implies it or at the page's end. A page whose lines all lie in
    elements set apart has no text. Very long pages are parsed in steps, and lines cost the same at any depth. Null ids and
    urls stay null, repeated rows are rows of their own, an empty table gives no rows, other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(released(_extract), "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op8_html_text": op8_html_text}
ORACLES: dict[str, str] = {}
