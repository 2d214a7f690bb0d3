"""HTML to Markdown with the standard library's parser: headings, bullets, safe links, page breaks, image tokens."""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, functions as F

DROP = {"script", "style", "head", "title"}
BLOCK = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "nav", "footer", "header", "aside"}
#: fixed values: suffixes of images, addresses whose links stay
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff")
LINKS = ("http://", "https://", "mailto:")


class _Markdown(HTMLParser):
    def __init__(self, keys: dict[str, str] | None):
        super().__init__(convert_charrefs=True)
        self.out, self.drop, self.links, self.keys = [], 0, [], keys
        self.page: list | None = None  # of an open page break: its tag, its depth, the number told by attributes, its text
        self.images: list[tuple[str, str, str]] = []

    def _number(self, a: dict, text: str) -> str:
        label = a.get("title") or a.get("aria-label") or text.strip() or (re.search(r"(\d+)$", a.get("id", "")) or [""])[0]
        return re.sub(r"[^\w-]", "", label)

    def _break(self, number: str):
        self.out.append(f"\n\nZZPAGEZZ{number}ZZ\n\n" if number else "")

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.page is not None:
            self.page[1] += tag == self.page[0]
        elif tag in DROP:
            self.drop += 1
        elif "pagebreak" in a.get("epub:type", "") + " " + a.get("role", ""):
            if tag in ("hr", "br", "img"):
                self._break(self._number(a, ""))
            else:
                self.page = [tag, 1, a, ""]
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "a":
            self.links.append(a.get("href", "") if a.get("href", "").startswith(LINKS) else "")
            self.out.append("[" if self.links[-1] else "")
        elif tag in ("img", "image"):
            src = a.get("src") or a.get("xlink:href") or a.get("href") or ""
            key = hashlib.sha1((src + "image").encode()).hexdigest() if self.keys is None else self.keys.get(src)
            if key and (self.keys is not None or src.split("#")[0].split("?")[0].lower().endswith(IMAGES)):
                self.images.append((src, a.get("alt", ""), key))
                self.out.append(f"\n\nZZOCRZZ{key[:16]}ZZ\n\n")
        elif tag in BLOCK:
            self.out.append("\n\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.page is not None or tag in DROP:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.page is not None:
            self.page[1] -= tag == self.page[0]
            if not self.page[1]:
                (_, _, a, text), self.page = self.page, None
                self._break(self._number(a, text))
        elif tag in DROP:
            self.drop = max(0, self.drop - 1)
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag in BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.page is not None:
            self.page[3] += data
        elif not self.drop:
            self.out.append(re.sub(r"\s+", " ", data))


def parsed(html: str, keys: dict[str, str] | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """(Markdown, images as (source, alternative text, key)) of a page. keys: of images by their sources; others go."""
    p = _Markdown(keys)
    p.feed(html or "")
    p.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+", "\n", text)).strip() + "\n", p.images


def markdown(html: str) -> str:
    return parsed(html)[0]


def with_pages(text: Column) -> Column:
    """Markdown with page marks as comments."""
    return F.regexp_replace(text, r"(?U)ZZPAGEZZ([\w\-]+?)ZZ", "<!-- PAGE $1 -->")


def sections(rows: DataFrame) -> DataFrame:
    """(book, text): the sections(book, pos, entry, text) of each book in order, each under its name; blank ones go."""
    full = rows.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''")
    one = F.concat(F.lit("<!-- SECTION: "), "entry", F.lit(" -->\n\n"), with_pages(F.col("text")))
    b = full.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("t")))).alias("s"))
    return b.select("book", F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("text"))


def to_markdown(pages: DataFrame, key: str, html: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([markdown(x) for x in batch.column(1).to_pylist()], pa.string())], names=[key, "markdown"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, markdown string")
