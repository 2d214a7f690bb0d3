"""EPUB archives: container, package document, manifest, spine, metadata; from rows of binary content."""

from __future__ import annotations

import glob
import io
import os
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

#: fixed values: names of sections without content
SKIP = {
    "cover.html", "cover.xhtml", "halftitle.html", "halftitle.xhtml",
    "contents.html", "contents.xhtml", "toc.html", "toc.xhtml",
    "nav.html", "nav.xhtml", "reader.html", "reader.xhtml",
}
#: fixed values: metadata of a book by their names in the package document; of authors all count
METADATA = {"title": "title", "creator": "authors", "date": "date", "publisher": "publisher", "language": "language", "identifier": "identifier"}
RUN_BYTES = 64 << 20  # of an archive, for each run of its spine
SCHEMA = "path string, pos int, id string, href string, entry string, type string, role string, content string, image binary, title string, authors array<string>, date string, publisher string, language string, identifier string"


def resolve(base: str, href: str, names: dict[str, str]) -> str | None:
    """An archive member by a reference: without fragment or query, unquoted, relative to base, whatever its case."""
    bare = unquote(href.split("#")[0].split("?")[0]).replace("\\", "/")
    return names.get(posixpath.normpath(posixpath.join(base, bare)).lower()) if bare else None


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def spine(z: zipfile.ZipFile, wanted: set[str] | None = None, part: tuple[int, int] = (0, 1)) -> Iterator[tuple]:
    """Rows of the spine: (pos, id, href, entry, type, role, content, image, *metadata). Raises ValueError without a package document.

    role: section, page (an image that is a whole page) or skipped; items that aren't in the manifest or the archive, and
    those of other types, give no row. wanted: names of columns, where content and image are unzipped only if they are
    among them; part (k, n): of n equal runs of the spine the one numbered k.
    """
    names = {n.lower(): n for n in z.namelist()}
    opf = None
    if found := names.get("meta-inf/container.xml"):
        opf = next((e.get("full-path") for e in ElementTree.fromstring(z.read(found)).iter() if _local(e) == "rootfile"), None)
    opf = names.get((opf or "").lower()) or next((n for n in z.namelist() if n.lower().endswith(".opf")), None)
    if opf is None:
        raise ValueError("no package document")
    root, base = ElementTree.fromstring(z.read(opf)), posixpath.dirname(opf)
    items = {e.get("id"): e for e in root.iter() if _local(e) == "item"}
    text = lambda name: [e.text.strip() for e in root.iter() if _local(e) == name and e.text and e.text.strip()]
    told = [text(name) if key == "authors" else (text(name) or [None])[0] for name, key in METADATA.items()]
    refs = [e for e in root.iter() if _local(e) == "itemref"]
    texts, images = wanted is None or "content" in wanted, wanted is None or "image" in wanted
    for pos in range(len(refs) * part[0] // part[1], len(refs) * (part[0] + 1) // part[1]):
        if (item := items.get(refs[pos].get("idref"))) is None:
            continue
        href, kind = item.get("href", ""), item.get("media-type", "")
        if (member := resolve(base, href, names)) is None:
            continue
        head = (pos, item.get("id"), href, member, kind)
        if kind.startswith("image/"):
            yield (*head, "page", None, z.read(member) if images else None, *told)
        elif "html" in kind:
            skip = "nav" in (item.get("properties") or "").split() or posixpath.basename(member).lower() in SKIP
            yield (*head, "skipped" if skip else "section", z.read(member).decode("utf-8", "replace") if texts and not skip else None, None, *told)


def read(data: bytes) -> list[tuple]:
    """All rows of an archive's spine."""
    return list(spine(zipfile.ZipFile(io.BytesIO(data))))


class EpubReader(DataSourceReader):
    """Partitions by archive and run of the spine; a task opens the archive and unzips what its run and the wanted columns need."""

    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.names = [c.split()[0] for c in SCHEMA.split(", ")]
        if unknown := set(self.columns) - set(self.names):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.paths = sorted(p for x in options["path"].split(",") for p in (glob.glob(f"{x}/**/*.epub", recursive=True) if os.path.isdir(x) else glob.glob(x)))
        self.run_bytes = int(options.get("runbytes", RUN_BYTES))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.paths = [p for p in self.paths if p == f.value]
            elif isinstance(f, In) and f.attribute == ("path",):
                self.paths = [p for p in self.paths if p in f.value]
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.paths = [p for p in self.paths if p.startswith(f.value)]
            else:
                yield f

    def partitions(self):
        runs = lambda p: max(1, -(-os.path.getsize(p) // self.run_bytes))
        return [InputPartition((p, k, n)) for p in self.paths for n in [runs(p)] for k in range(n)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        path, k, n = partition.value
        at = [self.names.index(c) for c in self.columns]
        try:
            with open(path, "rb") as f:
                for row in spine(zipfile.ZipFile(f), set(self.columns), (k, n)):
                    row = (path, *row)
                    yield tuple(row[i] for i in at)
        except (ValueError, zipfile.BadZipFile, ElementTree.ParseError):
            if k == 0:
                row = (path, None, None, None, None, None, "error", *[None] * (len(self.names) - 7))
                yield tuple(row[i] for i in at)


class EpubSource(DataSource):
    """spark.read.format("epub").load(a folder, a file or a pattern, in a file system that driver and executors mount).

    A schema of some of the columns reads no more than these need, and filters on path leave out archives.
    """

    @classmethod
    def name(cls):
        return "epub"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return EpubReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpubSource)


def scan(files: DataFrame) -> DataFrame:
    """Spines of binaryFile rows (path, content); a file that can't be read gives one row of role `error`."""

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, *r) for r in read(data)]
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError):
                    rows.append((path, None, None, None, None, None, "error", *[None] * (len(names) - 7)))
            yield pd.DataFrame(rows, columns=names).astype({"pos": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def counts(spine: DataFrame) -> DataFrame:
    """(path, sections, skipped): sections with content, and skipped ones; blank sections are neither. spine: of scan, with `markdown`."""
    full = (F.col("role") == "page") | (F.col("role") == "section") & (F.trim(F.coalesce("markdown", F.lit(""))) != "")
    return spine.groupBy("path").agg(F.count_if(full).alias("sections"), F.count_if(F.col("role") == "skipped").alias("skipped"))


def routes(files: DataFrame) -> DataFrame:
    """binaryFile rows with their suffix and the branch that reads them."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.withColumn("suffix", suffix).withColumn("branch", F.when(suffix == ".epub", "epub").when(suffix == ".pdf", "pdf").otherwise("generic"))
