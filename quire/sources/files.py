"""Files other than books: usage lines, uploads, snapshots, rejects, archives, and documents of simple formats."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Mapping
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .html import markdown

#: fixed values: formats of uploaded books and their greatest size
UPLOADS, MOST_MB = (".epub", ".pdf"), 300
#: fixed values: why an answer goes to quarantine
REJECTS = ("invalido", "sin_temas", "unidad_perdida")
USAGE = "label string, model string, batch boolean, input long, cache_write long, cache_read long, output long, stop string, time string, cost double"


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The lines of usage files; blank lines are skipped, fields that a line hasn't are null."""
    return spark.read.schema(USAGE).json(path)


def append_usage(rows: DataFrame, path: str) -> None:
    """More lines to a folder of usage files; each write adds files of its own, so writers don't wait for each other. See ledger.once for streams."""
    rows.write.mode("append").json(path)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def rejected(path: Column, length: Column, received: Column, allowed=UPLOADS) -> Column:
    """Why an upload isn't taken, or null: its format, no content, its size, or content that broke off."""
    return (
        F.when(~suffix(path).isin(list(allowed)), "format")
        .when(F.coalesce(length, F.lit(0)) <= 0, "empty")
        .when(length > MOST_MB * 1024 * 1024, "size")
        .when(F.coalesce(received, F.lit(0)) < length, "broken")
    )


def uploads(files: DataFrame, allowed=UPLOADS) -> DataFrame:
    """files(path, length, content) with `rejected`; content is only measured."""
    return files.withColumn("rejected", rejected(F.col("path"), F.col("length"), F.octet_length("content"), allowed))


def setting(environ: Mapping[str, str], name: str, prefix: str) -> str | None:
    """A setting from the environment: the application's own, else the general one; blank ones don't count."""
    return next((v for k in (prefix + name, name) if (v := (environ.get(k) or "").strip())), None)


def snapshot(spark: SparkSession, value, path: str) -> None:
    """Write a value as JSON to a file that readers see whole, old or new: to a name of its own beside it, then renamed over it."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()
    if not fs.rename(aside, target):  # file systems whose plain rename doesn't replace have one that does
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, options)


def quarantine(rows: DataFrame, path: str, reason: str = "quarantine") -> DataFrame:
    """The rows without a reason; the others are appended to path, by reason."""
    rows.where(F.col(reason).isNotNull()).write.mode("append").partitionBy(reason).parquet(path)
    return rows.where(F.col(reason).isNull())


def archives(files: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, content): a ZIP archive of each book's files(key, name, text), which are few."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for rows in batch.column(1).to_pylist():
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for r in rows:
                        z.writestr(r["name"], r["text"] or "")
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "content"])

    rows = files.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("f"))
    return rows.mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, content binary")


# ---------------------------------------------------------------- documents of simple formats

def _table(rows: list[list[str]]) -> str:
    rows = [[str(c).replace("|", "\\|").replace("\n", " ") for c in r] for r in rows if r]
    if not rows:
        return ""
    wide = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])


def _docx(data: bytes) -> str:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    own = lambda e, name: [x for x in e.iter() if x.tag.rpartition("}")[2] == name]
    text = lambda e: "".join(x.text or "" for x in own(e, "t"))
    body, out = own(root, "body"), []
    for e in body[0] if body else ():
        kind = e.tag.rpartition("}")[2]
        if kind == "tbl":
            out.append(_table([[text(c) for c in own(r, "tc")] for r in own(e, "tr")]))
        elif kind == "p" and text(e).strip():
            style = next((v for s in own(e, "pStyle") for k, v in s.attrib.items() if k.endswith("val")), "")
            level = int(style[-1]) if style.lower().startswith("heading") and style[-1].isdigit() else 0
            out.append("#" * level + " " * bool(level) + text(e).strip())
    return "\n\n".join(x for x in out if x)


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """(kind, member) of each relation of a part of an archive, by id."""
    folder, _, name = part.rpartition("/")
    member = f"{folder}/_rels/{name}.rels"
    if member not in z.namelist():
        return {}
    at = lambda target: target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
    return {e.get("Id"): (e.get("Type", "").rpartition("/")[2], at(e.get("Target", ""))) for e in ElementTree.fromstring(z.read(member))}


def _slide(root: ElementTree.Element) -> list[str]:
    """The texts of a slide's shapes in their order, titles as headings, tables as tables."""
    local = lambda e: e.tag.rpartition("}")[2]
    within = lambda e, name: [x for x in e.iter() if local(x) == name]
    lines = lambda e: "\n".join(t for p in within(e, "p") if (t := "".join(x.text or "" if local(x) == "t" else "\n" if local(x) == "br" else "" for x in p.iter()).strip()))
    out = []
    for e in root.iter():
        if local(e) == "graphicFrame":
            out += [_table([[lines(c) for c in within(r, "tc")] for r in within(t, "tr")]) for t in within(e, "tbl")]
        elif local(e) == "sp" and (text := lines(e)):
            kinds = {p.get("type", "") for p in within(e, "ph")}
            if not kinds & {"sldNum", "dt", "ftr", "sldImg"}:
                out.append("# " + text.replace("\n", " ") if kinds & {"title", "ctrTitle"} else text)
    return [x for x in out if x]


def _pptx(data: bytes) -> str:
    """Slides in their order, each under its number, with its notes behind it."""
    z = zipfile.ZipFile(io.BytesIO(data))
    show = "ppt/presentation.xml"
    order = [v for e in ElementTree.fromstring(z.read(show)).iter() if e.tag.rpartition("}")[2] == "sldId" for k, v in e.attrib.items() if k.startswith("{")]
    parts, relations = [], _relations(z, show)
    for n, key in enumerate(order, 1):
        member = relations[key][1]
        out = [f"<!-- Slide number: {n} -->", *_slide(ElementTree.fromstring(z.read(member)))]
        for kind, notes in _relations(z, member).values():
            if kind == "notesSlide" and (told := _slide(ElementTree.fromstring(z.read(notes)))):
                out += ["### Notes:", *told]
        parts.append("\n\n".join(out))
    return "\n\n".join(parts)


def generic(path: str, data: bytes) -> str:
    """A document as Markdown, by its suffix: HTML, Word, slides, CSV, JSON; anything else is text. Raises ValueError for a broken archive."""
    end = path.lower().rpartition(".")[2]
    if end in ("html", "htm", "xhtml"):
        return markdown(data.decode("utf-8", "replace"))
    if end in ("docx", "pptx"):
        try:
            return _docx(data) if end == "docx" else _pptx(data)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            raise ValueError(f"broken document: {e}") from e
    text = data.decode("utf-8-sig", "replace")
    if end == "csv":
        return _table(list(csv.reader(io.StringIO(text))))
    if end == "json":
        return "```json\n" + json.dumps(json.loads(text), ensure_ascii=False, indent=2) + "\n```"
    return text


def documents(files: DataFrame) -> DataFrame:
    """(path, text, error) of files(path, content) that aren't books; one that can't be read has its error."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, generic(path, bytes(data or b"")), None))
                except ValueError as e:
                    rows.append((path, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")
