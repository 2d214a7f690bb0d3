"""Segmentation: units located in books by their start lines, with tables of contents skipped."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..staging import materialise


#: fixed values: neighbours on each side of a line that are looked at, and how many other starts among them tell a table of contents
TOC_NEIGHBOURS, TOC_HITS = 3, 2


#: fixed values: what ends the last unit; characters of a content unit that is nearly empty
END_OF_BOOK, TINY_CHARS = "(end of book)", 400
#: lines between the contents and the chapters of the derived books, and after each chapter's text
FRONT, TAIL = "front a\nfront b\nfront c", "end a\nend b\nend c"


def chapter_pieces(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books as pieces (source, pos, text): a table of contents, then the documents of a source as chapters; and their units (source, k, start)."""
    h = docs.select("source", "text", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("long").alias("pos"))
    start = F.concat(F.lit("# Chapter "), F.col("pos").cast("string"))
    units = h.select("source", F.col("pos").alias("k"), start.alias("start"))
    contents = units.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("k", "start"))).alias("r"))
    contents = contents.select("source", F.lit(0).cast("long").alias("pos"), F.concat_ws("\n", F.array_join(F.transform("r", lambda x: x["start"]), "\n"), F.lit(FRONT)).alias("text"))
    chapters = h.select("source", "pos", F.concat(start, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n" + TAIL)).alias("text"))
    return contents.unionByName(chapters), units


CHUNK = 256  # pieces of a book that are searched together
SOME, MANY = 32, 2000  # pieces that a worker holds as Python strings, rows that leave it together
_FOUND = "kind int, source string, pos long, line long, r long, off long, k long, equal boolean, text string"
PIECE, HIT, KNOWN, LINE = range(4)


def _search(batches):
    """Rows (source, chunk, kind, pos, text, starts), the starts of a chunk before its pieces, to what its lines tell: see _FOUND.

    PIECE: a piece's first line, with r of its lines not blank and off characters. HIT: a line that equals or contains the start
    of unit k. KNOWN: a line that equals any start. LINE: a line that was hit. r counts the lines that aren't blank, off characters.
    """
    import ahocorasick
    import pyarrow as pa

    names = [c.split()[0] for c in _FOUND.split(", ")]
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    told, units, known, automaton, out = None, {}, set(), None, []
    for batch in (b.slice(k, SOME) for b in batches for k in range(0, b.num_rows, SOME)):
        for source, _, kind, pos, text, starts in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if told == (source, starts):
                    continue
                told, units = (source, starts), {}
                for u in starts:
                    first = next((x.strip() for x in (u["start"] or "").splitlines() if x.strip()), "")
                    if first:
                        units.setdefault(first, []).append(u["k"])
                known = {x["start"].strip() for x in starts if x["start"] and x["start"].strip()}
                automaton = ahocorasick.Automaton()
                for first in units:
                    automaton.add_word(first, first)
                automaton.make_automaton()
                continue
            text = text or ""
            lines = text.split("\n")
            offsets = list(accumulate((len(x) + 1 for x in lines), initial=0))
            bare = [x.strip() for x in lines]
            rank = list(accumulate(map(bool, bare), initial=0))
            out.append((PIECE, source, pos, 0, rank[-1], offsets[-1], None, None, bare[0]))
            hits = {(bisect_right(offsets, end) - 1, first) for end, first in automaton.iter(text)} if units and told[0] == source else ()
            for i, first in hits:
                out += [(HIT, source, pos, i, rank[i], offsets[i], k, bare[i] == first, first) for k in units[first]]
            out += [(LINE, source, pos, i, rank[i], offsets[i], None, None, bare[i]) for i in {i for i, _ in hits}]
            out += [(KNOWN, source, pos, i, rank[i], offsets[i], None, None, x) for i, x in enumerate(bare) if x in known]
            if len(out) >= MANY:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=names)
                out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=names)


def _chosen(skip_contents: bool):
    """Hits (source, k, equal, pos, line, contents), sorted, equal lines first, to the hit of each unit: (source, k, pos, line, skipped).

    A chain over hits: of a book, the place behind the last hit is known, of a unit the first hit among contents.
    """

    def run(batches):
        import pyarrow as pa

        names, kinds = ["source", "k", "pos", "line", "skipped"], (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        book, unit, part, at, first, won = None, None, None, None, None, None
        out = []

        def close():
            """The unit's or the part's end: a first hit among contents counts if no other did."""
            nonlocal won, first
            if won is None and first is not None:
                won = (*first, False)
            first = None

        def leave():
            nonlocal at, won
            if won is not None:
                out.append((book, unit, *won))
                at = won[:2]
            won = None

        for batch in batches:
            for source, k, equal, pos, line, contents in zip(*(c.to_pylist() for c in batch.columns)):
                if (source, k) != (book, unit):
                    close(), leave()
                    if source != book:
                        at = None
                    book, unit, part = source, k, equal
                elif equal != part:
                    close()
                    part = equal
                if won is not None or at is not None and (pos, line) <= at:
                    continue
                if not skip_contents or not contents:
                    won = (pos, line, first is not None)
                elif first is None:
                    first = (pos, line)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=names)
                out.clear()
        close(), leave()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=names)

    return run


def locate_pieces(pieces: DataFrame, units: DataFrame, skip_contents: bool = True) -> DataFrame:
    """Each unit's half-open span in its book; pieces(source, pos, text), joined by line feeds in the order of pos, units(source, k, start).

    Every line from behind the previous unit's hit is searched: those that equal the start, stripped, else those that contain
    it. Of these the first that isn't beside two other starts counts, or the first of all if each is; a unit that isn't found
    leaves the search where it was. Of a start with several lines the first that isn't blank counts. The first unit found
    begins at 0, the last ends with the book. (source, k, unit_id, a, b, toc_skipped, start_line, end)

    All starts of a book are sought at once by one automaton, in chunks of pieces that tasks share. Only hits, counts and
    lines that were hit leave the chunks; hits are chosen in their order, one after the other, of a book in one task. Tables
    of pieces and lines grow with the input, and are merged: by the size of their files they would pass for small, and go
    through the driver.
    """
    pieces = pieces.select(F.col("source").cast("string").alias("source"), F.col("pos").cast("long").alias("pos"), "text")
    units = units.select(F.col("source").cast("string").alias("source"), F.col("k").cast("long").alias("k"), "start")
    chunk = F.floor(F.col("pos") / CHUNK).alias("chunk")
    starts = units.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("k", "start"))).alias("starts"))
    none = F.lit(None).cast(starts.schema["starts"].dataType)
    heads = pieces.select("source", chunk).distinct().join(starts, "source").select("source", "chunk", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("text"), "starts")
    bodies = pieces.join(starts.select("source"), "source", "left_semi").select("source", chunk, F.lit(1).alias("kind"), "pos", "text", none.alias("starts"))
    rows = heads.unionByName(bodies).repartition("source", "chunk").sortWithinPartitions("source", "chunk", "kind", "pos")
    found = materialise(rows.mapInArrow(_search, _FOUND), "lines")

    order = W.partitionBy("source").orderBy("pos")
    own = found.where(F.col("kind") == PIECE).withColumn("r0", F.sum("r").over(order) - F.col("r")).withColumn("off0", F.sum("off").over(order) - F.col("off"))
    base = own.select("source", "pos", "r0", "off0").hint("merge")  # numbers of the pieces, a row each
    book = found.where(F.col("kind") == PIECE).groupBy("source").agg((F.sum("off") - 1).alias("chars"), F.min_by("text", "pos").alias("first"))
    near = found.where(F.col("kind") == KNOWN).join(base, ["source", "pos"]).select("source", (F.col("r0") + F.col("r")).alias("at"), "text")
    near = near.select("source", F.explode(F.array(*[F.col("at") + i for i in range(-TOC_NEIGHBOURS, TOC_NEIGHBOURS + 1) if i])).alias("at"), "text")
    near = near.groupBy("source", "at").agg(F.collect_list("text").alias("beside"))  # six lines at most
    hits = found.where(F.col("kind") == HIT).join(base, ["source", "pos"]).withColumn("at", F.col("r0") + F.col("r")).join(near.hint("merge"), ["source", "at"], "left")
    others = F.filter("beside", lambda x: x != F.col("text"))
    hits = hits.select("source", "k", "equal", "pos", "line", (F.coalesce(F.size(others), F.lit(0)) >= TOC_HITS).alias("contents"))
    hits = hits.repartition("source").sortWithinPartitions("source", "k", F.desc("equal"), "pos", "line")
    won = hits.mapInArrow(_chosen(skip_contents), "source string, k long, pos long, line long, skipped boolean")
    lines = found.where(F.col("kind") == LINE).select("source", "pos", "line", "off", F.col("text").alias("head"))
    won = won.join(lines.hint("merge"), ["source", "pos", "line"]).join(base, ["source", "pos"]).join(book, "source").withColumn("a", F.col("off0") + F.col("off"))
    after, first = W.partitionBy("source").orderBy("k"), F.row_number().over(W.partitionBy("source").orderBy("k")) == 1
    return won.select(
        "source", "k", unit_name(F.col("k")).alias("unit_id"), F.when(first, 0).otherwise(F.col("a")).cast("long").alias("a"), F.coalesce(F.lead("a").over(after), "chars").alias("b"),
        F.col("skipped").alias("toc_skipped"), F.when(first, F.col("first")).otherwise(F.col("head")).alias("start_line"), F.coalesce(F.lead("head").over(after), F.lit(END_OF_BOOK)).alias("end"),
    )


def locate_texts(books: DataFrame, units: DataFrame, skip_contents: bool = True) -> DataFrame:
    """locate_pieces of books(source, text), each one piece."""
    return locate_pieces(books.select("source", F.lit(0).cast("long").alias("pos"), "text"), units, skip_contents)


def unit_name(k: Column) -> Column:
    """U01, U02, ... U100."""
    return F.concat(F.lit("U"), F.lpad(k.cast("string"), F.greatest(F.lit(2), F.length(k.cast("string"))), F.lit("0")))


def tiny_units(spans: DataFrame) -> DataFrame:
    """Content units that are nearly empty; spans(unit_id, kind, a, b, ...)."""
    return spans.where((F.col("kind") == "content") & (F.col("b") - F.col("a") < TINY_CHARS))


def redone(changed: DataFrame, files: DataFrame) -> DataFrame:
    """files(source, unit_id, kind) that go when spans change: the units' answers, and every synthesis of a book with such a unit."""
    own = files.join(changed.select("source", "unit_id").hint("merge"), ["source", "unit_id"], "left_semi").where("kind <> 'synthesis'")
    whole = files.where("kind = 'synthesis'").join(changed.select("source").distinct(), "source", "left_semi")
    return own.unionByName(whole)


def changed_spans(before: DataFrame, after: DataFrame) -> DataFrame:
    """Units whose span moved: their results are redone. New units have none yet."""
    old = before.select("source", "unit_id", F.col("a").alias("a0"), F.col("b").alias("b0"))
    return after.join(old.hint("merge"), ["source", "unit_id"]).where("a <> a0 or b <> b0").select("source", "unit_id", "a", "b")
