"""Queries over books and their units: contents pages, changed spans, unit sources, tables among blocks, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as X
from ..staging import materialise
from ..views import duck, table
from .documents import ORACLES as _DOCUMENTS
from .segment import TINY_CHARS, TOC_HITS, TOC_NEIGHBOURS, changed_spans, chapter_pieces, locate_pieces, redone, tiny_units as tiny, unit_name

QUERIES, ORACLES = {}, {}
_UNITS = f"({_DOCUMENTS['locate_units'].strip()})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


def contents_hits(lines: DataFrame, units: DataFrame, reach: int = TOC_NEIGHBOURS) -> DataFrame:
    """(source, k, i, hits) of the lines that equal unit k's start: how many of the `reach` lines before and after are starts of other units.

    lines(source, i, line): non-blank lines numbered without gaps; units(source, k, start). Lines meet by their numbers, so
    no window runs over a book's lines. Starts that equal the unit's own don't count.
    """
    starts = units.select("source", "k", F.col("start").alias("line"))
    found = lines.join(starts, ["source", "line"]).select("source", "k", "i", "line")
    sides = [d for d in range(-reach, reach + 1) if d]
    near = found.select("source", F.col("i").alias("at"), F.col("line").alias("other")).distinct()
    near = near.select("source", "other", F.explode(F.array(*[F.col("at") + F.lit(d) for d in sides])).alias("i"))
    return found.join(near, ["source", "i"], "left").groupBy("source", "k", "i").agg(F.count_if(F.col("other") != F.col("line")).alias("hits"))


@query(f"""
with h as (select source, row_number() over (partition by source order by doc_id) as k, text from book_docs),
x as (select source, 0 as p, k, ['# Chapter ' || k] as ls from h union all select source, 1, k, list_filter(string_split('# Chapter ' || k || chr(10) || text, chr(10)), lambda y: regexp_matches(y, '\\S')) from h),
e as (select source, p, k, unnest(ls) as line, generate_subscripts(ls, 1) as j from x),
n as (select source, trim(line) as line, row_number() over (partition by source order by p, k, j) - 1 as i from e),
f as (select n.source, h.k, n.i from n join h on n.source = h.source and n.line = '# Chapter ' || h.k)
select a.source, cast(a.k as bigint) as k, cast(a.i as bigint) as i, count(b.i) as hits, count(b.i) >= 2 as contents from f a left join f b on a.source = b.source and b.i between a.i - {TOC_NEIGHBOURS} and a.i + {TOC_NEIGHBOURS} and b.k <> a.k group by all""")
def toc_hits(spark: SparkSession, d: str) -> DataFrame:
    """Lines that equal a unit's start, and whether two or more neighbours are other starts, as in a table of contents.

    Lines are counted per document and the counts added up; only heading lines travel on.
    """
    solid = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    heads = F.filter(F.transform("solid", lambda x, j: F.struct(j.alias("j"), F.trim(x).alias("line"))), lambda s: s["line"].startswith("# "))
    df = table(spark, d, "book_docs").select("source", "doc_id", solid.alias("solid")).select("source", "doc_id", F.size("solid").alias("n"), heads.alias("heads"))
    by = W.partitionBy("source").orderBy("doc_id")
    df = df.withColumn("k", F.row_number().over(by).cast("long")).withColumn("start", F.concat(F.lit("# Chapter "), "k"))
    before = F.coalesce(F.sum(F.col("n") + 1).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("base", F.count("*").over(W.partitionBy("source")) + before)
    own = F.array(F.struct((F.col("k") - 1).alias("i"), F.col("start").alias("line")), F.struct(F.col("base").alias("i"), F.col("start").alias("line")))
    inner = F.transform("heads", lambda s: F.struct((F.col("base") + 1 + s["j"]).alias("i"), s["line"].alias("line")))
    lines = df.select("source", F.explode(F.concat(own, inner)).alias("l")).select("source", "l.i", "l.line")
    return contents_hits(lines, df.select("source", "k", "start")).withColumn("contents", F.col("hits") >= TOC_HITS)


def _units(spark: SparkSession, d: str) -> DataFrame:
    return locate_pieces(*chapter_pieces(table(spark, d, "book_docs")))


@query(f"select source, unit_id, a, b from {_UNITS} u where cast(substring(unit_id, 2) as int) % 5 = 0 and cast(substring(unit_id, 2) as int) % 7 <> 0")
def span_invalidate(spark: SparkSession, d: str) -> DataFrame:
    """Units whose span isn't the one stored before: here every fifth had begun one place later, every seventh wasn't stored."""
    return _invalidated(materialise(_units(spark, d).select("source", "unit_id", "a", "b"), "units"))


def _invalidated(after: DataFrame) -> DataFrame:
    k = F.substring("unit_id", 2, 20).try_cast("int")
    before = after.where(k % 7 != 0).withColumn("a", F.col("a") + F.when(k % 5 == 0, 1).otherwise(0))
    return changed_spans(before, after)


@query(f"select source, count(*) as units, cast(sum(b - a) as bigint) as n_chars, cast(sum((b - a) // 4) as bigint) as tokens from {_UNITS} u group by source")
def unit_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("b") - F.col("a")
    return _units(spark, d).groupBy("source").agg(F.count("*").alias("units"), F.sum(n).alias("n_chars"), F.sum(F.floor(n / 4)).cast("long").alias("tokens"))


@query("select source, 'U' || lpad(cast(count(*) + 1 as string), cast(greatest(2, length(cast(count(*) + 1 as string))) as int), '0') as unit_id from book_docs group by source")
def lost_units(spark: SparkSession, d: str) -> DataFrame:
    """Content units that weren't located: here one more unit of each book, whose start no line equals or holds."""
    books, units = chapter_pieces(table(spark, d, "book_docs"))
    more = units.groupBy("source").agg((F.max("k") + 1).alias("k")).withColumn("start", F.lit("# Lost"))
    units = units.unionByName(more)
    return units.select("source", unit_name(F.col("k")).alias("unit_id")).join(locate_pieces(books, units), ["source", "unit_id"], "left_anti")


@query(f"select source, unit_id, b - a as n_chars from {_UNITS} u where b - a < {TINY_CHARS}")
def tiny_units(spark: SparkSession, d: str) -> DataFrame:
    """Content units that are nearly empty, so that their map may be wrong."""
    return tiny(_units(spark, d).withColumn("kind", F.lit("content"))).select("source", "unit_id", (F.col("b") - F.col("a")).alias("n_chars"))


@query(f"""
with c as (select source, unit_id from {_UNITS} u where cast(substring(unit_id, 2) as int) % 5 = 0 and cast(substring(unit_id, 2) as int) % 7 <> 0)
select source, unit_id, unnest(['extract', 'verify', 'fatal']) as kind from c union all select distinct source, '-', 'synthesis' from c""")
def redone_files(spark: SparkSession, d: str) -> DataFrame:
    """Stored answers that changed spans make void: the units' own, and the book's synthesis."""
    units = materialise(_units(spark, d).select("source", "unit_id", "a", "b"), "units")
    after = units.select("source", "unit_id")
    files = after.withColumn("kind", F.explode(F.array(F.lit("extract"), F.lit("verify"), F.lit("fatal"))))
    files = files.unionByName(after.select("source", F.lit("-").alias("unit_id"), F.lit("synthesis").alias("kind")).distinct())
    return redone(_invalidated(units), files)


def map_line(unit: Column, kind: Column, chars: Column, title: Column) -> Column:
    """A unit's line in the overview of a map: name, kind, estimated tokens, the beginning of its title."""
    return F.format_string("   %-5s %-8s ~%,7d tok   %s", unit, kind, F.floor(chars / 4).cast("long"), F.substring(title, 1, 60))


@query(f"select source, unit_id, '   ' || rpad(unit_id, cast(greatest(5, length(unit_id)) as int), ' ') || ' content  ~' || lpad(format('{{:,}}', (b - a) // 4), cast(greatest(7, length(format('{{:,}}', (b - a) // 4))) as int), ' ') || ' tok   ' || substring(repeat(start_line || ' ', 9), 1, 60) as line from {_UNITS} u")
def map_lines(spark: SparkSession, d: str) -> DataFrame:
    u = _units(spark, d)
    title = F.expr("repeat(start_line || ' ', 9)")
    return u.select("source", "unit_id", map_line(F.col("unit_id"), F.lit("content"), F.col("b") - F.col("a"), title).alias("line"))


def unit_texts(units: DataFrame, books: DataFrame) -> DataFrame:
    """(unit_id, source_text): each unit's slice [a, b) of its book; books(book, text), units(unit_id, book, a, b)."""
    return units.join(books, "book").select("unit_id", F.substr("text", F.col("a") + 1, F.col("b") - F.col("a")).alias("source_text"))


@query("""
with u as (select doc_id * 2 as unit_id, substring(text, 1, length(text) // 2) as t from documents union all select doc_id * 2 + 1, substring(text, length(text) // 2 + 1) from documents)
select e.unit_id, e.pos, e.dest, cast(length(t) as bigint) as n_source, md5(t) as source_md5 from entries e join u on u.unit_id = e.unit_id""")
def entry_source_span(spark: SparkSession, d: str) -> DataFrame:
    """Entries beside the source text of their unit; here each document is a book of two units of half its length."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("book"), "text")
    half = F.floor(F.length("text") / 2)
    sides = F.array(*[F.struct((F.col("book") * 2 + k).alias("unit_id"), a.cast("long").alias("a"), b.cast("long").alias("b")) for k, a, b in ((0, F.lit(0), half), (1, half, F.length("text")))])
    units = docs.select("book", F.explode(sides).alias("u")).select("book", "u.*")
    e = table(spark, d, "entries").select("unit_id", "pos", "dest").join(unit_texts(units, docs), "unit_id")
    return e.select("unit_id", "pos", "dest", F.length("source_text").cast("long").alias("n_source"), F.md5("source_text").alias("source_md5"))


def with_tables(items: Column, tables: Column) -> Column:
    """A page's items (struct y, label) with its tables put in one after the other, each before the first item that begins below it."""

    def put(done, t):
        at = F.array_position(F.transform(done, lambda x: x["y"] > t["y"]), True).cast("int")
        head = F.when(at > 0, F.slice(done, F.lit(1), at - 1)).otherwise(done)
        tail = F.when(at > 0, F.slice(done, F.greatest(at, F.lit(1)), F.size(done))).otherwise(F.slice(done, 1, 0))
        return F.concat(head, F.array(t), tail)

    return F.aggregate(tables, items, put)


def _place(items: str, t: str) -> str:
    at = f"coalesce(nullif(list_position(list_transform({items}, lambda x: x.y > {t}.y), true), 0), len({items}) + 1)"
    return f"case when {t} is null then {items} else list_concat(list_concat(list_slice({items}, 1, {at} - 1), [{t}]), list_slice({items}, {at}, len({items}))) end"


@query(f"""
with spans_ as (select page, block, min(y0) as y0 from spans group by page, block),
p as (select page, coalesce(list({{'y': y0, 'label': 'b' || block}} order by block) filter (block > 2), []) as items, any_value({{'y': y0, 'label': 't' || block}}) filter (block = 1) as t1, any_value({{'y': y0, 'label': 't' || block}}) filter (block = 2) as t2 from spans_ group by page),
one as (select page, {_place('items', 't1')} as items, t2 from p), two as (select page, {_place('items', 't2')} as items from one)
select page, array_to_string(list_transform(items, lambda x: x.label), ' ') as placed from two""")
def table_insert_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of a page's blocks with its tables (here the first two boxes) among them; gathered per page, which is small."""
    s = table(spark, d, "spans").groupBy("page", "block").agg(F.min("y0").alias("y")).withColumn("is_table", F.col("block") <= 2)
    item = F.struct("block", F.struct("y", F.concat(F.when(F.col("is_table"), "t").otherwise("b"), F.col("block").cast("string")).alias("label")).alias("s"))
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, item))), lambda x: x["s"])
    p = s.groupBy("page").agg(of(~F.col("is_table")).alias("items"), of(F.col("is_table")).alias("tables"))
    return p.select("page", F.array_join(F.transform(with_tables(F.col("items"), F.col("tables")), lambda x: x["label"]), " ").alias("placed"))


@query("select source, count(*) filter (doc_id % 3 = 0 or contains(text, chr(10) || '|')) as with_tables, count(*) as pages from book_docs group by source")
def table_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages on which a line begins with a pipe; here every third document has one at its end."""
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n|a|b|"))).otherwise(F.col("text"))
    return table(spark, d, "book_docs").groupBy("source").agg(F.count_if(F.contains(t, F.lit("\n|"))).alias("with_tables"), F.count("*").alias("pages"))


def header(title: Column, authors: Column, more: dict[str, Column], unprocessed: Column) -> Column:
    """A YAML header: values as JSON, lines without a value left out, an empty line at the end."""
    lines = [F.lit("---"), F.when(title != "", F.concat(F.lit("title: "), X.json_text(title)))]
    lines.append(F.when(F.size(authors) > 0, F.concat(F.lit("authors: ["), F.array_join(F.transform(authors, X.json_text), ", "), F.lit("]"))))
    lines += [F.when(v != "", F.concat(F.lit(f"{k}: "), X.json_text(v))) for k, v in more.items()]
    lines += [F.concat(F.lit("unprocessed_items: "), unprocessed.cast("string")), F.lit("---")]
    return F.concat(F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), F.lit("\n\n"))


_HEADER = "'---' || chr(10) || 'title: ' || cast(to_json(title) as string) || chr(10) || 'authors: [' || cast(to_json(source) as string) || ', \"x\"]' || chr(10) || case when lang <> 'de' then 'language: \"' || lang || '\"' || chr(10) else '' end || 'source_format: \"md\"' || chr(10) || 'unprocessed_items: ' || (doc_id % 3) || chr(10) || '---' || chr(10) || chr(10)"
_TITLED = "(select *, 'A \"' || source || '\"' as title from documents)"


def _headed(spark: SparkSession, d: str) -> DataFrame:
    lang = F.when(F.col("lang") != "de", F.col("lang")).otherwise("")
    title = F.concat(F.lit('A "'), "source", F.lit('"'))
    h = header(title, F.array("source", F.lit("x")), {"language": lang, "source_format": F.lit("md")}, F.col("doc_id") % 3)
    return table(spark, d, "documents").withColumn("header", h)


@query(f"select doc_id, {_HEADER} as header from {_TITLED}")
def yaml_header(spark: SparkSession, d: str) -> DataFrame:
    return _headed(spark, d).select("doc_id", "header")


@query(f"select doc_id, md5({_HEADER} || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') || chr(10)) as book_md5 from {_TITLED}")
def book_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The header and the tidied text of a converted book."""
    return _headed(spark, d).select("doc_id", F.md5(F.concat("header", X.tidy(F.col("text")))).alias("book_md5"))
