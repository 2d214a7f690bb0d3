"""Queries over documents: text functions, grounding of numbers, damage, deduplication, lines and units."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as X
from ..views import duck, table
from . import jobs

QUERIES, ORACLES = {}, {}
L = "[\\p{L}\\p{M}\\p{N}_]"
#: RE2 has no look-around: each mark between tokens is doubled, so that one may close a token and the other open the next
NUMBERS_DUCK = "list_transform(regexp_extract_all(regexp_replace({t}, '([^\\p{{L}}\\p{{M}}\\p{{N}}_.])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_.])(\\p{{Nd}}+(?:(?:\\.|,,)\\p{{Nd}}+)?)(?:[^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)', 1), lambda x: replace(x, ',,', ','))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


def docs(spark, d, name="documents"):
    return table(spark, d, name)


@query("select doc_id, cast(len(n) as bigint) as n_numbers, array_to_string(n, '|') as numbers from (select doc_id, " + NUMBERS_DUCK.format(t="text") + " as n from documents_dirty)")
def num_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = X.numbers(F.col("text"))
    return docs(spark, d, "documents_dirty").select("doc_id", F.size(n).cast("long").alias("n_numbers"), F.array_join(n, "|").alias("numbers"))


@query(f"""
with lines as (select doc_id, source, text, array_to_string(list_filter(string_split(text, chr(10)), lambda x: not starts_with(lower(trim(x)), 'tags:') and not starts_with(lower(trim(x)), 'src:') and not starts_with(lower(trim(x)), 'evidence:') and not contains(x, '[DERIVED]')), chr(10)) as body from documents_dirty),
n as (select doc_id, source, {NUMBERS_DUCK.format(t='body')} as b, {NUMBERS_DUCK.format(t='text')} as s from lines),
p as (select doc_id, b, coalesce(lag(s) over (partition by source order by doc_id), []) as s from n),
m as (select doc_id, b, list_sort(list_distinct(list_filter(b, lambda x: not list_contains(list_transform(s, lambda y: replace(y, ',', '.')), replace(x, ',', '.')) and length(regexp_replace(x, '[.,]', '', 'g')) > 1))) as m from p)
select doc_id, cast(len(m) as bigint) as n_missing, array_to_string(m[1:12], '|') as missing from m""")
def num_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each document's body that its predecessor of the same source doesn't hold, comma and dot alike; 12 shown in string order.

    The predecessor's numbers, not its text, travel through the window.
    """
    n = docs(spark, d, "documents_dirty").select("doc_id", "source", X.body_numbers(F.col("text")).alias("b"), X.numbers(F.col("text")).alias("s"))
    before = F.lag("s").over(W.partitionBy("source").orderBy("doc_id"))
    p = n.select("doc_id", "b", F.coalesce(before, F.array().cast("array<string>")).alias("before"))
    m = p.select("doc_id", X.missing_numbers(F.col("b"), F.col("before")).alias("m"))
    return m.select("doc_id", F.size("m").cast("long").alias("n_missing"), F.array_join(F.slice("m", 1, 12), "|").alias("missing"))


@query("select doc_id, md5(t) as tidied_md5, cast(length(t) as bigint) as n_chars, t <> text || chr(10) as changed from (select doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') || chr(10) as t from documents_dirty)")
def tidy_text(spark: SparkSession, d: str) -> DataFrame:
    df = docs(spark, d, "documents_dirty").withColumn("t", X.tidy(F.col("text")))
    return df.select("doc_id", F.md5("t").alias("tidied_md5"), F.length("t").cast("long").alias("n_chars"), (F.col("t") != F.concat("text", F.lit("\n"))).alias("changed"))


@query("select page_id, coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(lower(t), '[^a-z0-9\\-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), 1, 70), ''), 'libro') as slug, coalesce(nullif(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'libro') as queue_slug, coalesce(nullif(substring(regexp_replace(upper(replace(t, 'ß', 'ss')), '[^A-Z0-9]', '', 'g'), 1, 6), ''), 'BK') as abbr from (select page_id, regexp_extract(html, '<title>([^<]*)', 1) as t from pages)")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, d, "pages").select("page_id", X.slug(t).alias("slug"), X.slug(t, None, False).alias("queue_slug"), X.abbreviation(t).alias("abbr"))


@query("select doc_id, cast(length(text) // 4 as bigint) as tokens, '$' || format('{:,.2f}', (length(text) // 4) / 1000.0) as cost from documents")
def est_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = X.est_tokens(F.col("text"))
    return docs(spark, d).select("doc_id", t.alias("tokens"), X.money(t / 1000.0).alias("cost"))


@query("""
with k as (select doc_id, text, sha1(text || 'image') as key from documents), u as (select key, count(*) as uses, min(doc_id) as first_doc from k group by key)
select first_doc as doc_id, key, 'ZZOCRZZ' || substring(key, 1, 16) || 'ZZ' as token, uses, uses > 5 as dropped from u""")
def sha_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One job for each content key, the first document's; contents used more than five times are dropped as decoration."""
    k = docs(spark, d).select("doc_id", X.content_key(F.col("text"), F.lit("image")).alias("key"))
    u = k.groupBy("key").agg(F.count("*").alias("uses"), F.min("doc_id").alias("doc_id"))
    return u.select("doc_id", "key", X.token(F.col("key")).alias("token"), "uses", (F.col("uses") > 5).alias("dropped"))


#: fixed values: an image's placeholder, how near captions stand, how often decoration is used at most, characters of a page that isn't a scan
IMAGE_TOKEN = re.compile(r"ZZOCRZZ[0-9a-f]{16}ZZ")
IMAGE_CAPTION = re.compile(rf"(?i)\b({X.CAPTION_WORDS})\s*\d+(?:[.\-]\d+)?")
CAPTION_WINDOW, MOST_USES, SCANNED_CHARS = 500, 5, 100


def token_captions(text: str) -> list[tuple[str, bool]]:
    """Each placeholder of a text, as often as it stands there, and whether a caption is near; other placeholders there count as blanks."""
    out = []
    for m in IMAGE_TOKEN.finditer(text):
        near = text[max(0, m.start() - CAPTION_WINDOW) : m.end() + CAPTION_WINDOW]
        out.append((m[0], IMAGE_CAPTION.search(IMAGE_TOKEN.sub(" ", near)) is not None))
    return out


def image_tokens(texts: DataFrame, decorative: DataFrame | None = None) -> DataFrame:
    """(token, uses, captioned, dropped) of the placeholders in texts(text): those used more than MOST_USES times, or listed in
    decorative(token), are dropped, unless any of their places has a caption near it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [x for t in batch.column(0).to_pylist() for x in token_captions(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([c for _, c in found], pa.bool_())], names=["token", "captioned"])

    found = texts.select(F.col("text").cast("string")).mapInArrow(run, "token string, captioned boolean")
    u = found.groupBy("token").agg(F.count("*").alias("uses"), F.bool_or("captioned").alias("captioned")).withColumn("rule", F.lit(False))
    if decorative is not None:
        u = u.drop("rule").join(decorative.select("token").distinct().withColumn("rule", F.lit(True)), "token", "left")
    drop = (F.col("uses") > MOST_USES) | F.coalesce("rule", F.lit(False))
    return u.select("token", "uses", "captioned", (drop & ~F.col("captioned")).alias("dropped"))


_CAP_TEXT = f"(?i)\\b(?:{X.CAPTION_WORDS})\\s*[0-9]+(?:[.\\-][0-9]+)?"


@query("""
with k as (select 'ZZOCRZZ' || substring(sha1(text || 'image'), 1, 16) || 'ZZ' as token, regexp_matches('                                 ' || substring(text, 1, 499), '"""+_CAP_TEXT+"""') as near from documents_dirty)
select token, count(*) as uses, bool_or(near) as captioned, count(*) > 5 and not bool_or(near) as dropped from k group by token""")
def caption_window(spark: SparkSession, d: str) -> DataFrame:
    """Images of the dirty documents, each set before the text that it is named after: uses, captions near, and whether it goes."""
    t = X.token(X.content_key(F.col("text"), F.lit("image")))
    return image_tokens(docs(spark, d, "documents_dirty").select(F.concat(t, F.lit(" "), "text").alias("text")))


_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"


def _ratio(words: str) -> str:
    return f"(case when len({words}) > 0 then len(list_filter({words}, lambda x: x in {_STOP})) / len({words}) else 0.0 end)"


def _shifted(k: int) -> str:
    to = X.LOWER[k % 26 :] + X.LOWER[: k % 26]
    return f"{_ratio(f"list_transform(w, lambda y: translate(y, '{X.LOWER}', '{to}'))")} >= {X.SHIFT_SHARE}"


_LONG = "list_filter(w, lambda x: length(x) >= 4)"
_MUTE = f"(case when len({_LONG}) > 0 then len(list_filter({_LONG}, lambda x: not regexp_matches(x, '{X.VOWELS}'))) / len({_LONG}) else 0.0 end) >= {X.MUTE_SHARE:.2f}"
_CITED = "(?i)\\bet al\\b|\\bdoi\\b|;\\s*[0-9]+\\s*(?:\\([0-9]+\\))?\\s*:\\s*[0-9]+"
_SUSPECT = f"len(w) >= {X.BLOCK_WORDS} and {_ratio('w')} < {X.STOP_SHARE} and not regexp_matches(t, '{_CITED}') and len(regexp_extract_all(t, '\\b(?:19|20)[0-9][0-9]\\b')) < 2"
_LINES = f"(select doc_id, t, list_transform(regexp_extract_all(t, '{X.WORD}'), lambda x: lower(x)) as w from (select doc_id, unnest(string_split(text, chr(10))) as t from documents_dirty))"
#: documents with the judgement of their blocks, which are their lines
_JUDGED = f"(select d.doc_id, d.text, coalesce(g.garbled, false) as garbled from documents_dirty d left join (select doc_id, bool_or({' or '.join(_shifted(k) for k in X.SHIFTS)} or {_MUTE}) as garbled from (select * from {_LINES} where {_SUSPECT}) group by doc_id) g on g.doc_id = d.doc_id)"


@query(f"select doc_id, garbled from {_JUDGED}")
def garbled_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether any block of a document, here a line, is garbled."""
    return docs(spark, d, "documents_dirty").select("doc_id", F.exists(F.split("text", "\n"), X.garbled).alias("garbled"))


_BOX = f"(?im)^\\s*(?:#+\\s*)?(?:{X.BOX_WORDS})\\s*[A-Z]?[0-9]+(?:[.\\-][0-9]+)?\\b"
_SYM = f"(?m)(?:^|{L[:1]}^{L[1:-1]}$#])[#$]\\s?[0-9]+(?:[.,][0-9]+)?\\s?%|(?:^|[\\s(\\[]),[0-9]|(?:^|[\\s(\\[])\\.[0-9]{{1,3}},[0-9]{{3}}\\b|(?:^|\\s)##\\s?[0-9]"


@query(f"select doc_id, cast(len(regexp_extract_all(text, '[{X.BAD_CHARS[1:-1]}]')) as bigint) as n_bad, regexp_matches(text, '{_SYM}') as symbols, regexp_matches(text, '{_CAP_TEXT}') as caption, regexp_matches(text, '{_BOX}') as line_caption from documents_dirty")
def damage_signs(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, d, "documents_dirty").select("doc_id", F.regexp_count(t, F.lit(X.BAD_CHARS)).cast("long").alias("n_bad"), X.lost_symbols(t).alias("symbols"), t.rlike(X.CAPTION).alias("caption"), t.rlike(X.LINE_CAPTION).alias("line_caption"))


_REASON = f"case when len(regexp_extract_all(text, '[{X.BAD_CHARS[1:-1]}]')) >= {X.BAD_COUNT} then '{X.DAMAGED}' when garbled then '{X.DAMAGED}' when regexp_matches(text, '{_SYM}') then '{X.SYMBOLS}' when regexp_matches(text, '{_BOX}') then '{X.BOXED}' else '' end"


def judged(text: Column) -> Column:
    """The reason of a document as a page: its own text is both texts of the page, its lines are the blocks."""
    return X.unreliable(text, text, F.split(text, "\n"))


@query(f"select doc_id, reason, length(trim(text, ' ' || chr(10) || chr(13) || chr(9))) < 100 as scanned, case when length(trim(text, ' ' || chr(10) || chr(13) || chr(9))) < 100 then 'scan' when reason <> '' then 'vision' else 'native' end as route from (select doc_id, text, {_REASON} as reason from {_JUDGED})")
def page_route(spark: SparkSession, d: str) -> DataFrame:
    """Scanned, then unreliable, then native: the first that holds. Pages with images: see images.page_scans."""
    df = docs(spark, d, "documents_dirty").select("doc_id", judged(F.col("text")).alias("reason"), (F.length(X.strip(F.col("text"))) < SCANNED_CHARS).alias("scanned"))
    return df.withColumn("route", F.when(F.col("scanned"), "scan").when(F.col("reason") != "", "vision").otherwise("native"))


@query(f"select r.reason, count(j.reason) as pages from (select unnest(['{X.DAMAGED}', '{X.SYMBOLS}', '{X.BOXED}']) as reason) r left join (select {_REASON} as reason from {_JUDGED}) j on j.reason = r.reason group by r.reason")
def vision_counters(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the reason why they are read as images, zeros included."""
    n = docs(spark, d, "documents_dirty").select(judged(F.col("text")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(x,) for x in (X.DAMAGED, X.SYMBOLS, X.BOXED)], "reason string")
    return every.join(n, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("pages"))


@query("""
with l as (select source, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from book_docs)
select source, doc_id, cast(i as bigint) as i, cast(coalesce(sum(length(line) + 1) over (partition by source order by doc_id, i rows between unbounded preceding and 1 preceding), 0) as bigint) as line_offset, cast(length(line) as bigint) as n from l""")
def book_lines_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Each line's offset in its book: see line_offsets."""
    return line_offsets(docs(spark, d, "book_docs"))


def line_offsets(df: DataFrame) -> DataFrame:
    """(source, doc_id, i, line_offset, n) of the lines of df(source, doc_id, text), whose texts make a book in the order of doc_id.

    Only lengths are dealt: those of documents by book for where each begins, those of lines by document.
    """
    sizes = df.select("source", "doc_id", (F.length("text") + 1).alias("size"))
    w = W.partitionBy("source").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    begin = sizes.select("source", "doc_id", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("base"))
    lines = df.select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.length(x))).alias("i", "n")).join(begin, "doc_id")
    own = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    off = F.col("base") + F.coalesce(F.sum(F.col("n") + 1).over(own), F.lit(0))
    return lines.select("source", "doc_id", F.col("i").cast("long").alias("i"), off.cast("long").alias("line_offset"), F.col("n").cast("long").alias("n"))


_H = "'# Chapter ' || k"


@query(f"""
with h as (select source, doc_id, row_number() over (partition by source order by doc_id) as k, length(text) as n, count(*) over (partition by source) as m from book_docs),
toc as (select source, sum(length({_H}) + 1) + {len("front a front b front c ")} as t from h group by source),
s as (select h.source, k, n, m, case when m > 2 then t + coalesce(sum(length({_H}) + 2 + n + {len(" end a end b end c")}) over w, 0) else coalesce(sum(length({_H}) + 1) over w, 0) end as p, t + sum(length({_H}) + 2 + n + {len(" end a end b end c")}) over (partition by h.source) - 1 as whole from h join toc on h.source = toc.source window w as (partition by h.source order by k rows between unbounded preceding and 1 preceding))
select source, 'U' || lpad(cast(k as string), cast(greatest(2, length(cast(k as string))) as int), '0') as unit_id, cast(case when k = 1 then 0 else p end as bigint) as a, cast(coalesce(lead(p) over (partition by source order by k), whole) as bigint) as b, k = 1 and m > 2 as toc_skipped,
  {_H} as start_line, case when k = m then '(end of book)' else '# Chapter ' || (k + 1) end as "end" from s""")
def locate_units(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the units of books with a table of contents, found in all lines of their texts: see segment.locate_pieces."""
    from .segment import chapter_pieces, locate_pieces

    return locate_pieces(*chapter_pieces(docs(spark, d, "book_docs"))).drop("k")


@query("""
with b as (select source, string_agg(text, chr(10) order by doc_id) as t from book_docs group by source),
c as (select source, length(t) as n, unnest(regexp_extract_all(t, '[^\\n]*\\n')) as line, generate_subscripts(regexp_extract_all(t, '[^\\n]*\\n'), 1) as i from b),
o as (select source, n, sum(length(line)) over (partition by source order by i) as p from c)
select source, cast(any_value(n) as bigint) as n_chars, cast(arg_min(p, abs(p - n / 2) * 1e9 + p) as bigint) as cut from o where p < n group by source""")
def split_book(spark: SparkSession, d: str) -> DataFrame:
    """The line start nearest to the middle of each book, the earliest of equals; only lengths are gathered for a book."""
    df = docs(spark, d, "book_docs")
    total = df.groupBy("source").agg((F.sum(F.length("text") + 1) - 1).alias("n"))
    p = line_offsets(df).select("source", F.col("line_offset").alias("p")).where("p > 0").join(total, "source").where("p < n")
    best = p.groupBy("source").agg(F.first("n").alias("n_chars"), F.min_by("p", F.struct(F.abs(F.col("p") - F.col("n") / 2), F.col("p"))).alias("cut"))
    return best.select("source", F.col("n_chars").cast("long"), F.col("cut").cast("long"))


#: fixed values: line starts where a book is cut, best first; how far from the ideal place, in parts of a part
CUT_RANKS, CUT_WINDOW = ("# ", "<!-- SECTION", "## "), 0.25


def cuts(text: str, parts: int) -> list[int]:
    """The parts - 1 places where a book is cut, each behind the one before; fewer if the lines don't suffice.

    Near each ideal place the best kind of heading counts, of one kind the nearest, of equals the earliest; where there is
    none, the nearest line start.
    """
    places, at = [], 0
    for line in text.split("\n"):
        places.append((at, next((r for r, x in enumerate(CUT_RANKS) if line.strip().startswith(x)), None)))
        at += len(line) + 1
    out, last, size = [], 0, len(text) / max(parts, 1)
    for k in range(1, parts):
        ideal = size * k
        later = [(p, r) for p, r in places if p > last]
        if not later:
            break
        near = [(r, abs(p - ideal), p) for p, r in later if r is not None and abs(p - ideal) <= size * CUT_WINDOW]
        last = min(near)[2] if near else min((abs(p - ideal), p) for p, _ in later)[1]
        out.append(last)
    return out


def split_parts(books: DataFrame) -> DataFrame:
    """(source, part, a, b) of books(source, text, parts): the half-open spans of the parts of each book, from 1; one book is a row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for source, text, parts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ends = [0, *cuts(text or "", parts or 1), len(text or "")]
                rows += [(source, k + 1, ends[k], ends[k + 1]) for k in range(len(ends) - 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["source", "part", "a", "b"])

    return books.select(F.col("source").cast("string"), F.col("text").cast("string"), F.col("parts").cast("long")).mapInArrow(run, "source string, part long, a long, b long")


#: fixed values: tokens above which a book is big, and of a part of it
BIG_TOKENS, PART_TOKENS = 880_000, 600_000


_RANK = "case " + " ".join(f"when starts_with(trim(line, ' ' || chr(9) || chr(10) || chr(13)), '{x}') then {r}" for r, x in enumerate(CUT_RANKS)) + " end"


@query(f"""
with recursive t as (select source, string_agg(text, chr(10) order by doc_id) as text from book_docs group by source),
b as (select source, text, length(text) as n, case when length(text) // 4 * 1000 > {BIG_TOKENS} then cast(ceil(length(text) // 4 * 1000 / {PART_TOKENS}.0) as bigint) else 1 end as parts from t),
x as (select source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from b),
l as (select source, {_RANK} as r, sum(length(line) + 1) over (partition by source order by i) - length(line) - 1 as p from x),
c(source, k, cut) as (select source, cast(0 as bigint), cast(0 as bigint) from b union all
  select c.source, c.k + 1, cast(min(case when l.r is not null and abs(l.p - b.n / b.parts * (c.k + 1)) <= b.n / b.parts * {CUT_WINDOW} then {{'a': 0, 'r': l.r, 'd': abs(l.p - b.n / b.parts * (c.k + 1)), 'p': l.p}} else {{'a': 1, 'r': 0, 'd': abs(l.p - b.n / b.parts * (c.k + 1)), 'p': l.p}} end).p as bigint)
  from c join b on b.source = c.source and c.k + 1 < b.parts join l on l.source = c.source and l.p > c.cut group by c.source, c.k)
select c.source, c.k + 1 as part, cut as a, cast(coalesce(lead(cut) over (partition by c.source order by c.k), b.n) as bigint) as b from c join b on b.source = c.source""")
def split_book_parts(spark: SparkSession, d: str) -> DataFrame:
    """Spans of each book's parts, as many as its tokens ask for; here tokens count a thousandfold, so that books are big."""
    rows = docs(spark, d, "book_docs").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("r"))
    books = rows.select("source", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"))
    tokens = X.est_tokens(F.col("text")) * 1000
    return split_parts(books.withColumn("parts", F.when(tokens > BIG_TOKENS, F.ceil(tokens / PART_TOKENS)).otherwise(1)))


@query("select doc_id, cast(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|'))) as bigint) as table_lines, md5(regexp_replace(text, '-\\n([a-zß-öø-ÿ])', '\\1', 'g')) as joined_md5 from (select doc_id, replace(text, ' th', '-' || chr(10) || 'th') as text from documents)")
def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    """Words cut at line ends are joined again; here those that begin with th are cut first."""
    t = F.replace("text", F.lit(" th"), F.lit("-\nth"))
    return docs(spark, d).select("doc_id", F.size(F.filter(F.split(t, "\n"), lambda x: x.startswith("|"))).cast("long").alias("table_lines"), F.md5(X.dehyphenate(t)).alias("joined_md5"))


@query("""
with k as (select doc_id, sha1(text || 'page') as key, 'read: ' || text as answer, length(text) as n from documents), c as (select key, any_value(answer) as cached from k where doc_id % 2 = 0 group by key),
f as (select k.*, c.cached, min(doc_id) over (partition by k.key) as first_doc from k left join c on k.key = c.key)
select doc_id, key, case when cached is not null then 'cached' when n < 100 then 'skipped' when doc_id = first_doc then 'ok' else 'shared' end as status, md5(answer) as out_md5 from f""")
def job_cache(spark: SparkSession, d: str) -> DataFrame:
    """Jobs against a cache: hits, pending work done once for each key, and its result shared with the key's other jobs. Texts stay out of the joins."""
    k = docs(spark, d).select("doc_id", X.content_key(F.col("text"), F.lit("page")).alias("key"), F.md5(F.concat(F.lit("read: "), "text")).alias("answer"), F.length("text").alias("n"))
    cache = k.where("doc_id % 2 = 0").groupBy("key").agg(F.first("answer").alias("cached"))
    first = k.groupBy("key").agg(F.min_by("answer", "doc_id").alias("answer"), F.min("doc_id").alias("first_doc"))
    j = k.drop("answer").join(cache, "key", "left").join(first, "key")
    status = F.when(F.col("cached").isNotNull(), "cached").when(F.col("n") < 100, "skipped").when(F.col("doc_id") == F.col("first_doc"), "ok").otherwise("shared")
    return j.select("doc_id", "key", status.alias("status"), F.coalesce("cached", "answer").alias("out_md5"))


def _sql(template: str, **values: str) -> str:
    """A template with fields as a DuckDB expression."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join("'" + p.replace("'", "''") + "'" if k % 2 == 0 else f"({values[p]})" for k, p in enumerate(parts))


_JOBS = """(select doc_id, case cast(doc_id % 8 as int) when 0 then 'ok' when 1 then 'cached' when 2 then 'ok' when 3 then 'truncated' when 4 then 'recitation' when 5 then 'blocked' when 6 then 'failed' else 'skipped' end as status,
  case when doc_id % 3 = 0 then 'page' else 'image' end as kind, 'p. ' || doc_id as label, case when doc_id % 8 = 2 then '[DECORATIVE]' when doc_id % 8 > 3 then '' else text end as text, 'why ' || doc_id % 8 as reason, doc_id % 5 = 0 as captioned,
  case when doc_id % 7 = 0 then '' else text end as native, case when doc_id % 2 = 0 and doc_id % 8 > 3 then 'rows' else '' end as tables from documents)"""
_T = "trim(text, ' ' || chr(10) || chr(13) || chr(9))"
_VALUES = {"label": "label", "reason": "reason", "native": "trim(native, ' ' || chr(10) || chr(13) || chr(9))", "tables": "tables", "text": _T}
_CUT = {**_VALUES, "text": f"{_T} || {_sql(jobs.TRUNCATED_MARK, label='label')}"}


@query(f"""
select doc_id, status, md5(case when status in ('ok', 'cached') and text = '[DECORATIVE]' then case when captioned then {_sql(jobs.CAPTIONED_TEXT, **_VALUES)} else '' end
  when status in ('ok', 'cached') then case when kind = 'image' then {_sql(jobs.IMAGE_TEXT, **_VALUES)} else {_sql(jobs.PAGE_TEXT, **_VALUES)} end
  when kind = 'page' and tables <> '' and native <> '' then {_sql(jobs.TABLES_TEXT, **_VALUES)}
  when status = 'truncated' then case when kind = 'image' then {_sql(jobs.IMAGE_TEXT, **_CUT)} else {_sql(jobs.PAGE_TEXT, **_CUT)} end
  when kind = 'page' then case when native <> '' then {_sql(jobs.NATIVE_TEXT, **_VALUES)} else {_sql(jobs.PAGE_LOST, **_VALUES)} end
  else {_sql(jobs.IMAGE_LOST, **_VALUES)} end) as rendered_md5 from {_JOBS}""")
def render_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The text that stands for a job, by status and kind; failures stay visible."""
    table(spark, d, "documents").createOrReplaceTempView("quire_documents")
    j = spark.sql("select * from " + _JOBS.replace("from documents", "from quire_documents"))
    return j.select("doc_id", "status", F.md5(jobs.rendered()).alias("rendered_md5"))


@query("""
with j as (select 'ZZOCRZZ' || substring(sha1(text || 'image'), 1, 16) || 'ZZ' as token, any_value(md5(text)) as put from documents group by 1),
t as (select doc_id, source, 'ZZOCRZZ' || substring(sha1(text || 'image'), 1, 16) || 'ZZ' as token from book_docs)
select source, string_agg('<' || case when doc_id % 10 = 0 then '' else j.put end || '>', ' ' order by doc_id) as filled from t join j on t.token = j.token group by source""")
def substitute_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders in a book's text give way to their jobs' texts, here hashes; unknown ones to nothing: every tenth is made unknown."""
    df = docs(spark, d, "book_docs").select("doc_id", "source", X.token(X.content_key(F.col("text"), F.lit("image"))).alias("token"), F.md5("text").alias("text"))
    done = df.groupBy("token").agg(F.first("text").alias("text"))
    token = F.when(F.col("doc_id") % 10 == 0, F.lit("ZZOCRZZ" + "0" * 16 + "ZZ")).otherwise(F.col("token"))
    books = df.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", token.alias("token")))).alias("t"))
    books = books.select("source", F.array_join(F.transform("t", lambda s: F.concat(F.lit("<"), s["token"], F.lit(">"))), " ").alias("text"))
    return jobs.substitute(books, done, "source").withColumnRenamed("text", "filled")


@query("select page_id, regexp_extract(html, '<title>([^<]*)', 1) as title, cast(len(regexp_extract_all(html, '<a href=\"[^\"]*\">')) as bigint) as n_links from pages")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="[^"]*">'), F.lit(0))).cast("long").alias("n_links"))


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages as Markdown: headings, bullets, safe links, page breaks and image tokens."""
    from ..sources.html import to_markdown

    return to_markdown(table(spark, d, "pages"), "page_id", "html")
