"""Queries over knowledge entries: grammar, change-sets, tags, identifiers, sections, topics, assembly."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..dims import FALLBACK, LIBRARY, PSEUDO, SECTIONS, TOPIC_SECTIONS, TOPICS, VALID, sql_list
from ..functions import text as X
from ..views import duck, table

QUERIES, ORACLES = {}, {}
#: fixed values: the grammar of entries: head and body, attributes of a head, a destination without its name
ENTRY = r"(?s)<<<ENTRY[ \t]+([^\n]*?)[ \t]*>{1,3}[ \t]*\n(.*?)<<<END>{1,3}"
ATTRIBUTE = r'(?U)(\w+)\s*=\s*"([^"]*)"'
BARE_DEST = r'(?U)^\s*([A-Za-z][A-Za-z0-9_]*)\b"?'
_SECTIONS_DUCK = f"(select unnest({SECTIONS}) as code, generate_subscripts({SECTIONS}, 1) - 1 as ord)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


def ordered(key: str, value: Column | str, sep: str, *order: str) -> Column:
    """The values of a group joined in the order of columns, whatever order they arrive in."""
    value = F.col(value) if isinstance(value, str) else value
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
    return F.array_join(F.transform(rows, lambda s: s["v"]), sep).alias(key)


def entry_texts(entries: DataFrame) -> DataFrame:
    """Raw texts of units (unit_id, raw), in four variants of the grammar, from the entries view."""
    variant = F.col("unit_id") % 4
    head = F.when(variant == 2, F.concat("dest", F.lit('" title="'), "title", F.lit('"'))).otherwise(F.concat(F.lit('dest="'), "dest", F.lit('" title="'), "title", F.lit('"')))
    close = F.when(variant == 0, ">>").when(variant == 1, ">").otherwise(">>>")
    one = F.concat(F.lit("<<<ENTRY "), head, close, F.lit("\n"), F.col("body"), F.lit("\n<<<END>>>"))
    raw = entries.groupBy("unit_id").agg(ordered("raw", one, "\n", "pos"))
    return raw.select("unit_id", F.concat("raw", F.lit('\n<<<ENTRY dest="LOG" title="placeholder">>>\nx\n<<<END>>>\n<<<ENTRY dest="C01" title="cut')).alias("raw"))


def attribute(head: Column, name: str) -> Column:
    """The last value of an attribute of this very name; null if there is none."""
    both = F.arrays_zip(F.regexp_extract_all(head, F.lit(ATTRIBUTE), F.lit(1)).alias("k"), F.regexp_extract_all(head, F.lit(ATTRIBUTE), F.lit(2)).alias("v"))
    return F.try_element_at(F.filter(both, lambda s: s["k"] == name), F.lit(-1))["v"]


def parse_entries_of(units: DataFrame, keep_junk: bool = False) -> DataFrame:
    """(unit_id, pos, dest, title, replace, body) of the entries in raw texts; placeholders and empty bodies are junk and go."""
    found = F.arrays_zip(F.regexp_extract_all("raw", F.lit(ENTRY), F.lit(1)).alias("head"), F.regexp_extract_all("raw", F.lit(ENTRY), F.lit(2)).alias("body"))
    e = units.select("unit_id", F.posexplode(found).alias("pos", "e")).select("unit_id", F.col("pos").cast("long"), "e.head", "e.body")
    dest = F.coalesce(attribute(F.col("head"), "dest"), F.regexp_extract("head", BARE_DEST, 1))
    of = lambda name: X.strip(F.coalesce(attribute(F.col("head"), name), F.lit("")))
    e = e.select("unit_id", "pos", F.upper(X.strip(dest)).alias("dest"), of("title").alias("title"), F.upper(of("replace")).alias("replace"), X.clean_body(F.col("body")).alias("body"))
    return e if keep_junk else e.where("body <> '' and not contains(dest, 'PLACEHOLDER') and lower(title) <> 'placeholder'")


@query("select unit_id, cast(pos as bigint) as pos, dest, trim(title) as title, '' as \"replace\", md5(trim(body, ' ' || chr(10))) as body_md5 from (select *, row_number() over (partition by unit_id order by pos) - 1 as k from entries) where trim(body) <> ''")
def parse_entries(spark: SparkSession, d: str) -> DataFrame:
    e = parse_entries_of(entry_texts(table(spark, d, "entries")))
    return e.select("unit_id", "pos", "dest", "title", "replace", F.md5("body").alias("body_md5"))


@query("select unit_id, cast(count(*) + 2 as bigint) as openings, cast(1 as bigint) as malformed from entries group by unit_id")
def entry_malformed(spark: SparkSession, d: str) -> DataFrame:
    u = entry_texts(table(spark, d, "entries"))
    n = ((F.length("raw") - F.length(F.replace("raw", F.lit("<<<ENTRY"), F.lit("")))) / 8).cast("long")
    return u.select("unit_id", n.alias("openings"), (n - F.size(F.regexp_extract_all("raw", F.lit(ENTRY), F.lit(1)))).cast("long").alias("malformed"))


def verify_texts(ops: DataFrame) -> DataFrame:
    """Raw texts (unit_id, raw) of change-sets in the grammar of entries, from the verify_ops view."""
    n = F.format_string("E%02d", "ordinal")
    head = (
        F.when(F.col("op") == "replace", F.concat(F.lit('dest="'), "dest", F.lit('" title="'), "title", F.lit('" replace="'), n, F.lit('"')))
        .when(F.col("op") == "delete", F.concat(F.lit('dest="DELETE" title="drop '), n, F.lit('"')))
        .when(F.col("op") == "log", F.lit('dest="LOG" title="note"'))
        .otherwise(F.concat(F.lit('dest="'), "dest", F.lit('" title="'), "title", F.lit('"')))
    )
    one = F.concat(F.lit("<<<ENTRY "), head, F.lit(">>>\n"), "body", F.lit("\n<<<END>>>"))
    return ops.groupBy("unit_id").agg(ordered("raw", one, "\n", "pos"))


#: fixed values: how a change-set names an entry
NUMBERED = r"E(\d+)"


def apply_changes(entries: DataFrame, ops: DataFrame) -> DataFrame:
    """(unit_id, place, dest, title, body, state) of entries(unit_id, pos, dest, title, body) after the parsed entries of change-sets.

    Entries are numbered from 1 in their units. Deletion beats replacement, the last replacement of an entry wins with its
    own section and title, numbers out of range change nothing, additions follow in their order, and log entries do nothing.
    """
    number = lambda c: F.nullif(F.regexp_extract(c, NUMBERED, 1), F.lit("")).try_cast("long")
    e = entries.withColumn("ordinal", F.row_number().over(W.partitionBy("unit_id").orderBy("pos")).cast("long"))
    change = ops.where("dest not in ('LOG', 'DELETE')")
    gone = ops.where("dest = 'DELETE'").select("unit_id", number("title").alias("ordinal")).where("ordinal is not null").distinct()
    new = change.where("replace <> ''").select("unit_id", number("replace").alias("ordinal"), "pos", "dest", "title", "body")
    new = new.groupBy("unit_id", "ordinal").agg(F.max_by(F.struct("dest", "title", "body"), "pos").alias("new"))
    kept = e.join(gone, ["unit_id", "ordinal"], "left_anti").join(new, ["unit_id", "ordinal"], "left")
    pick = [F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c) for c in ("dest", "title", "body")]
    kept = kept.select("unit_id", F.lit(0).alias("a"), "ordinal", *pick, F.when(F.col("new").isNotNull(), "corrected").otherwise("kept").alias("state"))
    added = change.where("replace = ''").select("unit_id", F.lit(1).alias("a"), F.col("pos").cast("long").alias("ordinal"), "dest", "title", "body", F.lit("added").alias("state"))
    place = F.row_number().over(W.partitionBy("unit_id").orderBy("a", "ordinal")).cast("long")
    return kept.unionByName(added).select("unit_id", place.alias("place"), "dest", "title", "body", "state")


#: the entries of each unit after its change-set, in SQL over the views
_CHANGED = """(with e as (select book_id, unit_id, row_number() over (partition by unit_id order by pos) as ordinal, dest, trim(title) as title, body from entries),
o as (select * from verify_ops), r as (select unit_id, ordinal, arg_max(dest, pos) as dest, arg_max(title, pos) as title, arg_max(body, pos) as body from o where op = 'replace' group by all),
k as (select e.book_id, e.unit_id, 0 as a, e.ordinal, coalesce(r.dest, e.dest) as dest, coalesce(r.title, e.title) as title, coalesce(r.body, e.body) as body, case when r.body is not null then 'corrected' else 'kept' end as state from e left join r on e.unit_id = r.unit_id and e.ordinal = r.ordinal where not exists (select 1 from o where op = 'delete' and o.unit_id = e.unit_id and o.ordinal = e.ordinal)),
b as (select distinct unit_id, book_id from entries)
select book_id, unit_id, row_number() over (partition by unit_id order by a, ordinal) as place, dest, title, body, state from (select * from k union all select b.book_id, o.unit_id, 1, pos, dest, title, body, 'added' from o join b on b.unit_id = o.unit_id where op = 'add'))"""


def changed_entries(spark: SparkSession, d: str, ops: DataFrame | None = None) -> DataFrame:
    """(book_id, unit_id, place, dest, title, body, state): entries of raw texts after the change-sets of raw texts."""
    raw = table(spark, d, "entries")
    e = parse_entries_of(entry_texts(raw)).where("dest not in ('SUMMARY', 'LOG')")
    out = apply_changes(e, parse_entries_of(verify_texts(table(spark, d, "verify_ops"))) if ops is None else ops)
    return out.join(raw.select("unit_id", "book_id").distinct(), "unit_id")


@query(f"select unit_id, place, dest, title, md5(trim(body, ' ' || chr(10))) as body_md5, state from {_CHANGED}")
def apply_verify(spark: SparkSession, d: str) -> DataFrame:
    """Entries of raw texts after raw change-sets: parsed, numbered, deleted, replaced, added."""
    return changed_entries(spark, d).select("unit_id", "place", "dest", "title", F.md5("body").alias("body_md5"), "state")


def op_counts(ops: DataFrame) -> DataFrame:
    """(unit_id, replaced, deleted, added) of parsed change-sets."""
    other = ~F.col("dest").isin("DELETE", "LOG")
    return ops.groupBy("unit_id").agg(F.count_if(F.col("replace") != "").alias("replaced"), F.count_if(F.col("dest") == "DELETE").alias("deleted"), F.count_if(other & (F.col("replace") == "")).alias("added"))


@query("select unit_id, count(*) filter (op = 'replace') as replaced, count(*) filter (op = 'delete') as deleted, count(*) filter (op = 'add') as added from verify_ops group by unit_id")
def verify_counts(spark: SparkSession, d: str) -> DataFrame:
    return op_counts(parse_entries_of(verify_texts(table(spark, d, "verify_ops"))))


def fix_tags(body: Column, topics=tuple(TOPICS)) -> tuple[Column, Column, Column]:
    """(body with the condition codes of its tags lines cleaned, the unknown codes removed, whether a condition is left).

    A tags line may be indented and in any case; its words come out one space apart. Codes are lower case, each once a
    word; without a vocabulary every code is known.
    """
    lines = F.split(body, "\n")
    is_tags = lambda line: F.lower(X.strip(line)).startswith("tags:")
    pieces = lambda line: F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    is_codes = lambda w: F.lower(w).startswith("condition:")
    codes = lambda w: F.filter(F.transform(F.split(F.substring(w, 11, 1_000_000_000), ","), lambda c: F.lower(X.strip(c))), lambda c: c != "")
    known = (lambda c: c.isin(list(topics))) if topics else (lambda c: F.lit(True))
    good = lambda w: F.array_distinct(F.filter(codes(w), known))

    def fixed(line):
        done = F.transform(pieces(line), lambda w: F.when(~is_codes(w), w).when(F.size(good(w)) > 0, F.concat(F.lit("condition:"), F.array_join(good(w), ","))))
        return F.array_join(F.filter(done, lambda w: w.isNotNull()), " ")

    tags = F.flatten(F.transform(F.filter(lines, is_tags), lambda x: F.filter(pieces(x), is_codes)))
    out = F.array_join(F.transform(lines, lambda x: F.when(is_tags(x), fixed(x)).otherwise(x)), "\n")
    bad = F.flatten(F.transform(tags, lambda w: F.filter(codes(w), lambda c: ~known(c))))
    return out, bad, F.exists(tags, lambda w: F.size(good(w)) > 0)


_A = "trim(substring('renal   diabetessop     general ', cast(1 + 8 * (unit_id % 4) as int), 8))"
_B = "trim(substring('renal   diabetessop     general ', cast(1 + 8 * (pos % 4) as int), 8))"


@query(f"select unit_id, pos, 'tags: type:principle condition:' || {_A} || case when {_A} <> {_B} then ',' || {_B} else '' end as tags, 'bogus' as removed, true as has_condition from entries")
def fix_condition_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags lines cleaned; here they are indented and shouted first."""
    body = F.regexp_replace("body", "(?md)^tags: type:principle  condition:", "  tags:   type:principle \tCondition:")
    fixed, removed, has = fix_tags(body)
    e = table(spark, d, "entries").select("unit_id", "pos", fixed.alias("f"), removed.alias("r"), has.alias("has_condition"))
    return e.select("unit_id", "pos", F.regexp_extract("f", "(?md)^(tags:.*)$", 1).alias("tags"), F.array_join("r", ",").alias("removed"), "has_condition")


_AT = "(select book_id, unit_id, pos, unnest([{a}, {b}, 'bogus']) as code, unnest([0, 1, 2]) as k, dest from entries)".format(a=_A, b=_B)


@query(f"select book_id, code, count(*) as n, arg_min(unit_id, row(unit_id, pos)) as first_unit, arg_min(pos, row(unit_id, pos)) as first_pos from {_AT} where dest in {sql_list(TOPIC_SECTIONS)} group by book_id, code")
def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every condition code of a body in a section that should carry topics counts, as often as it stands there; with the first place of each."""
    found = F.flatten(F.transform(F.regexp_extract_all("body", F.lit("condition:([a-z0-9_,]+)"), F.lit(1)), lambda s: F.split(s, ",")))
    e = table(spark, d, "entries").where(F.col("dest").isin(TOPIC_SECTIONS)).select("book_id", "unit_id", "pos", F.explode(found).alias("code"))
    first = F.min(F.struct("unit_id", "pos"))
    return e.groupBy("book_id", "code").agg(F.count("*").alias("n"), first.alias("f")).select("book_id", "code", "n", F.col("f.unit_id").alias("first_unit"), F.col("f.pos").alias("first_pos"))


#: fixed value: the part of the entries in topic sections that should carry a topic
TOPIC_SHARE = 0.5


def coverage(entries: DataFrame) -> DataFrame:
    """(book_id, useful, tagged, alarm) of entries(book_id, code, has_condition) in the sections that should carry topics."""
    e = entries.where(F.col("code").isin(TOPIC_SECTIONS))
    tagged = F.count_if("has_condition")
    return e.groupBy("book_id").agg(F.count("*").alias("useful"), tagged.alias("tagged"), (tagged < TOPIC_SHARE * F.count("*")).alias("alarm"))


@query(f"select book_id, count(*) as useful, count(*) filter (pos % 3 > 0) as tagged, count(*) filter (pos % 3 > 0) < 0.5 * count(*) as alarm from entries where dest in {sql_list(TOPIC_SECTIONS)} group by book_id")
def topic_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many entries of topic sections carry a known topic; here every third has unknown ones only."""
    body = F.when(F.col("pos") % 3 == 0, F.regexp_replace("body", "condition:[a-z,]+", "condition:bogus")).otherwise(F.col("body"))
    return coverage(table(spark, d, "entries").select("book_id", F.col("dest").alias("code"), fix_tags(body)[2].alias("has_condition")))


def one_of_each_term(entries: DataFrame, glossary: str = "C05") -> DataFrame:
    """entries(book_id, code, place columns `at`, title, body) where of the glossary's with one title the longest stays, the first of equals."""
    term = F.lower(X.strip(F.col("title")))
    g = entries.where(F.col("code") == glossary).withColumn("__term", term)
    cols = [c for c in entries.columns if c != "book_id"]
    best = g.groupBy("book_id", "__term").agg(F.max_by(F.struct(*cols), F.struct(F.length("body"), -F.col("at"))).alias("r"))
    return entries.where(F.col("code") != glossary).unionByName(best.select("book_id", "r.*").select(*entries.columns))


@query("""
with g as (select *, lower(trim(title)) as term, row_number() over (partition by book_id, lower(trim(title)) order by length(body) desc, unit_id, pos) as rn, count(*) over (partition by book_id, lower(trim(title))) as copies from (select book_id, unit_id, pos, substring(trim(title), 1, 3) as title, body from entries))
select book_id, term, unit_id, pos, cast(length(body) as bigint) as n_chars, copies from g where rn = 1""")
def glossary_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of entries with one title the longest body stays, the first of equals; partial aggregates, no window over a hot title. Here all are terms, of three letters."""
    e = table(spark, d, "entries").withColumn("title", F.substring(X.strip(F.col("title")), 1, 3)).withColumn("term", F.lower(X.strip(F.col("title"))))
    best = F.max_by(F.struct("unit_id", "pos", F.length("body").cast("long").alias("n_chars")), F.struct(F.length("body"), -F.col("unit_id"), -F.col("pos")))
    return e.groupBy("book_id", "term").agg(best.alias("r"), F.count("*").alias("copies")).select("book_id", "term", "r.unit_id", "r.pos", "r.n_chars", "copies")


def identified(entries: DataFrame, abbr: str = "BK") -> DataFrame:
    n = F.row_number().over(W.partitionBy("book_id", "code").orderBy("unit_id", "pos"))
    code = F.when(F.col("dest").isin(SECTIONS), F.col("dest")).otherwise(F.lit(FALLBACK))
    return entries.withColumn("code", code).withColumn("id", F.format_string("%s-%s-%03d", F.lit(abbr), "code", n))


@query("select book_id, unit_id, pos, format('BK-{}-{:03d}', dest, row_number() over (partition by book_id, dest order by unit_id, pos)) as id from entries")
def entry_ids(spark: SparkSession, d: str) -> DataFrame:
    return identified(table(spark, d, "entries").drop("body")).select("book_id", "unit_id", "pos", "id")


def by_section(entries: DataFrame) -> DataFrame:
    """(book_id, code, ord, n): entries of every section of every book, zeros included; unknown sections count as the fallback."""
    code = F.when(F.col("dest").isin(SECTIONS), F.col("dest")).otherwise(F.lit(FALLBACK))
    counts = [F.struct(F.lit(c).alias("code"), F.lit(i).alias("ord"), F.count_if(F.col("code") == c).alias("n")) for i, c in enumerate(SECTIONS)]
    return entries.select("book_id", code.alias("code")).groupBy("book_id").agg(F.array(*counts).alias("s")).select("book_id", F.inline("s"))


@query(f"""
with b as (select distinct book_id from entries)
select b.book_id, s.code, cast(s.ord as int) as ord, count(e.dest) as n from b cross join {_SECTIONS_DUCK} s left join entries e on e.book_id = b.book_id and e.dest = s.code group by b.book_id, s.code, s.ord""")
def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return by_section(table(spark, d, "entries"))


def titles(entries: DataFrame) -> DataFrame:
    """(book_id, dest, titles): the titles of each section's entries in order; entries of no section don't count."""
    return entries.where(F.col("dest").isin(VALID) & ~F.col("dest").isin(PSEUDO)).groupBy("book_id", "dest").agg(ordered("titles", "title", " · ", "unit_id", "pos"))


def synthesis_tasks(entries: DataFrame, template: str) -> DataFrame:
    """(book_id, task): the template with a book's summaries and the index of its titles; entries(book_id, unit_id, unit_title, pos, dest, title, body)."""
    one = F.concat(F.lit("### "), F.format_string("U%02d", "unit_id"), F.lit(" — "), "unit_title", F.lit("\n"), "body")
    told = entries.where("dest = 'SUMMARY'").groupBy("book_id").agg(ordered("summaries", one, "\n\n", "unit_id", "pos"))
    index = titles(entries).groupBy("book_id").agg(ordered("entry_index", F.concat("dest", F.lit(": "), "titles"), "\n", "dest"))
    b = entries.select("book_id").distinct().join(told, "book_id", "left").join(index, "book_id", "left")
    return b.select("book_id", X.fill(template, {k: F.coalesce(k, F.lit("")) for k in ("summaries", "entry_index")}).alias("task"))


@query(f"select book_id, dest, string_agg(title, ' · ' order by unit_id, pos) as titles from (select *, case when pos = 2 then 'LOG' when pos = 3 then 'X1' else dest end as d from entries) where d in {sql_list(SECTIONS)} group by book_id, dest")
def title_index(spark: SparkSession, d: str) -> DataFrame:
    """The titles of each section; here some entries are log entries or of no section."""
    dest = F.when(F.col("pos") == 2, "LOG").when(F.col("pos") == 3, "X1").otherwise(F.col("dest"))
    return titles(table(spark, d, "entries").withColumn("dest", dest))


@query(f"""
with e as (select *, case when pos = 0 then 'SUMMARY' else dest end as d from entries), b as (select distinct book_id from e),
s as (select book_id, string_agg('### U' || lpad(cast(unit_id as string), cast(greatest(2, length(cast(unit_id as string))) as int), '0') || ' — T' || unit_id || chr(10) || body, chr(10) || chr(10) order by unit_id) as t from e where d = 'SUMMARY' group by book_id),
i as (select book_id, string_agg(d || ': ' || t, chr(10) order by d) as t from (select book_id, d, string_agg(title, ' · ' order by unit_id, pos) as t from e where d in {sql_list(SECTIONS)} group by book_id, d) group by book_id)
select b.book_id, md5('A ' || coalesce(s.t, '') || ' B ' || coalesce(i.t, '')) as task_md5 from b left join s on s.book_id = b.book_id left join i on i.book_id = b.book_id""")
def synthesis_task(spark: SparkSession, d: str) -> DataFrame:
    """A synthesis's request: summaries of the units, and which entries there are; here each unit's first entry is its summary."""
    e = table(spark, d, "entries").withColumn("dest", F.when(F.col("pos") == 0, "SUMMARY").otherwise(F.col("dest"))).withColumn("unit_title", F.concat(F.lit("T"), "unit_id"))
    return synthesis_tasks(e, "A {summaries} B {entry_index}").select("book_id", F.md5("task").alias("task_md5"))


@query(f"""
with e as (select book_id, dest, unit_id, pos, '### [' || format('BK-{{}}-{{:03d}}', dest, row_number() over (partition by book_id, dest order by unit_id, pos)) || '] ' || title || chr(10) || body as t from entries),
g as (select book_id, dest, string_agg(t, chr(10) || chr(10) order by unit_id, pos) as t from e group by book_id, dest), b as (select distinct book_id from entries)
select b.book_id, s.code, md5('## ' || s.code || chr(10) || coalesce(g.t, 'No content in this section.')) as rendered_md5 from b cross join {_SECTIONS_DUCK} s left join g on g.book_id = b.book_id and g.dest = s.code""")
def render_section(spark: SparkSession, d: str) -> DataFrame:
    """Every section of every book, empty ones with a fixed line."""
    e = identified(table(spark, d, "entries"))
    e = e.withColumn("t", F.concat(F.lit("### ["), "id", F.lit("] "), "title", F.lit("\n"), "body"))
    g = e.groupBy("book_id", "code").agg(ordered("t", "t", "\n\n", "unit_id", "pos"))
    every = e.select("book_id").distinct().withColumn("code", F.explode(F.array(*[F.lit(c) for c in SECTIONS])))
    text = F.concat(F.lit("## "), "code", F.lit("\n"), F.coalesce("t", F.lit("No content in this section.")))
    return every.join(g, ["book_id", "code"], "left").select("book_id", "code", F.md5(text).alias("rendered_md5"))


_CODE = "case when dest in ('C01', 'C02') then 'general' else lower(dest) end"


@query(f"""
with p as (select book_id, unit_id, row_number() over (partition by book_id order by unit_id) as part, trim(title) as title, {_CODE} as domain, {_A} as c, {_B} as s, 1 + unit_id % 3 as units from (select * from entries where pos = 0)),
d as (select book_id, domain, min(part) as k from p group by all), c as (select book_id, c, min(part) as k from p group by all), s as (select book_id, s, min(part) as k from p where not exists (select 1 from c where c.book_id = p.book_id and c.c = p.s) group by all),
i as (select book_id, 'i' || unit_id % 4 as x, min(part) as k from p group by all), u as (select book_id, part, units, cast(sum(units) over (partition by book_id order by part) - units as bigint) as before from p), n as (select book_id, count(*) as n, arg_min(title, part) filter (title <> '') as thesis from p group by book_id),
r as (select book_id, before, part, 'see U' || lpad(cast(before + 1 as string), cast(greatest(2, length(cast(before + 1 as string))) as int), '0') || ' and U09' as x from u)
select n.book_id, n.n as parts, coalesce(n.thesis, '') as thesis, (select string_agg(domain, '|' order by k) from d where d.book_id = n.book_id and (domain <> 'general' or not exists (select 1 from d e where e.book_id = n.book_id and e.domain <> 'general'))) as domains,
  (select string_agg(c, '|' order by k) from c where c.book_id = n.book_id) as conditions, coalesce((select string_agg(s, '|' order by k) from s where s.book_id = n.book_id), '') as secondary, (select string_agg(x, '; ' order by k) from i where i.book_id = n.book_id) as interests,
  (select cast(sum(units) as bigint) from u where u.book_id = n.book_id) as units, (select string_agg(x, '|' order by k) from (select x, min(part) as k from r where r.book_id = n.book_id group by x)) as items
from n where n.n > 1""")
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """The maps of a book's parts merged by all rules; here each conversation is a part with one to three units."""
    p = table(spark, d, "entries").where("pos = 0")
    units = F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("unit_id") % 3), lambda k: F.struct(F.format_string("U%02d", k).alias("id")))
    one = F.struct(X.strip(F.col("title")).alias("thesis"), F.array(F.expr(_CODE)).alias("domains"), F.array(F.expr(_A)).alias("conditions"), F.array(F.expr(_B)).alias("conditions_secondary"), F.concat(F.lit(" i"), (F.col("unit_id") % 4).cast("string")).alias("commercial_interests"), units.alias("units"), F.array(F.lit("see U01 and U09")).alias("cross_unit_items"))
    m = merge_maps(p.select("book_id", F.col("unit_id").alias("part"), F.to_json(one).alias("map")))
    kind = "thesis string, domains array<string>, conditions array<string>, conditions_secondary array<string>, commercial_interests string, cross_unit_items array<string>, units array<struct<id:string>>, _map_parts long"
    m = m.select("book_id", F.from_json("map", kind).alias("m")).where("m._map_parts > 1")
    of = lambda c: F.array_join(f"m.{c}", "|")
    return m.select("book_id", F.col("m._map_parts").alias("parts"), "m.thesis", of("domains").alias("domains"), of("conditions").alias("conditions"), of("conditions_secondary").alias("secondary"), F.col("m.commercial_interests").alias("interests"), F.size("m.units").cast("long").alias("units"), of("cross_unit_items").alias("items"))


#: fixed values: keys of a map by how its parts are merged
MAP_LISTS = ("author_credentials", "domains", "conditions", "conditions_secondary", "cross_unit_items", "notes")
MAP_SCALARS = {"proposed_domain": None, "authority_level": "", "authority_rationale": "", "abbreviation": "", "slug": "", "thesis": ""}


def merged_map(parts: list[dict]) -> dict:
    """One map of a book's parts, in their order; a single part stays as it is.

    Lists are united in order of first mention, secondary conditions go where they are primary ones, 'general' goes beside
    other domains, the first scalar that isn't empty wins (in metadata key by key), commercial interests are joined. Units
    are numbered anew over all parts, and mentions of their old ids in a part's cross references follow.
    """
    if len(parts) == 1:
        return parts[0]
    out, units, lists = dict(parts[0]), [], {k: [] for k in MAP_LISTS}
    for m in parts:
        renamed = {}
        for u in m.get("units") or []:
            units.append(dict(u, id=f"U{len(units) + 1:02d}"))
            if u.get("id"):
                renamed[str(u["id"])] = units[-1]["id"]
        old = re.compile(r"\b(?:" + "|".join(re.escape(k) for k in sorted(renamed, key=len, reverse=True)) + r")\b") if renamed else None
        for key in MAP_LISTS:
            for x in m.get(key) or []:
                if key == "cross_unit_items":
                    x = old.sub(lambda g: renamed[g[0]], str(x)) if old else str(x)
                if x not in lists[key]:
                    lists[key].append(x)
    lists["conditions_secondary"] = [x for x in lists["conditions_secondary"] if x not in lists["conditions"]]
    if len(lists["domains"]) > 1:
        lists["domains"] = [x for x in lists["domains"] if x != "general"]
    metadata: dict = dict(parts[0].get("metadata") or {})
    for m in parts[1:]:
        metadata |= {k: v for k, v in (m.get("metadata") or {}).items() if v and not metadata.get(k)}
    interests = [(m.get("commercial_interests") or "").strip() for m in parts]
    scalars = {k: next((m[k] for m in parts if m.get(k)), none) for k, none in MAP_SCALARS.items()}
    return out | lists | scalars | {"metadata": metadata, "units": units, "commercial_interests": "; ".join(dict.fromkeys(x for x in interests if x)), "_map_parts": len(parts)}


def merge_maps(parts: DataFrame) -> DataFrame:
    """(book_id, map) of parts(book_id, part, map): the maps of a book's parts, as JSON texts, merged into one; see merged_map."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            maps = [json.dumps(merged_map([json.loads(x["map"]) for x in r]), ensure_ascii=False) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.string())], names=["book_id", "map"])

    rows = parts.where("map is not null").groupBy(F.col("book_id").cast("long").alias("book_id")).agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("r"))
    return rows.mapInArrow(run, "book_id long, map string")


#: fixed values: how entries are cut until a synthesis has room for them, with what is told of it; the mark of a cut
CUTS = [
    (True, 0, "completas"),
    (False, 0, "sin los catálogos L1-L5 (no cabían)"),
    (False, 2500, "sin catálogos y acortadas a 2,500 caracteres (no cabían)"),
    (False, 1000, "sin catálogos y acortadas a 1,000 caracteres (no cabían)"),
]
HARD_CUT, CUT_MARK = "recortadas al máximo (no cabían)", " [...]"


def material(entries: DataFrame, most: Column | int, per_char: int = 1) -> DataFrame:
    """(book_id, note, n_chars, text) of entries(book_id, unit_id, unit_title, place, dest, title, body): the first of ever shorter renderings with room in `most` characters.

    Sizes are added up before any text is gathered, and only the chosen rendering is made; if none fits, the shortest is
    cut. Each unit has its heading, entries of no section don't count. per_char: what a character counts.
    """
    most = F.lit(most) if isinstance(most, int) else most
    e = entries.where(F.col("dest").isin(SECTIONS)).withColumn("library", F.col("dest").startswith("L"))
    n = F.length("body")
    head = F.length("dest") + F.length("title") + 4
    size = lambda cut: head + (F.when(n > cut, cut + len(CUT_MARK)).otherwise(n) if cut else n) + 2
    sums = [F.sum(F.when(F.col("library") & (not keep), 0).otherwise(size(cut))).alias(f"s{i}") for i, (keep, cut, _) in enumerate(CUTS)]
    units = entries.groupBy("book_id", "unit_id").agg(F.first("unit_title").alias("unit_title"))
    heads = units.groupBy("book_id").agg(F.sum(F.length(F.concat(F.lit("## "), "unit_id", F.lit(" — "), "unit_title")) + 4).alias("heads"))
    s = heads.join(e.groupBy("book_id").agg(*sums), "book_id", "left")
    total = [((F.col("heads") + F.coalesce(f"s{i}", F.lit(0)) - 2) * per_char).cast("long") for i in range(len(CUTS))]
    level = F.lit(len(CUTS))
    for i in range(len(CUTS) - 1, -1, -1):
        level = F.when(total[i] <= most, i).otherwise(level)
    s = s.select("book_id", level.alias("level"), most.alias("most"))
    e = e.join(s, "book_id").where(~F.col("library") | (F.col("level") == 0))
    cut = F.when(F.col("level") == 2, CUTS[2][1]).when(F.col("level") >= 3, CUTS[3][1])
    body = F.when(n > cut, F.concat(F.substring("body", F.lit(1), cut), F.lit(CUT_MARK))).otherwise(F.col("body"))
    rows = e.select("book_id", "unit_id", F.lit(1).alias("a"), F.col("place").cast("long").alias("place"), F.concat(F.lit("["), "dest", F.lit("] "), "title", F.lit("\n"), body).alias("t"))
    around = units.select("book_id", "unit_id", F.explode(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("## "), "unit_id", F.lit(" — "), "unit_title").alias("t")), F.struct(F.lit(2).alias("a"), F.lit(0).cast("long").alias("place"), F.lit("").alias("t")))).alias("r")).select("book_id", "unit_id", "r.*")
    text = rows.unionByName(around).groupBy("book_id").agg(ordered("text", "t", "\n\n", "unit_id", "a", "place")).join(s, "book_id")
    note = F.element_at(F.array(*[F.lit(x) for *_, x in CUTS], F.lit(HARD_CUT)), F.col("level") + 1)
    text = text.withColumn("text", F.when(F.col("level") == len(CUTS), F.substring("text", F.lit(1), F.floor(F.col("most") / per_char).cast("int"))).otherwise(F.col("text")))
    return text.select("book_id", note.alias("note"), F.length("text").cast("long").alias("n_chars"), "text")


_LIMIT = "cast((15000 + 9000 * (book_id % 4)) as bigint)"


def _rendering(keep: bool, cut: int) -> str:
    body = f"case when length(body) > {cut} then substring(body, 1, {cut}) || ' [...]' else body end" if cut else "body"
    return f"select book_id, string_agg(t, chr(10) || chr(10) order by unit_id, a, pos) as t from (select book_id, unit_id, 1 as a, pos, '[' || dest || '] ' || title || chr(10) || {body} as t from x where {'true' if keep else 'dest not in ' + str(tuple(LIBRARY))} union all select distinct book_id, unit_id, 0, 0, '## ' || unit_id || ' — T' || unit_id from x union all select distinct book_id, unit_id, 2, 0, '' from x) group by book_id"


@query(f"""
with x as (select book_id, unit_id, pos, dest, trim(title) as title, repeat(body, 4) as body from entries), a as ({_rendering(True, 0)}), b as ({_rendering(False, 0)}), c as ({_rendering(False, 2500)}), e as ({_rendering(False, 1000)}),
j as (select a.book_id, {_LIMIT.replace("book_id", "a.book_id")} as most, a.t as a, b.t as b, c.t as c, e.t as e from a join b on a.book_id = b.book_id join c on a.book_id = c.book_id join e on a.book_id = e.book_id),
p as (select book_id, case when length(a) <= most then '{CUTS[0][2]}' when length(b) <= most then '{CUTS[1][2]}' when length(c) <= most then '{CUTS[2][2]}' when length(e) <= most then '{CUTS[3][2]}' else '{HARD_CUT}' end as note, case when length(a) <= most then a when length(b) <= most then b when length(c) <= most then c when length(e) <= most then e else substring(e, 1, most) end as t from j)
select book_id, note, cast(length(t) as bigint) as n_chars, md5(t) as text_md5 from p""")
def budget_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The first of ever shorter renderings of a book's entries that fits its budget; here bodies stand four times, and books have budgets of their own."""
    e = table(spark, d, "entries").select("book_id", "unit_id", F.concat(F.lit("T"), "unit_id").alias("unit_title"), F.col("pos").alias("place"), "dest", X.strip(F.col("title")).alias("title"), F.expr("repeat(body, 4)").alias("body"))
    out = material(e, F.expr(_LIMIT))
    return out.select("book_id", "note", "n_chars", F.md5("text").alias("text_md5"))


def numbered(entries: DataFrame) -> DataFrame:
    """(unit_id, text): the entries of a unit as a change-set's request shows them, numbered from 1; entries(unit_id, pos, dest, title, body)."""
    n = F.row_number().over(W.partitionBy("unit_id").orderBy("pos"))
    one = F.concat(F.format_string("[E%02d] <<<ENTRY dest=\"", "n"), "dest", F.lit('" title="'), "title", F.lit('">>>\n'), "body", F.lit("\n<<<END>>>"))
    return entries.withColumn("n", n).groupBy("unit_id").agg(ordered("text", one, "\n\n", "n"))


@query("select unit_id, md5(string_agg(format('[E{:02d}] <<<ENTRY', n) || ' dest=\"' || dest || '\" title=\"' || title || '\">>>' || chr(10) || body || chr(10) || '<<<END>>>', chr(10) || chr(10) order by n)) as text_md5, count(*) as n from (select *, row_number() over (partition by unit_id order by pos) as n from entries) group by unit_id")
def numbered_entries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entries")
    return numbered(e).join(e.groupBy("unit_id").agg(F.count("*").alias("n")), "unit_id").select("unit_id", F.md5("text").alias("text_md5"), "n")


@query("""
select unit_id, pos, row_number() over (partition by book_id, dest order by case when dest in ('C01', 'C02', 'C03') then 0 else 1 end, case when dest in ('C01', 'C02', 'C03') then -pos else pos end, unit_id) as place from entries""")
def synthesis_order(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the opening sections are put in front one by one, so they come out reversed; others follow."""
    front = F.col("dest").isin("C01", "C02", "C03")
    w = W.partitionBy("book_id", "dest").orderBy(F.when(front, 0).otherwise(1), F.when(front, -F.col("pos")).otherwise(F.col("pos")), "unit_id")
    return table(spark, d, "entries").select("unit_id", "pos", F.row_number().over(w).cast("long").alias("place"))


@query("select e.unit_id, e.pos from entries e where not exists (select 1 from verify_ops o where o.unit_id = e.unit_id and o.ordinal = e.pos + 1)")
def pending_units(spark: SparkSession, d: str) -> DataFrame:
    """Work without a result yet."""
    done = table(spark, d, "verify_ops").select("unit_id", (F.col("ordinal") - 1).alias("pos"))
    return table(spark, d, "entries").select("unit_id", "pos").join(done, ["unit_id", "pos"], "left_anti")


@query("select unit_id, count(*) as n, cast(sum(length(body)) as bigint) as chars, count(*) < greatest(2, sum(length(body)) // 4 // 3000) as low_yield from entries group by unit_id")
def low_yield(spark: SparkSession, d: str) -> DataFrame:
    chars = F.sum(F.length("body"))
    return table(spark, d, "entries").groupBy("unit_id").agg(F.count("*").alias("n"), chars.alias("chars"), (F.count("*") < F.greatest(F.lit(2), F.floor(F.floor(chars / 4) / 3000))).alias("low_yield"))
