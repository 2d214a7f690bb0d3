"""A book's files from its units' answers: entries, change-sets, checks, sections, identifiers, two Markdown files, index, report.

Everything is distributed by unit until the sections are in order; only then are a book's rows gathered, which one book bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..dims import CORE, CORE_NAMES, FALLBACK, LIBRARY, LIBRARY_NAMES, SECTIONS, TOPIC_SECTIONS, TOPICS, sql_list
from ..functions import text as X
from ..staging import materialise
from ..views import duck, table
from .documents import NUMBERS_DUCK
from .knowledge import _CHANGED, NUMBERED, changed_entries, coverage, fix_tags, one_of_each_term, ordered, parse_entries_of, verify_texts
from .rules import without_topics

QUERIES, ORACLES = {}, {}
NAMES = CORE_NAMES | LIBRARY_NAMES
#: fixed values: sections whose synthesis stands in front
FRONT = ("C01", "C02", "C03")
#: fixed values: lines of the two files
EMPTY_SECTION, LIBRARY_TITLE, EMPTY_LIBRARY = "No content in this section.", "Contents of the library file", "The library file is empty for this book."
CORE_COMPANION = "Companion file: `{companion}` (full plans, workouts, exercises, recipes, templates). IDs like `{abbr}-L2-004` point there."
LIBRARY_COMPANION = "Companion file: `{companion}` (principles, zones, tables, rules, cautions)."
PARTIAL = "> PARTIAL KB — only these units were extracted: {units}."
#: fixed values: warnings, and how much of a title and how many numbers they show
NO_VERIFY = "{unit}: sin VERIFY"
CUT_SHORT = "{unit}: la extracción se cortó por longitud (revisar; dividir la unidad)"
BAD_CODES = "{unit} · {title}: etiqueta condition: desconocida ({codes}); se quitó"
BAD_DEST = "{unit}: entrada con sección desconocida '{dest}' → C10: {title}"
NUMBERS = "{unit} · {title}: números que no aparecen en el capítulo: {numbers}"
SYNTHESIS_NUMBERS = "SYNTHESIS · {title}: números que no aparecen en el libro: {numbers}"
NO_TOPICS = "TEMAS: El MAP no declaró ningún tema principal para un libro clínico (dominio: {domains}). Sin temas, el sistema de nutrición nunca usaría este libro."
FEW_TOPICS = "TEMAS: solo {tagged} de {useful} entradas útiles (secciones {sections}) llevan condition:. El sistema de nutrición las encontraría poco; conviene repetir la extracción."
TITLE_SHOWN, NUMBERS_SHOWN, RATIONALE_SHOWN, NAME_WIDTH, RULE = 60, 12, 120, 45, 64
#: fixed values: lines of the report
REPORT = {
    "head": "REPORTE DE EXTRACCIÓN", "book": "Libro      : ", "input": "Entrada    : ", "model": "Modelo     : ", "date": "Fecha      : ", "coverage": "Cobertura  : ",
    "partial": "PARCIAL: ", "complete": "completa", "entries": "Entradas   : ", "corrected": "  (corregidas por VERIFY: ", "added": ", agregadas: ", "deleted": ", eliminadas: ",
    "sections": "Por sección:", "topics": "Temas (sistema de nutrición):", "primary": "   Principales : ", "secondary": "   Secundarios : ", "tagged": "   Entradas con condition: ",
    "useful": " útiles para una dieta (secciones {sections})", "by": "   Por tema    : ", "cost": "Costo total: ", "warnings": "AVISOS (", "none": "(ninguno)",
    "note": "Nota: 'números que no aparecen en el capítulo' es una revisión automática;", "note2": "puede ser un valor derivado legítimo o un error. Revisar esos casos.", "log": "BITÁCORA (LOG)",
}
NO_AUTHOR = "autor"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


def checked(entries: DataFrame, sources: DataFrame, topics=tuple(TOPICS)) -> DataFrame:
    """entries(book_id, unit_id, place, dest, title, body, state) with cleaned bodies and code, bad_dest, has_condition, bad_codes, missing.

    sources(unit_id, numbers): the number tokens of each unit's text. code: the section, the fallback for an unknown one;
    missing: numbers of the body that the source hasn't, in string order.
    """
    fixed, bad, has = fix_tags(F.col("body"), topics)
    e = entries.withColumn("bad_codes", bad).withColumn("has_condition", has).withColumn("body", fixed)
    e = e.join(sources, "unit_id", "left")
    none = F.coalesce("numbers", F.array().cast("array<string>"))
    known = F.col("dest").isin(SECTIONS)
    return e.withColumn("missing", X.missing_numbers(X.body_numbers(F.col("body")), none)).withColumn("code", F.when(known, F.col("dest")).otherwise(FALLBACK)).withColumn("bad_dest", ~known).drop("numbers")


def stats(entries: DataFrame, deleted: DataFrame) -> DataFrame:
    """(book_id, entries, corrected, added, deleted, bad_dest); deleted(book_id, n): numbers that change-sets delete, out of range or not."""
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    s = entries.groupBy("book_id").agg(F.count("*").alias("entries"), of("corrected"), of("added"), F.count_if("bad_dest").alias("bad_dest"))
    return s.join(deleted.groupBy("book_id").agg(F.sum("n").cast("long").alias("deleted")), "book_id", "left").select("book_id", "entries", "corrected", "added", F.coalesce("deleted", F.lit(0)).cast("long").alias("deleted"), "bad_dest")


def in_sections(entries: DataFrame, synthesis: DataFrame) -> DataFrame:
    """(book_id, code, at, unit, title, body, has_condition): the entries of each section in order, with those of a synthesis.

    Entries follow their units; a synthesis entry goes to the front of an opening section, one before the other, and to the
    end of any other. synthesis(book_id, pos, dest, title, body): its unknown sections are left out.
    """
    own = entries.select("book_id", "code", F.lit(1).alias("a"), F.col("unit_id").cast("long").alias("b"), F.col("place").cast("long").alias("c"), F.format_string("U%02d", "unit_id").alias("unit"), "title", "body", "has_condition")
    front = F.col("dest").isin(list(FRONT))
    pos = F.col("pos").cast("long")
    more = synthesis.where(F.col("dest").isin(SECTIONS)).select("book_id", F.col("dest").alias("code"), F.when(front, 0).otherwise(2).alias("a"), F.when(front, -pos).otherwise(pos).alias("b"), F.lit(0).cast("long").alias("c"), F.lit("SYNTHESIS").alias("unit"), "title", "body", F.lit(False).alias("has_condition"))
    at = F.row_number().over(W.partitionBy("book_id", "code").orderBy("a", "b", "c"))
    return own.unionByName(more).withColumn("at", at).drop("a", "b", "c")


def with_ids(entries: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """entries(book_id, code, at, unit, title, body, ...) with the glossary's repeats gone, each section numbered, and the library listed in C18."""
    e = one_of_each_term(entries).join(abbreviations, "book_id")
    order = F.when(F.col("code") == "C05", F.lower("title")).otherwise("")
    n = F.row_number().over(W.partitionBy("book_id", "code").orderBy(order, "at"))
    e = e.where("code <> 'C18'").withColumn("n", n).withColumn("id", F.format_string("%s-%s-%03d", "abbr", "code", "n"))
    listed = e.where(F.col("code").isin(LIBRARY)).groupBy("book_id", "code").agg(ordered("t", F.concat(F.lit("- "), "id", F.lit(" — "), "title"), "\n", "n"))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in LIBRARY_NAMES.items() for x in kv]), F.col("code"))
    listed = listed.select("book_id", "code", F.concat(F.lit("**"), "code", F.lit(" "), name, F.lit("**\n"), "t", F.lit("\n")).alias("t")).groupBy("book_id").agg(ordered("body", "t", "\n", "code"))
    c18 = abbreviations.join(listed, "book_id", "left").select("book_id", F.lit("C18").alias("code"), F.lit(1).alias("n"), F.format_string("%s-C18-001", "abbr").alias("id"), F.lit("-").alias("unit"), F.lit(LIBRARY_TITLE).alias("title"), F.coalesce(X.strip(F.col("body")), F.lit(EMPTY_LIBRARY)).alias("body"), F.lit(False).alias("has_condition"))
    return e.select(c18.columns).unionByName(c18)


def json_list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, X.json_text), ", "), F.lit("]"))


#: fixed values: keys of a file's header, in order, and where each comes from; the lists among them
HEADER = {
    "title": "title",
    "subtitle": "subtitle",
    "authors": "authors",
    "edition": "edition",
    "year": "year",
    "publisher": "publisher",
    "language": "language",
    "domains": "domains",
    "conditions": "conditions",
    "conditions_secondary": "conditions_secondary",
    "authority_level_suggested": "authority_level",
    "authority_rationale": "authority_rationale",
    "author_credentials": "author_credentials",
    "commercial_interests": "commercial_interests",
    "abbreviation": "abbr",
    "source_file": "source_file",
    "kb_version": "kb_version",
    "extracted": "extracted",
    "model": "model",
    "coverage": "coverage",
}
LISTS = ("authors", "domains", "conditions", "conditions_secondary", "author_credentials")


def _value(name: str) -> Column:
    if name in LISTS:
        return json_list(F.coalesce(name, F.array().cast("array<string>")))
    return X.json_text(F.coalesce(F.col(name).cast("string"), F.lit("")))


def title_line() -> Column:
    return F.concat(F.array_join("authors", ", "), F.lit(" — "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce("year", F.lit("")), F.lit(")"))


def described(maps: DataFrame, wanted: DataFrame, done: DataFrame) -> DataFrame:
    """maps(book_id, slug, abbreviation, title, authors, ...) with abbr, covered (unit names), partial and coverage; wanted, done: (book_id, unit_id).

    A map without a slug gets one from its first author and title.
    """
    units = wanted.join(done.withColumn("done", F.lit(True)), ["book_id", "unit_id"], "left")
    own = units.groupBy("book_id").agg(F.array_sort(F.collect_list(F.when(F.col("done"), F.col("unit_id")))).alias("u"), F.count_if(F.col("done").isNull()).alias("open"))
    covered = F.array_join(F.transform("u", lambda k: F.format_string("U%02d", k)), ", ")
    given = F.concat(F.coalesce(F.get("authors", F.lit(0)), F.lit(NO_AUTHOR)), F.lit("-"), F.coalesce("title", F.lit("")))
    maps = maps.withColumn("slug", X.slug(F.coalesce(F.nullif("slug", F.lit("")), given)))
    m = maps.withColumn("abbr", X.abbreviation(F.coalesce("abbreviation", F.lit("")))).join(own, "book_id", "left")
    m = m.withColumn("covered", F.coalesce(covered, F.lit(""))).withColumn("partial", F.coalesce(F.col("open"), F.lit(0)) > 0).drop("u", "open")
    return m.withColumn("coverage", F.when(F.col("partial"), F.concat(F.lit("partial: "), "covered")).otherwise("complete"))


def files(entries: DataFrame, maps: DataFrame) -> DataFrame:
    """(book_id, kind, name, text): both files of every book; entries(book_id, code, n, id, title, body), maps: see described."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("code"))
    one = F.concat(F.lit("### ["), "id", F.lit("] "), "title", F.lit("\n\n"), "body", F.lit("\n"))
    own = entries.groupBy("book_id", "code").agg(ordered("t", one, "\n", "n"))
    every = maps.select("book_id").withColumn("code", F.explode(F.array(*[F.lit(c) for c in SECTIONS])))
    sections = every.join(own, ["book_id", "code"], "left").select("book_id", F.when(F.col("code").isin(CORE), "CORE").otherwise("LIBRARY").alias("kind"), "code", F.concat(F.lit("## "), "code", F.lit(" "), name, F.lit("\n\n"), F.coalesce("t", F.lit(EMPTY_SECTION + "\n"))).alias("t"))
    bodies = sections.groupBy("book_id", "kind").agg(ordered("sections", "t", "\n", "code"))
    head = F.concat(F.lit("---\n"), *[F.concat(F.lit(f"{k}: "), _value(c), F.lit("\n")) for k, c in HEADER.items()], F.lit("---\n\n"))
    m = maps.withColumn("head", head).withColumn("line", title_line())
    both = bodies.join(m, "book_id")
    core = F.col("kind") == "CORE"
    file = lambda suffix: F.concat("slug", F.lit(suffix))
    companion = F.when(core, X.fill(CORE_COMPANION, {"companion": file("_biblioteca.md"), "abbr": F.col("abbr")})).otherwise(X.fill(LIBRARY_COMPANION, {"companion": file("_core.md")}))
    partial = F.when(F.col("partial"), F.concat(F.lit("\n\n"), X.fill(PARTIAL, {"units": F.col("covered")}))).otherwise("")
    text = F.concat("head", F.lit("# KB "), "kind", F.lit(" — "), "line", F.lit("\n\n"), companion, partial, F.lit("\n\n"), F.regexp_replace("sections", r"(?U)\s+$", ""), F.lit("\n"))
    return both.select("book_id", "kind", F.when(core, file("_core.md")).otherwise(file("_biblioteca.md")).alias("name"), text.alias("text"))


def index_records(maps: DataFrame) -> DataFrame:
    """(book_id, record): the entry of each book in the index, as JSON; a year of four digits is a number."""
    year = F.regexp_extract(F.coalesce("year", F.lit("")), r"\d{4}", 0)
    ano = F.when(year != "", year.cast("int").cast("string")).otherwise(X.json_text(F.coalesce("year", F.lit(""))))
    parts = {
        "archivo": X.json_text(F.concat("slug", F.lit("_core.md"))),
        "biblioteca": X.json_text(F.concat("slug", F.lit("_biblioteca.md"))),
        "titulo": _value("title"),
        "autor": X.json_text(F.array_join("authors", ", ")),
        "ano": ano,
        "nivel": _value("authority_level"),
        "dominios": _value("domains"),
        "temas": _value("conditions"),
        "temas_secundarios": _value("conditions_secondary"),
        "nota": _value("authority_rationale"),
    }
    record = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in parts.items()]), F.lit("}"))
    return maps.select("book_id", record.alias("record"))


def map_warnings(maps: DataFrame) -> DataFrame:
    """(book_id, a, b, c, line) of what a book's map itself warns of, before all else: a clinical map without topics, then its own lines.

    maps(book_id, domains, conditions, conditions_secondary, clinical_scope, topic_warnings, unit_warnings).
    """
    none = F.array().cast("array<string>")
    topics = F.size(F.coalesce("conditions", none)) + F.size(F.coalesce("conditions_secondary", none))
    domains = F.coalesce(F.nullif(F.array_join(F.coalesce("domains", none), ", "), F.lit("")), F.lit("?"))
    lost = maps.where((topics == 0) & without_topics(F.col("clinical_scope"), F.coalesce("domains", none), F.col("conditions")))
    lost = lost.select("book_id", F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), X.fill(NO_TOPICS, {"domains": domains}).alias("line"))
    own = maps.select("book_id", F.posexplode(F.concat(F.coalesce("topic_warnings", none), F.coalesce("unit_warnings", none))).alias("k", "line"))
    return lost.unionByName(own.select("book_id", F.lit(0).alias("a"), (F.col("k") + 1).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), "line"))


def synthesis_warnings(synthesis: DataFrame, numbers: DataFrame) -> DataFrame:
    """(book_id, a, b, c, line), after all units', of synthesis entries (see in_sections) with numbers that their book lacks.

    numbers(book_id, numbers): number tokens of a book, in as many rows as they come in; they meet the entries' by value.
    """
    plain = lambda c: F.replace(c, F.lit(","), F.lit("."))
    none = F.array().cast("array<string>")
    told = synthesis.where(F.col("dest").isin(SECTIONS)).select("book_id", "pos", "title", F.explode(X.missing_numbers(X.body_numbers(F.col("body")), none)).alias("x"))
    known = numbers.select("book_id", F.explode("numbers").alias("y")).select("book_id", plain(F.col("y")).alias("y")).distinct()
    left = told.join(known, (told.book_id == known.book_id) & (plain(F.col("x")) == F.col("y")), "left_anti")
    lines = left.groupBy("book_id", "pos", "title").agg(F.array_sort(F.collect_list("x")).alias("m"))
    line = X.fill(SYNTHESIS_NUMBERS, {"title": F.substring("title", 1, TITLE_SHOWN), "numbers": F.array_join(F.slice("m", 1, NUMBERS_SHOWN), ", ")})
    return lines.select("book_id", F.lit(2).alias("a"), F.col("pos").cast("long").alias("b"), F.lit(0).cast("long").alias("c"), line.alias("line"))


def deletions(ops: DataFrame) -> DataFrame:
    """(unit_id, n): how many different numbers the parsed change-set of a unit deletes, out of range or not."""
    number = F.nullif(F.regexp_extract("title", NUMBERED, 1), F.lit("")).try_cast("long")
    return ops.where("dest = 'DELETE'").groupBy("unit_id").agg(F.count_distinct(number).alias("n")).where("n > 0")


def logged(parsed: DataFrame, later: int = 0) -> DataFrame:
    """The log entries (unit_id, b, c, unit, title, body) of parsed answers of units, for a report; those of `later` answers follow."""
    return parsed.where("dest = 'LOG'").select("unit_id", F.col("unit_id").cast("long").alias("b"), (F.col("pos") + (later << 40)).cast("long").alias("c"), F.format_string("U%02d", "unit_id").alias("unit"), "title", "body")


def synthesis_log(synthesis: DataFrame) -> DataFrame:
    """The log entries (book_id, b, c, unit, title, body) of syntheses, which come last."""
    return synthesis.where("dest = 'LOG'").select("book_id", F.lit(1 << 62).cast("long").alias("b"), F.col("pos").cast("long").alias("c"), F.lit("SYNTHESIS").alias("unit"), "title", "body")


def warnings(entries: DataFrame, units: DataFrame, covered: DataFrame, topics: DataFrame) -> DataFrame:
    """(book_id, a, b, c, line) of a book's warnings in order: topics first, then each unit's, then its entries'.

    entries: see checked; units(book_id, unit_id, verified, truncated); covered: see knowledge.coverage; topics(book_id): books
    whose map has topics.
    """
    unit, title = F.format_string("U%02d", "unit_id"), F.substring("title", 1, TITLE_SHOWN)
    row = lambda a, b, c, line: [F.lit(a).alias("a") if isinstance(a, int) else a.alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"), line.alias("line")]
    few = covered.where("useful > 0 and alarm").join(topics, "book_id", "left_semi")
    few = few.select("book_id", *row(0, F.lit(0), F.lit(0), X.fill(FEW_TOPICS, {"tagged": F.col("tagged").cast("string"), "useful": F.col("useful").cast("string"), "sections": F.lit(", ".join(TOPIC_SECTIONS))})))
    no = units.where("not verified").select("book_id", *row(1, F.col("unit_id"), F.lit(-2), X.fill(NO_VERIFY, {"unit": unit})))
    short = units.where("truncated").select("book_id", *row(1, F.col("unit_id"), F.lit(-1), X.fill(CUT_SHORT, {"unit": unit})))
    codes = F.array_join(F.array_sort(F.array_distinct("bad_codes")), ", ")
    told = F.array(
        F.when(F.size("bad_codes") > 0, X.fill(BAD_CODES, {"unit": unit, "title": title, "codes": codes})),
        F.when(F.col("bad_dest"), X.fill(BAD_DEST, {"unit": unit, "dest": F.col("dest"), "title": title})),
        F.when(F.size("missing") > 0, X.fill(NUMBERS, {"unit": unit, "title": title, "numbers": F.array_join(F.slice("missing", 1, NUMBERS_SHOWN), ", ")})),
    )
    own = entries.select("book_id", "unit_id", "place", F.posexplode(told).alias("k", "line")).where("line is not null")
    own = own.select("book_id", *row(1, F.col("unit_id"), F.col("place") * 3 + F.col("k"), F.col("line")))
    return few.unionByName(no).unionByName(short).unionByName(own)


def report_lines(maps: DataFrame, counted: DataFrame, sections: DataFrame, covered: DataFrame, codes: DataFrame, costs: DataFrame, told: DataFrame, logs: DataFrame) -> DataFrame:
    """(book_id, a, b, c, line): the report of each book.

    counted: see stats; sections(book_id, code, n); codes(book_id, code, n, first); costs(book_id, stage, ord, cost);
    told: see warnings; logs(book_id, b, c, unit, title, body).
    """
    m = maps.join(counted, "book_id", "left").join(covered, "book_id", "left").withColumn("line0", title_line())
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    none = lambda c: F.coalesce(F.nullif(F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", "), F.lit("")), F.lit(REPORT["none"]))
    money = costs.groupBy("book_id").agg(F.sum("cost").alias("cost"))
    by = codes.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "code"))), lambda s: F.concat(s["code"], F.lit(" "), (-s["n"]).cast("string"))), ", ").alias("by"))
    many = told.groupBy("book_id").agg(F.count("*").alias("warned"))
    m = m.join(money, "book_id", "left").join(by, "book_id", "left").join(many, "book_id", "left")
    head = [
        F.lit(REPORT["head"]),
        F.lit("=" * RULE),
        F.concat(F.lit(REPORT["book"]), "line0"),
        F.concat(F.lit(REPORT["input"]), "source_file"),
        F.concat(F.lit(REPORT["model"]), "model"),
        F.concat(F.lit(REPORT["date"]), "extracted"),
        F.concat(F.lit(REPORT["coverage"]), F.when(F.col("partial"), F.concat(F.lit(REPORT["partial"]), "covered")).otherwise(REPORT["complete"])),
        F.lit(""),
        F.concat(F.lit(REPORT["entries"]), n("entries"), F.lit(REPORT["corrected"]), n("corrected"), F.lit(REPORT["added"]), n("added"), F.lit(REPORT["deleted"]), n("deleted"), F.lit(")")),
        F.lit(REPORT["sections"]),
    ]
    topics = [
        F.lit(""),
        F.lit(REPORT["topics"]),
        F.concat(F.lit(REPORT["primary"]), none("conditions")),
        F.concat(F.lit(REPORT["secondary"]), none("conditions_secondary")),
        F.concat(F.lit(REPORT["tagged"]), n("tagged"), F.lit(" de "), n("useful"), F.lit(REPORT["useful"].format(sections=", ".join(TOPIC_SECTIONS)))),
        F.when(F.col("by").isNotNull(), F.concat(F.lit(REPORT["by"]), "by")),
        F.lit(""),
        F.concat(F.lit(REPORT["cost"]), X.money(F.coalesce("cost", F.lit(0.0))), F.lit(" USD")),
    ]
    notes = [F.lit(""), F.concat(F.lit(REPORT["warnings"]), n("warned"), F.lit(")")), F.lit("-" * RULE), F.when(F.col("warned").isNull(), F.lit("  " + REPORT["none"]))]
    end = ["", REPORT["note"], REPORT["note2"], "", REPORT["log"], "-" * RULE]
    fixed = [(0, head), (2, topics), (4, notes), (6, [F.lit(x) for x in end])]
    lines = m.select("book_id", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(i).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), x.alias("line")) for a, xs in fixed for i, x in enumerate(xs)])).alias("r")).select("book_id", "r.*").where("line is not null")
    at = F.array_position(F.array(*[F.lit(c) for c in SECTIONS]), F.col("code")).cast("long")
    name = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("code"))
    per = sections.select("book_id", F.lit(1).alias("a"), at.alias("b"), F.lit(0).cast("long").alias("c"), F.concat(F.lit("   "), "code", F.lit(" "), F.rpad(name, F.greatest(F.lit(NAME_WIDTH), F.length(name)), F.lit(" ")), F.lit(" "), F.col("n").cast("string")).alias("line"))
    cost = costs.select("book_id", F.lit(3).alias("a"), F.col("ord").cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.concat(F.lit("   "), F.rpad("stage", F.greatest(F.lit(10), F.length("stage")), F.lit(" ")), F.lit(" "), X.money(F.col("cost"))).alias("line"))
    rank = F.row_number().over(W.partitionBy("book_id").orderBy("a", "b", "c")).cast("long")
    warned = told.select("book_id", F.lit(5).alias("a"), rank.alias("b"), F.lit(0).cast("long").alias("c"), F.concat(F.lit("  - "), "line").alias("line"))
    log = logs.select("book_id", F.lit(7).alias("a"), F.col("b").cast("long").alias("b"), F.col("c").cast("long").alias("c"), F.concat(F.lit("["), "unit", F.lit("] "), "title", F.lit("\n"), "body", F.lit("\n")).alias("line"))
    out = lines
    for part in (per, cost, warned, log):
        out = out.unionByName(part)
    return out


def report(lines: DataFrame) -> DataFrame:
    """(book_id, text) of report_lines."""
    return lines.groupBy("book_id").agg(ordered("text", "line", "\n", "a", "b", "c"))


# ---------------------------------------------------------------- queries over derived books

_SOURCES = f"(select conv_id as unit_id, {NUMBERS_DUCK.format(t='t')} as numbers from (select conv_id, string_agg(text, ' / ' order by turn) as t from conversations group by conv_id))"
_LINES = "array_to_string(list_filter(string_split(body, chr(10)), lambda x: not starts_with(lower(trim(x)), 'tags:') and not starts_with(lower(trim(x)), 'src:')), chr(10))"
_CHECKED = f"""(select *, list_sort(list_distinct(list_filter(own, lambda x: not list_contains(list_transform(numbers, lambda y: replace(y, ',', '.')), replace(x, ',', '.')) and length(regexp_replace(x, '[.,]', '', 'g')) > 1))) as missing from
  (select c.book_id, c.unit_id, c.place, c.dest, c.title, regexp_replace(trim(c.body, ' ' || chr(10)), 'tags: type:principle  condition:([a-z]+),([a-z]+),bogus', case when regexp_extract(c.body, 'condition:([a-z]+),', 1) = regexp_extract(c.body, 'condition:[a-z]+,([a-z]+),', 1) then 'tags: type:principle condition:\\1' else 'tags: type:principle condition:\\1,\\2' end) as body, c.state, c.dest not in {sql_list(SECTIONS)} as bad_dest, case when c.dest in {sql_list(SECTIONS)} then c.dest else 'C10' end as code,
    c.state = 'kept' as has_condition, {NUMBERS_DUCK.format(t='lines')} as own, s.numbers from (select *, {_LINES} as lines from {_CHANGED}) c join {_SOURCES} s on s.unit_id = c.unit_id))"""
_SYNTHESIS = "(select book_id, pos, dest, 'Synthesis ' || pos as title, 'all of it, ' || dest || case when pos = 3 then ' 77.5 mg of 12 or 31' else '' end as body from (select distinct book_id from entries) b cross join (values (0, 'C01'), (1, 'C09'), (2, 'C01'), (3, 'L2'), (4, 'ZZ'), (5, 'C05'), (6, 'LOG')) v(pos, dest))"
_SLUG = "case when book_id % 4 = 1 then 'a-uno-the-book-' || book_id else 'book-' || book_id end"
_IN_SECTIONS = f"""(select book_id, code, row_number() over (partition by book_id, code order by a, b, c) as nth, unit, title, body, has_condition from (
  select book_id, code, 1 as a, unit_id as b, place as c, 'U' || lpad(cast(unit_id as string), cast(greatest(2, length(cast(unit_id as string))) as int), '0') as unit, title, body, has_condition from {_CHECKED}
  union all select book_id, dest, case when dest in ('C01', 'C02', 'C03') then 0 else 2 end, case when dest in ('C01', 'C02', 'C03') then -pos else pos end, 0, 'SYNTHESIS', title, body, false from {_SYNTHESIS} where dest in {sql_list(SECTIONS)}))"""
_ABBR = "'BK' || book_id"
_IDS = f"""(select book_id, code, n, {_ABBR} || '-' || code || '-' || lpad(cast(n as string), cast(greatest(3, length(cast(n as string))) as int), '0') as id, title, body from (
  select *, row_number() over (partition by book_id, code order by case when code = 'C05' then lower(title) else '' end, nth) as n from (
    select *, row_number() over (partition by book_id, code, case when code = 'C05' then lower(trim(title)) else cast(nth as string) end order by length(body) desc, nth) as rn from {_IN_SECTIONS} where code <> 'C18') where rn = 1))"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("unit_id")).agg(ordered("t", "text", " / ", "turn"))
    return c.select("unit_id", X.numbers(F.col("t")).alias("numbers"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """The parsed change-sets of all units, written once."""
    return materialise(parse_entries_of(verify_texts(table(spark, d, "verify_ops"))), "changes")


def _checked(spark: SparkSession, d: str, ops: DataFrame | None = None) -> DataFrame:
    return checked(changed_entries(spark, d, ops), _sources(spark, d))


@query(f"select unit_id, place, code, bad_dest, has_condition, case when state = 'kept' then 'bogus' else '' end as bad_codes, array_to_string(missing, '|') as missing, md5(body) as body_md5 from {_CHECKED}")
def checked_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries after their change-sets with tags cleaned, sections checked, and numbers held against their unit's text."""
    return _checked(spark, d).select("unit_id", "place", "code", "bad_dest", "has_condition", F.array_join("bad_codes", ",").alias("bad_codes"), F.array_join("missing", "|").alias("missing"), F.md5("body").alias("body_md5"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries").select("unit_id", "book_id").distinct()


def _deleted(spark: SparkSession, d: str, ops: DataFrame) -> DataFrame:
    return deletions(ops).join(_books(spark, d), "unit_id").select("book_id", "n")


_STATS = f"""(select e.book_id, count(*) as entries, count(*) filter (state = 'corrected') as corrected, count(*) filter (state = 'added') as added, any_value(coalesce(d.n, 0)) as deleted, count(*) filter (bad_dest) as bad_dest from {_CHECKED} e
  left join (select book_id, cast(sum(n) as bigint) as n from (select unit_id, count(distinct ordinal) as n from verify_ops where op = 'delete' group by unit_id) o join (select distinct unit_id, book_id from entries) b on b.unit_id = o.unit_id group by book_id) d on d.book_id = e.book_id group by e.book_id)"""


@query(f"select * from {_STATS}")
def assembly_stats(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each book: corrected, added, deleted (numbers out of range, too), of unknown sections."""
    ops = _parsed(spark, d)
    return stats(_checked(spark, d, ops), _deleted(spark, d, ops))


def _synthesis(spark: SparkSession, d: str) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(x).alias("dest")) for k, x in enumerate(("C01", "C09", "C01", "L2", "ZZ", "C05", "LOG"))]))
    b = table(spark, d, "entries").select("book_id").distinct().select("book_id", rows.alias("r")).select("book_id", "r.*")
    return b.withColumn("title", F.concat(F.lit("Synthesis "), F.col("pos").cast("string"))).withColumn("body", F.concat(F.lit("all of it, "), "dest", F.when(F.col("pos") == 3, " 77.5 mg of 12 or 31").otherwise("")))


@query(f"select book_id, code, nth, unit, title from {_IN_SECTIONS}")
def section_places(spark: SparkSession, d: str) -> DataFrame:
    """Each section's entries in order, a synthesis in front of the opening sections and behind the others."""
    return in_sections(_checked(spark, d), _synthesis(spark, d)).select("book_id", "code", F.col("at").cast("long").alias("nth"), "unit", "title")


def _described(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entries").select("book_id", "unit_id").distinct()
    of = lambda *x: F.array(*x).cast("array<string>")
    b = F.col("book_id").cast("string")
    maps = e.select("book_id").distinct().select(
        "book_id", F.when(F.col("book_id") % 4 != 1, F.concat(F.lit("book-"), b)).alias("slug"), F.concat(F.lit("bk "), b).alias("abbreviation"), F.concat(F.lit('The "book" '), b).alias("title"), F.lit("").alias("subtitle"), of(F.lit("A. Uno"), F.concat(F.lit("B. "), b)).alias("authors"),
        F.lit("2nd").alias("edition"), F.when(F.col("book_id") % 2 == 0, "c. 1998").otherwise("s. f.").alias("year"), F.lit(None).cast("string").alias("publisher"), F.lit("en").alias("language"), of(F.lit("nutrition")).alias("domains"), F.when(F.col("book_id") % 3 > 0, of(F.lit("renal"))).otherwise(of()).alias("conditions"),
        F.when(F.col("book_id") % 6 == 3, of(F.lit("sop"))).otherwise(of()).alias("conditions_secondary"), F.lit(False).alias("clinical_scope"), F.when(F.col("book_id") % 2 == 1, of(F.lit("topic x"), F.lit("topic y"))).alias("topic_warnings"), of(F.concat(F.lit("MAP: lost "), b)).alias("unit_warnings"), F.lit("B").alias("authority_level"), F.lit("because").alias("authority_rationale"), of().alias("author_credentials"), F.lit("").alias("commercial_interests"), F.concat(F.lit("b"), b, F.lit(".md")).alias("source_file"), F.lit("1").alias("kb_version"), F.lit("2024-01-01").alias("extracted"), F.lit("m0").alias("model"),
    )
    return described(maps, e, e.where("unit_id % 20 <> 7"))


_COVERED = "(select book_id, string_agg(case when unit_id % 20 <> 7 then 'U' || lpad(cast(unit_id as string), cast(greatest(2, length(cast(unit_id as string))) as int), '0') end, ', ' order by unit_id) as covered, bool_or(unit_id % 20 = 7) as partial from (select distinct book_id, unit_id from entries) group by book_id)"
_TITLE = "'A. Uno, B. ' || book_id || ' — The \"book\" ' || book_id || ' (' || case when book_id % 2 = 0 then 'c. 1998' else 's. f.' end || ')'"
_HEAD = """'---' || chr(10) || 'title: "The \\"book\\" ' || book_id || '"' || chr(10) || 'subtitle: ""' || chr(10) || 'authors: ["A. Uno", "B. ' || book_id || '"]' || chr(10) || 'edition: "2nd"' || chr(10) || 'year: "' || case when book_id % 2 = 0 then 'c. 1998' else 's. f.' end || '"' || chr(10) || 'publisher: ""' || chr(10) || 'language: "en"' || chr(10)
  || 'domains: ["nutrition"]' || chr(10) || 'conditions: ' || case when book_id % 3 > 0 then '["renal"]' else '[]' end || chr(10) || 'conditions_secondary: ' || case when book_id % 6 = 3 then '["sop"]' else '[]' end || chr(10) || 'authority_level_suggested: "B"' || chr(10) || 'authority_rationale: "because"' || chr(10) || 'author_credentials: []' || chr(10) || 'commercial_interests: ""' || chr(10)
  || 'abbreviation: "BK' || book_id || '"' || chr(10) || 'source_file: "b' || book_id || '.md"' || chr(10) || 'kb_version: "1"' || chr(10) || 'extracted: "2024-01-01"' || chr(10) || 'model: "m0"' || chr(10) || 'coverage: "' || case when partial then 'partial: ' || covered else 'complete' end || '"' || chr(10) || '---' || chr(10) || chr(10)"""
_NAMES_DUCK = f"(select unnest({list(NAMES)}) as code, unnest({list(NAMES.values())}) as name)"
_SHELVES = f"(select i.book_id, i.code, '**' || i.code || ' ' || any_value(m.name) || '**' || chr(10) || string_agg('- ' || id || ' — ' || title, chr(10) order by n) || chr(10) as t from {_IDS} i join {_NAMES_DUCK} m on m.code = i.code where starts_with(i.code, 'L') group by i.book_id, i.code)"
_C18 = f"(select c.book_id, 'C18' as code, 1 as n, {_ABBR.replace('book_id', 'c.book_id')} || '-C18-001' as id, '{LIBRARY_TITLE}' as title, coalesce(trim(string_agg(l.t, chr(10) order by l.code), ' ' || chr(10)), '{EMPTY_LIBRARY}') as body from {_COVERED} c left join {_SHELVES} l on l.book_id = c.book_id group by c.book_id)"


@query(f"""
with e as (select * from {_IDS} union all select * from {_C18}), t as (select book_id, code, string_agg('### [' || id || '] ' || title || chr(10) || chr(10) || body || chr(10), chr(10) order by n) as t from e group by book_id, code),
s as (select c.book_id, c.covered, c.partial, m.code, case when starts_with(m.code, 'C') then 'CORE' else 'LIBRARY' end as kind, '## ' || m.code || ' ' || m.name || chr(10) || chr(10) || coalesce(t.t, '{EMPTY_SECTION}' || chr(10)) as t from {_COVERED} c cross join {_NAMES_DUCK} m left join t on t.book_id = c.book_id and t.code = m.code),
f as (select book_id, kind, any_value(covered) as covered, bool_or(partial) as partial, rtrim(string_agg(t, chr(10) order by code), ' ' || chr(10)) as sections from s group by book_id, kind)
select book_id, kind, {_SLUG} || case when kind = 'CORE' then '_core.md' else '_biblioteca.md' end as name, md5({_HEAD} || '# KB ' || kind || ' — ' || {_TITLE} || chr(10) || chr(10) || case when kind = 'CORE' then 'Companion file: `' || {_SLUG} || '_biblioteca.md` (full plans, workouts, exercises, recipes, templates). IDs like `BK' || book_id || '-L2-004` point there.' else 'Companion file: `' || {_SLUG} || '_core.md` (principles, zones, tables, rules, cautions).' end
  || case when partial then chr(10) || chr(10) || '> PARTIAL KB — only these units were extracted: ' || covered || '.' else '' end || chr(10) || chr(10) || sections || chr(10)) as text_md5 from f""")
def assemble_books(spark: SparkSession, d: str) -> DataFrame:
    """Both files of every book, from raw answers to the finished text."""
    maps = _described(spark, d)
    e = with_ids(in_sections(_checked(spark, d), _synthesis(spark, d)), maps.select("book_id", "abbr"))
    return files(e, maps).select("book_id", "kind", "name", F.md5("text").alias("text_md5"))


@query(f"""select book_id, '{{"archivo": "' || {_SLUG} || '_core.md", "biblioteca": "' || {_SLUG} || '_biblioteca.md", "titulo": "The \\"book\\" ' || book_id || '", "autor": "A. Uno, B. ' || book_id || '", "ano": ' || case when book_id % 2 = 0 then '1998' else '"s. f."' end || ', "nivel": "B", "dominios": ["nutrition"], "temas": ' || case when book_id % 3 > 0 then '["renal"]' else '[]' end || ', "temas_secundarios": ' || case when book_id % 6 = 3 then '["sop"]' else '[]' end || ', "nota": "because"}}' as record from {_COVERED}""")
def assemble_index(spark: SparkSession, d: str) -> DataFrame:
    return index_records(_described(spark, d))


_BOOK_NUMBERS = f"(select book_id, list_transform(flatten(list(numbers)), lambda y: replace(y, ',', '.')) as own from {_SOURCES} s join (select distinct unit_id, book_id from entries) b on b.unit_id = s.unit_id group by book_id)"
_UNITS = "(select distinct book_id, unit_id, exists (select 1 from verify_ops o where o.unit_id = e.unit_id) as verified, unit_id % 11 = 3 as truncated from entries e)"
_U = "'U' || lpad(cast(unit_id as string), cast(greatest(2, length(cast(unit_id as string))) as int), '0')"
_COVERAGE = f"(select book_id, count(*) as useful, count(*) filter (has_condition) as tagged from {_IN_SECTIONS} where code in {sql_list(TOPIC_SECTIONS)} group by book_id)"
_WARNED = f"""(select book_id, 0 as a, 0 as b, 0 as c, 'TEMAS: solo ' || tagged || ' de ' || useful || ' entradas útiles (secciones {", ".join(TOPIC_SECTIONS)}) llevan condition:. El sistema de nutrición las encontraría poco; conviene repetir la extracción.' as line from {_COVERAGE} where tagged < 0.5 * useful and (book_id % 3 > 0 or book_id % 6 = 3)
  union all select book_id, 1, unit_id, -2, {_U} || ': sin VERIFY' from {_UNITS} where not verified union all select book_id, 1, unit_id, -1, {_U} || ': la extracción se cortó por longitud (revisar; dividir la unidad)' from {_UNITS} where truncated
  union all select book_id, 1, unit_id, place * 3, {_U} || ' · ' || substring(title, 1, 60) || ': etiqueta condition: desconocida (bogus); se quitó' from {_CHECKED} where state = 'kept'
  union all select book_id, 1, unit_id, place * 3 + 1, {_U} || ': entrada con sección desconocida ''' || dest || ''' → C10: ' || substring(title, 1, 60) from {_CHECKED} where bad_dest
  union all select book_id, 1, unit_id, place * 3 + 2, {_U} || ' · ' || substring(title, 1, 60) || ': números que no aparecen en el capítulo: ' || array_to_string(missing[1:12], ', ') from {_CHECKED} where len(missing) > 0
  union all select distinct book_id, 0, 0, 0, '{NO_TOPICS.format(domains="nutrition")}' from entries where book_id % 6 = 0
  union all select distinct book_id, 0, 1 + k, 0, ['topic x', 'topic y', 'MAP: lost ' || book_id][k + 1 + case when book_id % 2 = 1 then 0 else 2 end] from entries cross join (values (0), (1), (2)) v(k) where k = 0 or book_id % 2 = 1
  union all select * from (select s.book_id, 2, pos, 0, 'SYNTHESIS · ' || title || ': números que no aparecen en el libro: ' || array_to_string(list_filter(['12', '31', '77.5'], lambda x: not list_contains(n.own, x)), ', ') as line from {_SYNTHESIS} s join {_BOOK_NUMBERS} n on n.book_id = s.book_id where pos = 3 and len(list_filter(['12', '31', '77.5'], lambda x: not list_contains(n.own, x))) > 0))"""


def _warned(spark: SparkSession, d: str, entries: DataFrame, placed: DataFrame, maps: DataFrame, synthesis: DataFrame) -> DataFrame:
    done = table(spark, d, "verify_ops").select("unit_id", F.lit(True).alias("v")).distinct()
    units = table(spark, d, "entries").select("book_id", "unit_id").distinct().join(done, "unit_id", "left").select("book_id", "unit_id", F.coalesce("v", F.lit(False)).alias("verified"), (F.col("unit_id") % 11 == 3).alias("truncated"))
    topics = maps.where((F.size("conditions") > 0) | (F.size("conditions_secondary") > 0)).select("book_id")
    own = warnings(entries, units, coverage(placed), topics).unionByName(map_warnings(maps))
    return own.unionByName(synthesis_warnings(synthesis, _sources(spark, d).join(_books(spark, d), "unit_id")))


@query(f"select book_id, count(*) as n, md5(string_agg(line, chr(10) order by a, b, c)) as lines_md5 from {_WARNED} group by book_id")
def assembly_warnings(spark: SparkSession, d: str) -> DataFrame:
    """The warnings of each book in their order."""
    entries, synthesis = materialise(_checked(spark, d), "checked"), _synthesis(spark, d)
    w = _warned(spark, d, entries, in_sections(entries, synthesis), _described(spark, d), synthesis)
    return w.groupBy("book_id").agg(F.count("*").alias("n"), F.md5(ordered("t", "line", "\n", "a", "b", "c")).alias("lines_md5"))


#: what the extraction of units notes beside its entries
_EXTRACT_LOG = "(select conv_id as unit_id, turn as pos, 'add' as op, 'LOG' as dest, 'seen ' || turn as title, 0 as ordinal, 'read: ' || replace(substring(text, 1, 40), chr(10), ' ') as body from conversations where (conv_id + turn) % 7 = 5)"
_COSTS = "(select book_id, stage, ord, cast(n * 0.25 as double) as cost from (select book_id, count(*) as n from entries group by book_id) b cross join (values ('MAP', 0), ('EXTRACT', 1), ('SYNTHESIS', 2)) v(stage, ord))"
_CODES = f"(select book_id, code, count(*) as n, min(spot) as first from (select book_id, (dest_ord * 100000 + nth) * 10 + k as spot, code from (select s.book_id, s.nth, list_position({SECTIONS}, s.code) as dest_ord, unnest(string_split(regexp_extract(s.body, 'condition:([a-z0-9_,]+)', 1), ',')) as code, generate_subscripts(string_split(regexp_extract(s.body, 'condition:([a-z0-9_,]+)', 1), ','), 1) as k from {_IN_SECTIONS} s where s.code in {sql_list(TOPIC_SECTIONS)} and has_condition)) group by book_id, code)"


@query(f"""
with i as (select book_id, code, count(*) as n from (select book_id, code from {_IDS} union all select book_id, code from {_C18}) group by 1, 2), cov as (select c.*, coalesce(v.useful, 0) as useful, coalesce(v.tagged, 0) as tagged from {_COVERED} c left join {_COVERAGE} v on v.book_id = c.book_id),
st as (select * from {_STATS}), w as (select *, row_number() over (partition by book_id order by a, b, c) as rn, count(*) over (partition by book_id) as many from {_WARNED}), cs as (select * from {_COSTS}), cd as (select book_id, string_agg(code || ' ' || n, ', ' order by n desc, first) as t from {_CODES} group by book_id),
r as (select book_id, 0 as a, 0 as b, 'REPORTE DE EXTRACCIÓN' || chr(10) || repeat('=', 64) || chr(10) || 'Libro      : ' || {_TITLE} || chr(10) || 'Entrada    : b' || book_id || '.md' || chr(10) || 'Modelo     : m0' || chr(10) || 'Fecha      : 2024-01-01' || chr(10) || 'Cobertura  : ' || case when partial then 'PARCIAL: ' || covered else 'completa' end || chr(10) as line from cov
  union all select book_id, 1, 0, 'Entradas   : ' || entries || '  (corregidas por VERIFY: ' || corrected || ', agregadas: ' || added || ', eliminadas: ' || deleted || ')' || chr(10) || 'Por sección:' from st
  union all select c.book_id, 2, list_position({SECTIONS}, m.code), '   ' || m.code || ' ' || rpad(m.name, cast(greatest(45, length(m.name)) as int), ' ') || ' ' || coalesce(i.n, 0) from cov c cross join {_NAMES_DUCK} m left join i on i.book_id = c.book_id and i.code = m.code
  union all select c.book_id, 3, 0, chr(10) || 'Temas (sistema de nutrición):' || chr(10) || '   Principales : ' || case when c.book_id % 3 > 0 then 'renal' else '(ninguno)' end || chr(10) || '   Secundarios : ' || case when c.book_id % 6 = 3 then 'sop' else '(ninguno)' end || chr(10) || '   Entradas con condition: ' || tagged || ' de ' || useful || ' útiles para una dieta (secciones {", ".join(TOPIC_SECTIONS)})' || coalesce(chr(10) || '   Por tema    : ' || cd.t, '') || chr(10) || chr(10) || 'Costo total: $' || format('{{:,.2f}}', (select sum(cost) from cs where cs.book_id = c.book_id)) || ' USD' from cov c left join cd on cd.book_id = c.book_id
  union all select book_id, 4, ord, '   ' || rpad(stage, cast(greatest(10, length(stage)) as int), ' ') || ' $' || format('{{:,.2f}}', cost) from cs
  union all select c.book_id, 5, 0, chr(10) || 'AVISOS (' || (select count(*) from w where w.book_id = c.book_id) || ')' || chr(10) || repeat('-', 64) || case when (select count(*) from w where w.book_id = c.book_id) = 0 then chr(10) || '  (ninguno)' else '' end from cov c
  union all select book_id, 6, rn, '  - ' || line from w
  union all select book_id, 7, 0, chr(10) || 'Nota: ''números que no aparecen en el capítulo'' es una revisión automática;' || chr(10) || 'puede ser un valor derivado legítimo o un error. Revisar esos casos.' || chr(10) || chr(10) || 'BITÁCORA (LOG)' || chr(10) || repeat('-', 64) from cov
  union all select b.book_id, 8, l.unit_id * 100000 + l.pos, '[' || {_U.replace('unit_id', 'l.unit_id')} || '] ' || title || chr(10) || trim(l.body, ' ' || chr(10)) || chr(10) from {_EXTRACT_LOG} l join (select distinct unit_id, book_id from entries) b on b.unit_id = l.unit_id
  union all select book_id, 9, pos, '[SYNTHESIS] ' || title || chr(10) || body || chr(10) from {_SYNTHESIS} where dest = 'LOG'
  union all select b.book_id, 8, o.unit_id * 100000 + 50000 + o.pos, '[' || {_U.replace('unit_id', 'o.unit_id')} || '] note' || chr(10) || trim(o.body, ' ' || chr(10)) || chr(10) from verify_ops o join (select distinct unit_id, book_id from entries) b on b.unit_id = o.unit_id where op = 'log')
select book_id, md5(string_agg(line, chr(10) order by a, b)) as report_md5 from r group by book_id""")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    """The whole report of each book."""
    ops, maps, synthesis = _parsed(spark, d), materialise(_described(spark, d), "maps"), _synthesis(spark, d)
    entries = materialise(_checked(spark, d, ops), "checked")  # answers are parsed once; all that follows reads this
    placed = materialise(in_sections(entries, synthesis), "placed")
    done = with_ids(placed, maps.select("book_id", "abbr"))
    n = done.groupBy("book_id", "code").agg(F.count("*").alias("n"))
    sections = maps.select("book_id").withColumn("code", F.explode(F.array(*[F.lit(c) for c in SECTIONS]))).join(n, ["book_id", "code"], "left").select("book_id", "code", F.coalesce("n", F.lit(0)).alias("n"))
    found = F.flatten(F.transform(F.regexp_extract_all("body", F.lit("condition:([a-z0-9_,]+)"), F.lit(1)), lambda s: F.split(s, ",")))
    place = F.struct(F.array_position(F.array(*[F.lit(c) for c in SECTIONS]), F.col("code")).alias("s"), F.col("at"), F.col("k"))
    tagged = placed.where(F.col("code").isin(TOPIC_SECTIONS) & F.col("has_condition"))
    codes = tagged.select("book_id", "code", "at", F.posexplode(found).alias("k", "x")).select("book_id", F.col("x").alias("topic"), place.alias("p")).groupBy("book_id", F.col("topic").alias("code")).agg(F.count("*").alias("n"), F.min("p").alias("first"))
    cost = table(spark, d, "entries").groupBy("book_id").agg(F.count("*").alias("e"))
    costs = cost.select("book_id", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("ord"), (F.col("e") * 0.25).alias("cost")) for i, s in enumerate(("MAP", "EXTRACT", "SYNTHESIS"))])).alias("r")).select("book_id", "r.*")
    table(spark, d, "conversations").createOrReplaceTempView("quire_conversations")
    noted = spark.sql(f"select * from {_EXTRACT_LOG.replace('from conversations', 'from quire_conversations').replace('chr(10)', 'char(10)')}")
    logs = logged(parse_entries_of(verify_texts(noted))).unionByName(logged(ops, 1)).join(_books(spark, d), "unit_id").drop("unit_id").unionByName(synthesis_log(synthesis))
    told = materialise(_warned(spark, d, entries, placed, maps, synthesis), "warnings")
    return report(report_lines(maps, stats(entries, _deleted(spark, d, ops)), sections, coverage(placed), codes, costs, told, logs)).select("book_id", F.md5("text").alias("report_md5"))

