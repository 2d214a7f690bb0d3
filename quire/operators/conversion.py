"""The whole report of a book's conversion, from its counters, structure lines, problems and discarded images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..views import duck, table
from .knowledge import ordered
from .usage import _COUNTED, COUNTER_WIDTH, COUNTERS, _counted

QUERIES, ORACLES = {}, {}
#: fixed values: dollars for a million tokens in and out by model; the model whose prices count for others
PRICES = {"gemini-3.8-flash": (0.75, 3.75), "gemini-3.5-flash-lite": (0.30, 2.50)}
DEFAULT = "gemini-3.8-flash"
#: fixed values: lines of the report, and the suffix of its file
HEAD = {"source": "Fuente          : ", "out": "Salida          : ", "kind": "Tipo            : ", "model": "Modelo imágenes : ", "date": "Fecha           : ", "seconds": "Duración        : ", "chars": "Caracteres      : "}
TITLE, COUNTS, RULE, SUFFIX = "REPORTE DE CONVERSIÓN", "TRANSCRIPCIONES CON GEMINI", 60, ".conversion_report.txt"
TOKENS, COST = "Tokens (entrada / salida)", "Costo real aproximado"
PROBLEMS, DISCARDED = "PROBLEMAS ({n}) — revisar", "IMÁGENES DESCARTADAS COMO DECORATIVAS ({n}) — para auditoría"
AGAIN = ("Para reintentar solo lo que falló, vuelve a correr la misma", "conversión: lo que ya salió bien se toma de la caché.")
SOUND = "Sin problemas: todo el contenido quedó transcrito."
#: fixed values: structure lines of an archive's book
SECTIONS, SKIPPED = "Secciones (capítulos/archivos) : {n}", "Secciones omitidas (índice/nav/portada) : {n}"


def _grouped(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars of a conversion's tokens; of unknown models at the default one's prices. The report shows three decimals, halves up."""
    of = lambda i: F.coalesce(*[F.when(model == m, p[i]) for m, p in PRICES.items()], F.lit(PRICES[DEFAULT][i]))
    return (tokens_in * of(0) + tokens_out * of(1)) / 1_000_000


def reports(books: DataFrame, counted: DataFrame, lines: DataFrame, problems: DataFrame, discarded: DataFrame) -> DataFrame:
    """(book, name, text) of every book.

    books(book, source, out, kind, model, date, seconds, chars, tokens_in, tokens_out), counted: see usage.counters;
    lines(book, pos, line); problems and discarded(book, pos, place, reason). A book without some of these has none of them.
    """
    many = lambda df, name: df.groupBy("book").agg(F.count("*").alias(name))
    b = books.join(many(problems, "n_problems"), "book", "left").join(many(discarded, "n_discarded"), "book", "left")
    width = lambda s: s.ljust(COUNTER_WIDTH) + ": "
    shown = {"source": F.col("source"), "out": F.col("out"), "kind": F.col("kind"), "model": F.col("model"), "date": F.col("date"), "seconds": F.format_string("%.0f s", F.col("seconds").cast("double")), "chars": _grouped(F.col("chars"))}
    bad, gone = F.col("n_problems").isNotNull(), F.col("n_discarded").isNotNull()
    n = lambda text, c: F.replace(F.lit(text), F.lit("{n}"), F.col(c).cast("string"))
    fixed = [
        (0, [F.lit(TITLE), F.lit("=" * RULE), *[F.concat(F.lit(v), F.coalesce(shown[k], F.lit(""))) for k, v in HEAD.items()], F.lit("")]),
        (2, [F.lit(""), F.lit(COUNTS), F.lit("-" * RULE)]),
        (4, [F.concat(F.lit(width(TOKENS)), _grouped(F.col("tokens_in")), F.lit(" / "), _grouped(F.col("tokens_out"))), F.concat(F.lit(width(COST)), F.format_string("$%.3f USD", cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out")))), F.lit("")]),
        (5, [F.when(bad, n(PROBLEMS, "n_problems")), F.when(bad, "-" * RULE)]),
        (7, [F.when(bad, ""), *[F.when(bad, x) for x in AGAIN], F.when(~bad, SOUND), F.when(gone, ""), F.when(gone, n(DISCARDED, "n_discarded")), F.when(gone, "-" * RULE)]),
    ]
    rows = b.select("book", F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(i).cast("long").alias("b"), x.alias("line")) for a, xs in fixed for i, x in enumerate(xs)]))).where("line is not null")
    label = F.element_at(F.array(*[F.lit(width(x)) for x in COUNTERS.values()]), F.col("ord") + 1)
    told = lambda df, a: df.select("book", F.lit(a).alias("a"), F.col("pos").cast("long").alias("b"), F.concat(F.lit("  - "), "place", F.lit(": "), "reason").alias("line"))
    rows = rows.unionByName(lines.select("book", F.lit(1).alias("a"), F.col("pos").cast("long").alias("b"), "line"))
    rows = rows.unionByName(counted.select("book", F.lit(3).alias("a"), F.col("ord").cast("long").alias("b"), F.concat(label, F.col("n").cast("string")).alias("line")))
    rows = rows.unionByName(told(problems, 6)).unionByName(told(discarded, 8))
    text = rows.groupBy("book").agg(ordered("text", "line", "\n", "a", "b"))
    name = F.concat(F.regexp_replace("out", r"\.[^./]+$", ""), F.lit(SUFFIX))
    return books.select("book", name.alias("name")).join(text, "book").select("book", "name", F.concat("text", F.lit("\n")).alias("text"))


_MODEL = "case when count(*) % 2 = 0 then 'gemini-3.5-flash-lite' else 'other' end"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, duck(sql)
        return f

    return add


_P = r"select source as book, doc_id as pos, 'p. ' || doc_id as place, case cast(doc_id % 9 as int) when 2 then 'failed' when 3 then 'skipped' else 'blocked' end as reason from book_docs where doc_id % 9 in (2, 3, 6) and doc_id % 2 = 0"
_D = "select source as book, doc_id as pos, 'img ' || doc_id as place, 'IA: decorativa' as reason from book_docs where doc_id % 9 = 7 and doc_id % 4 = 1"


@query(f"""{_COUNTED}, l as (select unnest({list(COUNTERS)}) as key, unnest({list(COUNTERS.values())}) as label),
m as (select source as book, count(*) as n, count(*) filter (doc_id % 7 = 0) as skipped, cast(sum(n_chars) as bigint) as chars, {_MODEL} as model from book_docs group by source),
p as ({_P}), d as ({_D}),
pt as (select book, 'PROBLEMAS (' || count(*) || ') — revisar' || chr(10) || repeat('-', 60) || chr(10) || string_agg('  - ' || place || ': ' || reason, chr(10) order by pos) || chr(10) || chr(10) || '{AGAIN[0]}' || chr(10) || '{AGAIN[1]}' as t from p group by book),
dt as (select book, chr(10) || chr(10) || 'IMÁGENES DESCARTADAS COMO DECORATIVAS (' || count(*) || ') — para auditoría' || chr(10) || repeat('-', 60) || chr(10) || string_agg('  - ' || place || ': ' || reason, chr(10) order by pos) as t from d group by book),
ct as (select c.book, string_agg(rpad(l.label, cast(greatest({COUNTER_WIDTH}, length(l.label)) as int), ' ') || ': ' || c.n, chr(10) order by c.ord) as t from c join l on l.key = c.key group by c.book)
select m.book, m.book || '.md.conversion_report.txt' as name, md5('{TITLE}' || chr(10) || repeat('=', 60) || chr(10) || 'Fuente          : ' || m.book || '.epub' || chr(10) || 'Salida          : ' || m.book || '.md.md' || chr(10) || 'Tipo            : EPUB' || chr(10) || 'Modelo imágenes : ' || model || chr(10) || 'Fecha           : 2024-01-01 00:00' || chr(10) || 'Duración        : ' || (m.n % 100) || ' s' || chr(10) || 'Caracteres      : ' || format('{{:,}}', chars) || chr(10) || chr(10)
  || 'Secciones (capítulos/archivos) : ' || m.n || chr(10) || 'Secciones omitidas (índice/nav/portada) : ' || skipped || chr(10) || chr(10) || '{COUNTS}' || chr(10) || repeat('-', 60) || chr(10) || ct.t || chr(10)
  || rpad('{TOKENS}', {COUNTER_WIDTH}, ' ') || ': ' || format('{{:,}}', m.n * 1503 + 1) || ' / ' || format('{{:,}}', m.n * 1000) || chr(10) || rpad('{COST}', {COUNTER_WIDTH}, ' ') || ': $' || printf('%.3f', ((m.n * 1503 + 1) * case when model = 'other' then 0.75 else 0.3 end::double + m.n * 1000 * case when model = 'other' then 3.75 else 2.5 end::double) / 1000000) || ' USD' || chr(10) || chr(10)
  || coalesce(pt.t, '{SOUND}') || coalesce(dt.t, '') || chr(10)) as text_md5 from m join ct on ct.book = m.book left join pt on pt.book = m.book left join dt on dt.book = m.book""")
def conversion_report_text(spark: SparkSession, d: str) -> DataFrame:
    """The whole report of each book's conversion, with what it names and what it leaves out."""
    docs = table(spark, d, "book_docs").select("doc_id", F.col("source").alias("book"), "n_chars")
    docs.createOrReplaceTempView("quire_report_docs")
    m = docs.groupBy("book").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 7 == 0).alias("skipped"), F.sum("n_chars").alias("chars"))
    model = F.when(F.col("n") % 2 == 0, "gemini-3.5-flash-lite").otherwise("other")
    books = m.select(
        "book", F.concat("book", F.lit(".epub")).alias("source"), F.concat("book", F.lit(".md.md")).alias("out"), F.lit("EPUB").alias("kind"), model.alias("model"), F.lit("2024-01-01 00:00").alias("date"),
        (F.col("n") % 100).alias("seconds"), "chars", (F.col("n") * 1503 + 1).alias("tokens_in"), (F.col("n") * 1000).alias("tokens_out"),
    )
    line = lambda text, c: F.replace(F.lit(text), F.lit("{n}"), F.col(c).cast("string"))
    lines = m.select("book", F.posexplode(F.array(line(SECTIONS, "n"), line(SKIPPED, "skipped"))).alias("pos", "line"))
    own = lambda sql: spark.sql(sql.replace("source as book", "book").replace("from book_docs", "from quire_report_docs"))
    return reports(books, _counted(spark, d), lines, own(_P), own(_D)).select("book", "name", F.md5("text").alias("text_md5"))
