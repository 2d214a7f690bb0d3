"""Queries over maps, prompts, errors and job records: gates, vocabularies, markers, results put back, the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..dims import TOPICS, sql_list
from ..functions import text as X
from ..views import duck, table
from .jobs import FATAL, RETRYABLE, finished, override, pending
from .knowledge import _A, _B

QUERIES, ORACLES = {}, {}
#: fixed values: states that a job doesn't leave by itself; the state of one that a stopped program left
FINAL_STATES, INTERRUPTED = ("terminado", "error", "cancelado", "interrumpido"), "interrumpido"
#: fixed values: blocks that a prompt text must have
PROMPT_BLOCKS = ("system", "map", "extract", "synthesis", "verify")
#: a small text in the shape of a prompt file


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


def topic_lists(primary: Column, secondary: Column, valid=tuple(TOPICS)) -> tuple[Column, Column, Column]:
    """(primary, secondary, unknown) codes: lower case, each once over both lists, the primary first; every unknown one is told. Nulls are empty."""
    tidy = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda c: F.lower(X.strip(c))), lambda c: c != "")
    known = lambda a: F.array_distinct(F.filter(tidy(a), lambda c: c.isin(list(valid))))
    unknown = F.filter(F.concat(tidy(primary), tidy(secondary)), lambda c: ~c.isin(list(valid)))
    return known(primary), F.array_except(known(secondary), known(primary)), unknown


@query(f"select unit_id, pos, {_A} || case when {_A} <> {_B} then ',' || {_B} else '' end as conditions, case when 'sop' in ({_A}, {_B}) then '' else 'sop' end as secondary, 'bogus,bogus2,bogus2' as unknown from entries")
def clean_topics(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.expr(_A), F.expr(_B)
    lists = topic_lists(F.array(F.upper(a), F.lit("bogus"), F.concat(F.lit(" "), b)), F.array(b, F.lit("SOP "), F.lit("Bogus2"), F.lit(""), a, F.lit("bogus2"), F.lit("sop")))
    names = ("conditions", "secondary", "unknown")
    return table(spark, d, "entries").select("unit_id", "pos", *[F.array_join(c, ",").alias(n) for c, n in zip(lists, names)])


def without_topics(scope: Column, domains: Column, conditions: Column) -> Column:
    """Whether a clinical map names no topic, so that nothing would find its book."""
    return (F.coalesce(scope, F.lit(False)) | F.array_contains(domains, "nutrition")) & (F.coalesce(F.size(conditions), F.lit(0)) <= 0)


def quarantined(sound: Column, topicless: Column, lost: Column) -> Column:
    """Why a map is set aside, or null: it isn't sound JSON, it names no topic, or a content unit of it isn't in the book."""
    return F.when(~sound, "invalido").when(topicless, "sin_temas").when(lost, "unidad_perdida")


@query("select unit_id, pos, case when unit_id % 9 = 4 then 'invalido' when (unit_id % 2 = 0 or dest = 'C09') and pos % 3 = 0 then 'sin_temas' when pos % 5 = 1 then 'unidad_perdida' end as quarantine from entries")
def clinical_gate(spark: SparkSession, d: str) -> DataFrame:
    """Maps that don't pass go to quarantine under their reason."""
    domains = F.array(F.when(F.col("dest") == "C09", "nutrition").otherwise("other"))
    conditions = F.when(F.col("pos") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("renal")))
    answer = F.when(F.col("unit_id") % 9 == 4, F.lit('{"cut')).otherwise(F.lit('{"title": "T"}'))
    sound = F.from_json(X.json_object(answer), "title string")["title"].isNotNull()
    bad = without_topics(F.col("unit_id") % 2 == 0, domains, conditions)
    return table(spark, d, "entries").select("unit_id", "pos", quarantined(F.coalesce(sound, F.lit(False)), bad, F.col("pos") % 5 == 1).alias("quarantine"))


def _message() -> Column:
    long = F.concat(F.lit("Error 400: prompt is too long: "), F.col("event_id") * 1000, F.lit(" tokens > 1000000 maximum"))
    return F.when(F.col("event_id") % 3 == 0, long).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Error(message='bad "), "event_type", F.lit("')"))).otherwise(F.concat(F.lit("permission_error "), "event_type"))


@query("select event_id, case event_id % 3 when 0 then 'el texto es demasiado largo para el modelo (' || format('{:,}', event_id * 1000) || ' tokens; máximo 1,000,000)' when 1 then 'bad ' || event_type else 'permission_error ' || event_type end as shown from events")
def friendly_error(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", X.friendly_error(_message()).alias("shown"))


def error_class(message: Column, status: Column) -> Column:
    """What follows an error: never again, another try, or a stop."""
    fatal = F.exists(F.array(*[F.lit(x) for x in FATAL]), lambda x: F.contains(message, x))
    return F.when(fatal, "fatal").when(status.isin(list(RETRYABLE)), "retry").otherwise("raise")


@query(f"select event_id, case when event_id % 3 <> 1 then 'fatal' when cast(user_id + 420 as int) in {RETRYABLE} then 'retry' else 'raise' end as follows from events")
def fatal_vs_retry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", error_class(_message(), F.col("user_id") + 420).alias("follows"))


def marker(content: Column, version: str) -> Column:
    """The message of a stored refusal `version|message`; null if another version of the program wrote it, whose refusals are tried again."""
    at = F.instr(content, "|")
    own = F.when(at > 0, F.substr(content, F.lit(1), at - 1)).otherwise(content)
    message = F.when(at > 0, F.substr(content, at + 1)).otherwise("")
    return F.when(own == version, message)


@query("select event_id, case when event_id % 3 = 1 then event_type || '|x' end as message, event_id % 3 <> 1 as stale from events")
def stale_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers written by versions 3.4, 3.5 and 3.6, read by 3.5."""
    content = F.concat(F.lit("3."), (F.col("event_id") % 3 + 4).cast("string"), F.lit("|"), "event_type", F.lit("|x"))
    return table(spark, d, "events").select("event_id", marker(content, "3.5").alias("message")).withColumn("stale", F.col("message").isNull())


def prompt_parts(texts: DataFrame) -> DataFrame:
    """The other columns of texts with (name, body) of the blocks of the prompt texts in column text."""
    mark = r"<!-- (?:PROMPT|TASK): \w+ -->\s*$"
    block = F.lit(rf"(?ms)^<!-- (?:PROMPT|TASK): (\w+) -->\s*$(.*?)(?=^{mark}|\z)")
    both = F.arrays_zip(F.regexp_extract_all("text", block, F.lit(1)).alias("name"), F.regexp_extract_all("text", block, F.lit(2)).alias("body"))
    rest = [c for c in texts.columns if c != "text"]
    return texts.select(*rest, F.explode(both).alias("__b")).select(*rest, F.col("__b.name").alias("name"), X.strip(F.col("__b.body")).alias("body"))


_PIECE = "substring(coalesce(text, ''), 1 + 40 * k, 160)"


def _prompt_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a prompt text of pieces of each document, of which some blocks are absent."""
    parts = [F.lit("intro\n")]
    for k, name in enumerate(PROMPT_BLOCKS):
        head = F.concat(F.lit("<!-- PROMPT: " if k == 0 else "<!-- TASK: "), F.lit(f"{name} -->\n"))
        parts.append(F.when((F.col("doc_id") + k) % 4 != 0, F.concat(head, F.expr(_PIECE.replace(" k,", f" {k},")), F.lit("\n"))).otherwise(""))
    return docs.select("doc_id", F.concat(*parts).alias("text"))


@query(f"""
with n as (select unnest({list(PROMPT_BLOCKS)}) as name, generate_subscripts({list(PROMPT_BLOCKS)}, 1) - 1 as k)
select doc_id, name, case when (doc_id + k) % 4 <> 0 then md5(regexp_replace(regexp_replace({_PIECE.replace(" k,", " cast(k as int),")}, '^\\s+', ''), '\\s+$', '')) end as body_md5, (doc_id + k) % 4 = 0 as missing from documents cross join n""")
def prompt_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The required blocks of prompt texts, here of pieces of each document; an absent one stops a program."""
    texts = _prompt_texts(table(spark, d, "documents"))
    needed = texts.select("doc_id", F.explode(F.array(*[F.lit(x) for x in PROMPT_BLOCKS])).alias("name"))
    found = needed.join(prompt_parts(texts), ["doc_id", "name"], "left")
    return found.select("doc_id", "name", F.md5("body").alias("body_md5"), F.col("body").isNull().alias("missing"))


def topic_codes(text: Column) -> Column:
    """The codes that the vocabulary section of a prompt lists."""
    section = F.regexp_extract(text, r"(?s)# CLINICAL TOPIC VOCABULARY(.*?)(?:\n# |\z)", 1)
    return F.array_distinct(F.regexp_extract_all(section, F.lit("(?m)^- `([a-z0-9_]+)` —"), F.lit(1)))


@query("select doc_id, unnest(list_distinct(['t_' || doc_id % 50, 'u' || n_chars % 7, 't_' || doc_id % 50, 'v' || doc_id % 2])) as code from documents")
def vocab_codes(spark: SparkSession, d: str) -> DataFrame:
    """The topics that prompt texts list; here of each document a vocabulary with repeats, lines of another form, and a section behind it."""
    code = lambda *c: F.concat(F.lit("- `"), *[x.cast("string") for x in c], F.lit("` — "), F.translate(F.substring("text", 1, 30), "\n#", "  "), F.lit("\n"))
    doc, n = F.col("doc_id"), F.col("n_chars")
    lines = [code(F.lit("t_"), doc % 50), code(F.lit("u"), n % 7), code(F.lit("t_"), doc % 50), F.lit("- `No Code` — x\n- bare — y\n"), code(F.lit("v"), doc % 2)]
    text = F.concat(F.lit("Rules.\n\n# CLINICAL TOPIC VOCABULARY\n"), *lines, F.lit("\n# Format\n- `none` — no code\n"))
    return table(spark, d, "documents").select("doc_id", F.explode(topic_codes(text)).alias("code"))


@query("select doc_id, cast(cast(nullif(regexp_extract(text, '[0-9]{4}'), '') as int) as string) as year from documents")
def year_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.year_of(F.col("text")).cast("string").alias("year"))


_TEMPLATE = "Unit {id}: {title} [{kind}], again {id}"


@query(f"select unit_id, pos, replace(replace(replace('{_TEMPLATE}', '{{id}}', cast(unit_id as string)), '{{title}}', title), '{{kind}}', dest) as task from entries")
def fill_template(spark: SparkSession, d: str) -> DataFrame:
    """Fields are put in one after the other; unknown ones stay."""
    return table(spark, d, "entries").select("unit_id", "pos", X.fill(_TEMPLATE, {"id": F.col("unit_id").cast("string"), "title": F.col("title"), "kind": F.col("dest")}).alias("task"))


@query("select event_id, case when event_id % 4 < 2 then event_type end as title, cast(case when event_id % 4 < 2 then event_id end as string) as n, event_id % 4 >= 2 as rejected from events")
def parse_map_json(spark: SparkSession, d: str) -> DataFrame:
    """Maps read from answers with fences or remarks; an answer without a sound object is rejected."""
    sound = F.to_json(F.struct(F.col("event_type").alias("title"), F.col("event_id").alias("n")))
    k = F.col("event_id") % 4
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), sound, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), sound, F.lit(" done"))).when(k == 2, F.lit('{"title": "cut')).otherwise(F.lit("no object"))
    e = table(spark, d, "events").select("event_id", F.from_json(X.json_object(answer), "title string, n long").alias("m"))
    return e.select("event_id", "m.title", F.col("m.n").cast("string").alias("n"), F.coalesce(F.col("m.title").isNull(), F.lit(True)).alias("rejected"))


@query(f"select event_id, case when s in {sql_list(FINAL_STATES)} then s else '{INTERRUPTED}' end as estado from (select event_id, case event_type when 'purchase' then 'terminado' when 'signup' then 'en_fila' when 'view' then 'cancelado' else 'extrayendo' end as s from events)")
def interrupted_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that a stopped program left in a state that isn't final."""
    s = F.when(F.col("event_type") == "purchase", "terminado").when(F.col("event_type") == "signup", "en_fila").when(F.col("event_type") == "view", "cancelado").otherwise("extrayendo")
    return table(spark, d, "events").select("event_id", F.when(s.isin(list(FINAL_STATES)), s).otherwise(INTERRUPTED).alias("estado"))


@query("select event_id, case when event_id % 2 = 0 or event_id % 3 = 0 then cast((case when event_id % 2 = 0 then user_id else 0 end) + (case when event_id % 3 = 0 then 2 * user_id else 0 end) as double) end as costo from events")
def job_cost(spark: SparkSession, d: str) -> DataFrame:
    """Conversion and result together (here in cents); null if a job has neither."""
    a, b = F.when(F.col("event_id") % 2 == 0, F.col("user_id")), F.when(F.col("event_id") % 3 == 0, 2 * F.col("user_id"))
    return table(spark, d, "events").select("event_id", F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("double").alias("costo"))


def fan_out(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Each job with the result of its key, of which there is one."""
    return jobs.join(results, "key", "left")


@query("""
with k as (select doc_id, sha1(text || 'image') as key, upper(lang) || source as out from documents), f as (select key, min(doc_id) as first_doc, arg_min(out, doc_id) as out from k group by key)
select k.doc_id, k.key, f.first_doc, f.out from k join f on k.key = f.key""")
def fan_out_results(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates take the result of their original; only short columns go through the join."""
    jobs = table(spark, d, "documents").select("doc_id", X.content_key(F.col("text"), F.lit("image")).alias("key"), F.concat(F.upper("lang"), "source").alias("answer"))
    none = jobs.select("key").where(F.lit(False))
    done = pending(jobs.withColumn("pos", F.col("doc_id")), none).select("key", F.col("doc_id").alias("first_doc"), F.col("answer").alias("out"))
    return fan_out(jobs.select("doc_id", "key"), done)


@query("""
with k as (select doc_id, sha1(text || doc_id) as key, case when doc_id % 4 = 0 then '[DECORATIVE]' else source end as text, doc_id % 3 = 0 as captioned from documents)
select doc_id, case when text = '[DECORATIVE]' and captioned then case when doc_id % 5 = 0 then 'failed' else 'ok' end else 'ok' end as status, case when text = '[DECORATIVE]' and captioned then case when doc_id % 5 = 0 then null else 'forced' end else text end as text from k""")
def override_retry(spark: SparkSession, d: str) -> DataFrame:
    """Captioned images that were taken for decoration are asked again, and the second answer counts, failures too."""
    key = X.content_key(F.concat("text", F.col("doc_id").cast("string")), F.lit(""))
    jobs = table(spark, d, "documents").select("doc_id", key.alias("key"), F.when(F.col("doc_id") % 4 == 0, "[DECORATIVE]").otherwise(F.col("source")).alias("text"), F.lit("ok").alias("status"), (F.col("doc_id") % 3 == 0).alias("captioned"))
    failed = F.col("doc_id") % 5 == 0
    again = jobs.where("captioned and text = '[DECORATIVE]'").select("key", F.when(failed, "failed").otherwise("ok").alias("status"), F.when(~failed, "forced").alias("text"))
    return override(jobs, again).select("doc_id", "status", "text")


@query("select e.unit_id, e.pos, case when o.op is null then 'missing' when o.op = 'log' then 'errored' else 'succeeded' end as state from entries e left join verify_ops o on o.unit_id = e.unit_id and o.ordinal = e.pos + 1")
def batch_collect(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of a batch with their results by custom id, in whatever order those came; without one a job is asked again."""
    custom = lambda k: F.concat_ws("-", "unit_id", k)
    jobs = table(spark, d, "entries").select("unit_id", "pos", custom(F.col("pos")).alias("custom_id"))
    came = table(spark, d, "verify_ops").select(custom(F.col("ordinal") - 1).alias("custom_id"), F.when(F.col("op") == "log", "errored").otherwise("succeeded").alias("state"))
    return jobs.join(came, "custom_id", "left").select("unit_id", "pos", F.coalesce("state", F.lit("missing")).alias("state"))


@query("""
with w as (select unnest(['U0', 'U3', 'U7', 'U99999']) as unit), e as (select book_id, 'U' || unit_id as unit, max(case when exists (select 1 from verify_ops o where o.unit_id = x.unit_id and o.ordinal = x.pos + 1) then 1 else 0 end) as done from entries x group by 1, 2),
b as (select distinct book_id from entries)
select b.book_id, w.unit, case when e.unit is null then 'unknown' when e.done = 1 then 'done' else 'to do' end as state from b cross join w left join e on e.book_id = b.book_id and e.unit = w.unit""")
def resume_plan(spark: SparkSession, d: str) -> DataFrame:
    """Wanted units of each book, upper-cased: done, still to do, or unknown, which is an error."""
    e = table(spark, d, "entries").select("book_id", "unit_id", "pos")
    done = table(spark, d, "verify_ops").select("unit_id", (F.col("ordinal") - 1).alias("pos"), F.lit(1).alias("done"))
    units = e.join(done, ["unit_id", "pos"], "left").groupBy("book_id", F.concat(F.lit("U"), F.col("unit_id").cast("string")).alias("unit")).agg(F.max(F.coalesce("done", F.lit(0))).alias("done"))
    wanted = F.explode(F.transform(F.array(*[F.lit(x) for x in ("u0", "U3 ", "u7", "u99999")]), lambda u: F.upper(F.trim(u))))
    plan = e.select("book_id").distinct().select("book_id", wanted.alias("unit")).join(units, ["book_id", "unit"], "left")
    return plan.select("book_id", "unit", F.when(F.col("done").isNull(), "unknown").when(F.col("done") == 1, "done").otherwise("to do").alias("state"))
