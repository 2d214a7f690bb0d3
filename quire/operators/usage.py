"""Queries over usage, events and spans: costs, caches, sessions, job states, fonts, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..dims import BATCH_FACTOR, CACHE_WRITE_FACTOR, DEFAULT_PRICE, PRICES, TTL_SECONDS, prices
from ..functions import text as X
from ..streaming import jobs as stream
from ..views import duck, table

QUERIES, ORACLES = {}, {}
_PRICES_DUCK = "(values " + ", ".join(f"('{m}', timestamp '{v}', {i}, {o}, {r})" for m, v, i, o, r in PRICES) + ") p(model, valid_from, p_in, p_out, r_mult)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


def priced(usage: DataFrame, dim: DataFrame) -> DataFrame:
    """usage with the price valid at its time, or the default one; the dimension's intervals are closed first, so each row has one match."""
    until = F.lead("valid_from").over(W.partitionBy("model").orderBy("valid_from"))
    dim = F.broadcast(dim.withColumn("until", until))  # a fixed price list
    u, p = usage.alias("u"), dim.alias("p")
    on = (F.col("u.model") == F.col("p.model")) & (F.col("u.time") >= F.col("p.valid_from")) & (F.col("p.until").isNull() | (F.col("u.time") < F.col("p.until")))
    pick = [F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(("p_in", "p_out", "r_mult"), DEFAULT_PRICE)]
    return u.join(p, on, "left").select("u.*", *pick)


def micros() -> F.Column:
    """Cost in ten-thousandths of a dollar, rounded half to even, as an exact integer."""
    raw = F.col("input") * F.col("p_in") + F.col("cache_write") * F.col("p_in") * CACHE_WRITE_FACTOR + F.col("cache_read") * F.col("p_in") * F.col("r_mult") + F.col("output") * F.col("p_out")
    return F.bround(raw * F.when(F.col("batch"), BATCH_FACTOR).otherwise(1.0) / 100.0).cast("long")


_COST = f"cast(round_even((input * p_in + cache_write * p_in * {CACHE_WRITE_FACTOR} + cache_read * p_in * r_mult + output * p_out) * (case when batch then {BATCH_FACTOR} else 1.0 end) / 100.0, 0) as bigint)"
_PRICED = f"(select u.*, cast(coalesce(p.p_in, {DEFAULT_PRICE[0]}) as double) as p_in, cast(coalesce(p.p_out, {DEFAULT_PRICE[1]}) as double) as p_out, cast(coalesce(p.r_mult, {DEFAULT_PRICE[2]}) as double) as r_mult from usage u left join (select *, lead(valid_from) over (partition by model order by valid_from) as until from {_PRICES_DUCK}) p on u.model = p.model and u.time >= p.valid_from and (p.until is null or u.time < p.until))"


@query(f"select split_part(label, ' ', 1) as stage, count(*) as calls, cast(sum({_COST}) as bigint) as cost, min(event_id) as first_call from {_PRICED} group by rollup(split_part(label, ' ', 1))")
def llm_cost_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """Calls and cost (in $0.0001) by stage and in all."""
    u = priced(table(spark, d, "usage"), prices(spark)).select(F.split("label", " ")[0].alias("stage"), "event_id", micros().alias("cost"))
    return u.rollup("stage").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"), F.min("event_id").alias("first_call"))


@query("select model, batch, cast(sum(input) as bigint) as input, cast(sum(output) as bigint) as output, count(*) as calls from usage group by model, batch")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "usage").groupBy("model", "batch").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.count("*").alias("calls"))


@query(f"select event_id, coalesce(date_diff('second', lag(time) over (partition by model order by event_id), time) < {TTL_SECONDS}, false) as alive from usage where not batch")
def cache_alive(spark: SparkSession, d: str) -> DataFrame:
    """Whether the model's latest call that wasn't a batch, in file order, is less than the time to live ago.

    Calls are dealt by model and stretch of the file; the first of a stretch takes the last call of the stretch before.
    """
    e = table(spark, d, "usage").where("not batch").select("event_id", "model", "time", F.floor(F.col("event_id") / STRETCH).alias("part"))
    last = e.groupBy("model", "part").agg(F.max_by("time", "event_id").alias("last"))
    last = last.select("model", "part", F.lag("last").over(W.partitionBy("model").orderBy("part")).alias("earlier"))
    before = F.lag("time").over(W.partitionBy("model", "part").orderBy("event_id"))
    e = e.withColumn("before", before).join(last, ["model", "part"])
    return e.select("event_id", F.coalesce(F.timestamp_diff("SECOND", F.coalesce("before", "earlier"), "time") < TTL_SECONDS, F.lit(False)).alias("alive"))


@query("""
with g as (select user_id, ts, case when lag(ts) over w is null or date_diff('microsecond', lag(ts) over w, ts) >= 3300000000 then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as session_start, count(*) as n from s group by user_id, k""")
def session_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that end 55 minutes after the last event; one at the very end begins a new session, while windows that touch are merged."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "3299999999 microseconds").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("s"))
    return s.select("user_id", F.col("s").cast("timestamp_ntz").alias("session_start"), "n")


#: lines of a usage file that are dealt together
STRETCH = 10_000
_EVENT = f"{stream.EVENTS}[1 + cast((event_id * 7 + user_id + event_id // 11) % {len(stream.EVENTS)} as int)]"
_STEPS = "(values " + ", ".join(f"('{e}', '{s}', '{to}')" for e, states, to in stream.TRANSITIONS for s in states) + ") t(event, state, follows)"
_AFTER = f"case when t.follows is null then f.state when t.follows = '{stream.BACK}' then case f.stage when 'conversion' then 'convirtiendo' else 'extrayendo' end else t.follows end"
_LINE = "case when event_id % 5 = 0 then ' ---==--- ' when event_id % 5 = 1 then '' else ' ' || event_type || ' ' || event_id || repeat('.', 300) || ' ' end"


def job_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of jobs derived from the events table: (job, event_id, event, line)."""
    at = ((F.col("event_id") * 7 + F.col("user_id") + F.floor(F.col("event_id") / 11)) % len(stream.EVENTS) + 1).cast("int")
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("job"), "event_id", F.element_at(F.array(*[F.lit(x) for x in stream.EVENTS]), at).alias("event"), F.expr(_LINE).alias("line"))


@query(f"""
with recursive e as (select user_id as job, event_id, {_EVENT} as event, {_LINE} as line, row_number() over (partition by user_id order by event_id) as n from events),
f(job, n, event_id, state, stage, message) as (select distinct job, cast(0 as bigint), cast(null as bigint), '', '', '' from e
  union all select f.job, f.n + 1, e.event_id, {_AFTER}, case {_AFTER} when 'convirtiendo' then 'conversion' when 'extrayendo' then 'extraccion' else f.stage end,
    case when e.event = 'linea' and regexp_replace(trim(e.line), '[=─═ -]', '', 'g') <> '' and f.state not in ('esperando_confirmacion', 'esperando_lote') then substring(trim(e.line), 1, 200) else f.message end
  from f join e on e.job = f.job and e.n = f.n + 1 left join {_STEPS} on t.event = e.event and t.state = f.state)
select job, state, stage, message, n as events, event_id as last_event from f where n = (select max(n) from e where e.job = f.job)""")
def fsm_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each job's latest state, stage and message: see streaming.jobs."""
    return stream.history(job_events(spark, d))


@query("""
select event_id, case when event_id % 3 = 0 then 'event' else 'log' end as kind, case when event_id % 3 = 0 then event_type end as evento from events""")
def event_demux(spark: SparkSession, d: str) -> DataFrame:
    """Marked lines with sound JSON are events; all others are log text."""
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("@@BPP "), F.to_json(F.struct(F.col("event_type").alias("evento"))))).when(F.col("event_id") % 3 == 1, F.lit("@@BPP {broken")).otherwise(F.col("props"))
    return stream.demux(e.select("event_id", line.alias("line"))).select("event_id", "kind", "evento")


@query("select event_id, event_type from events order by event_id desc limit 400")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last 400 lines of a log, which is the feature."""
    return table(spark, d, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(400)


@query("select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events")
def queue_order(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


#: fixed values: the counters of a conversion, in the order of its report, with their lines
COUNTERS = {
    "jobs_total": "Imágenes/páginas enviadas",
    "ok": "  transcritas ahora",
    "cached": "  tomadas de caché (sin costo)",
    "decorative": "  descartadas por decorativas (IA)",
    "forced": "  re-transcritas por tener leyenda de tabla/figura",
    "truncated": "  truncadas",
    "recitation": "  bloqueadas por derechos de autor",
    "tables_recovered": "    rescatadas pidiendo solo tablas y recuadros",
    "blocked": "  bloqueadas por seguridad",
    "failed": "  fallidas tras reintentos",
    "skipped": "  sin procesar (sin API key)",
    "decorative_rules": "Imágenes decorativas descartadas (reglas)",
}
COUNTER_WIDTH = 44


def counters(jobs: DataFrame) -> DataFrame:
    """(book, key, ord, n) of every counter of every book, zeros included; jobs(book, key, pos, status, kind, decorative, forced, rescued, by_rule).

    A job that several places share counts once, as its first place has it. One dropped by rules isn't sent.
    """
    cols = ["status", "kind", "decorative", "forced", "rescued", "by_rule"]
    first = jobs.groupBy("book", "key").agg(F.min_by(F.struct(*cols), "pos").alias("j")).select("book", "j.*")
    own = F.when(F.col("by_rule"), F.lit("decorative_rules")).when(F.col("decorative"), F.lit("decorative")).when(F.col("rescued"), F.lit("tables_recovered")).otherwise(F.col("status"))
    first = first.withColumn("own", own).withColumn("sent", ~F.col("by_rule"))
    n = {k: F.count_if(F.col("own") == k) for k in COUNTERS} | {"jobs_total": F.count_if("sent"), "forced": F.count_if(F.col("forced") & F.col("sent"))}
    # a rescued page counts by its status, too
    n["recitation"] = F.count_if(F.col("sent") & ~F.col("decorative") & (F.col("status") == "recitation"))
    every = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(i).alias("ord"), n[k].alias("n")) for i, k in enumerate(COUNTERS)])
    return first.groupBy("book").agg(every.alias("c")).select("book", F.inline("c"))


_JOBROWS = """(select source as book, sha1(text || 'page') as key, doc_id as pos, case cast(doc_id % 9 as int) when 0 then 'ok' when 1 then 'cached' when 2 then 'failed' when 3 then 'skipped' when 4 then 'truncated' when 5 then 'recitation' when 6 then 'blocked' else 'ok' end as status, 'page' as kind,
  doc_id % 9 = 7 as decorative, doc_id % 9 = 8 as forced, doc_id % 9 = 5 and doc_id % 2 = 0 as rescued, doc_id % 10 = 0 as by_rule from book_docs)"""
_COUNTED = f"""with f as (select * from (select *, row_number() over (partition by book, key order by pos) as rn from {_JOBROWS}) where rn = 1),
o as (select book, unnest(case when by_rule then ['decorative_rules'] when decorative then ['jobs_total', 'decorative'] when rescued then ['jobs_total', 'recitation', 'tables_recovered'] when forced then ['jobs_total', 'forced', status] else ['jobs_total', status] end) as key from f),
k as (select unnest({list(COUNTERS)}) as key, generate_subscripts({list(COUNTERS)}, 1) - 1 as ord), b as (select distinct book from f),
c as (select b.book, k.key, cast(k.ord as int) as ord, count(o.key) as n from b cross join k left join o on o.book = b.book and o.key = k.key group by all)"""


def _counted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "book_docs").withColumn("key", X.content_key(F.col("text"), F.lit("page"))).drop("text")
    r = F.col("doc_id") % 9
    status = F.element_at(F.array(*[F.lit(x) for x in ("ok", "cached", "failed", "skipped", "truncated", "recitation", "blocked", "ok", "ok")]), (r + 1).cast("int"))
    rows = docs.select(F.col("source").alias("book"), "key", F.col("doc_id").alias("pos"), status.alias("status"), F.lit("page").alias("kind"), (r == 7).alias("decorative"), (r == 8).alias("forced"), ((r == 5) & (F.col("doc_id") % 2 == 0)).alias("rescued"), (F.col("doc_id") % 10 == 0).alias("by_rule"))
    return counters(rows)


@query(f"{_COUNTED} select * from c")
def status_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters of each book's conversion, zeros included."""
    return _counted(spark, d)


@query(f"""{_COUNTED}, l as (select unnest({list(COUNTERS)}) as key, unnest({list(COUNTERS.values())}) as label)
select c.book, string_agg(rpad(l.label, cast(greatest({COUNTER_WIDTH}, length(l.label)) as int), ' ') || ': ' || c.n, chr(10) order by c.ord) as lines from c join l on l.key = c.key group by c.book""")
def conversion_report(spark: SparkSession, d: str) -> DataFrame:
    """The counters of each book's conversion report, as its lines. See conversion.reports for a whole report."""
    return counter_lines(_counted(spark, d))


def counter_lines(counted: DataFrame) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in COUNTERS.values()]), F.col("ord") + 1)
    line = F.concat(F.rpad(label, F.greatest(F.lit(COUNTER_WIDTH), F.length(label)), F.lit(" ")), F.lit(": "), F.col("n").cast("string"))
    rows = counted.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return rows.select("book", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("lines"))


_SIZES = "(select book, size, chars, first_seen from (select l_returnflag as book, round(l_quantity / 5, 1) as size, sum(cast(l_partkey % 160 + 1 as bigint)) as chars, min(l_orderkey * 10 + l_linenumber) as first_seen from lineitem group by 1, 2))"
_BODY = f"(select book, size as body_size from (select *, row_number() over (partition by book order by chars desc, first_seen) as rn from {_SIZES}) where rn = 1)"


@query(f"select * from {_BODY}")
def font_mode(spark: SparkSession, d: str) -> DataFrame:
    """The size that most characters have, the first seen of equals."""
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("book"), F.round(F.col("l_quantity") / 5, 1).alias("size"), (F.col("l_partkey") % 160 + 1).alias("chars"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    c = s.groupBy("book", "size").agg(F.sum("chars").alias("chars"), F.min("at").alias("first_seen"))
    return c.groupBy("book").agg(F.max_by("size", F.struct("chars", -F.col("first_seen"))).alias("body_size"))


@query(f"select page, block, case when n_chars < 150 and size >= 1.35 * body_size then '# ' when n_chars < 150 and (size >= 1.15 * body_size or (bold and n_chars < 90)) then '## ' else '' end as heading from spans join {_BODY} b on b.book = spans.book")
def heading_class(spark: SparkSession, d: str) -> DataFrame:
    """Headings by their size against that of their book's body."""
    body = F.broadcast(font_mode(spark, d))  # one row a book
    h = X.heading(F.col("size"), F.col("body_size"), F.col("n_chars"), F.col("bold"), F.lit(1))
    return table(spark, d, "spans").join(body, "book").select("page", "block", h.alias("heading"))


@query("""
select a.page, a.block, max(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, (a.x1 - a.x0) * (a.y1 - a.y0))) > 0.5 as in_table
from spans a join spans b on a.page = b.page and b.block = 1 where a.block > 1 group by a.page, a.block""")
def bbox_in_table(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of which more than half lies in their page's table; boxes meet only within a page."""
    s = table(spark, d, "spans").select("page", "block", "x0", "y0", "x1", "y1")
    t = s.where("block = 1").select("page", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    side = lambda k: F.greatest(F.lit(0), F.least(f"{k}1", f"t_{k}1") - F.greatest(f"{k}0", f"t_{k}0"))
    part = side("x") * side("y") / F.greatest(F.lit(1), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return s.where("block > 1").join(t, "page").groupBy("page", "block").agg((F.max(part) > 0.5).alias("in_table"))


@query("""
with p as (select l_partkey as xref, count(distinct l_orderkey) as pages, min(l_orderkey) as first_page from lineitem group by 1)
select xref, pages, first_page, pages > 3 as repeated from p""")
def image_repeat_pages(spark: SparkSession, d: str) -> DataFrame:
    """On how many different pages an image stands; the first page is the one that a repeated image is reported on."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("xref")).agg(F.count_distinct("l_orderkey").alias("pages"), F.min("l_orderkey").alias("first_page"))
    return p.withColumn("repeated", F.col("pages") > 3)


#: fixed values: tokens of a call's answers and overheads by stage, of a big book, of its parts and of the material of a synthesis
BIG_TOKENS, PART_TOKENS, MATERIAL_TOKENS = 880_000, 600_000, 700_000
MAP_OUT, EXTRACT_OUT, EXTRACT_SHARE, EXTRACT_IN = 9000, 3000, 0.6, 3500
VERIFY_IN, VERIFY_IN_SHARE, VERIFY_OUT, VERIFY_OUT_SHARE = 4000, 1.6, 4000, 0.15
SYNTHESIS_IN, SYNTHESIS_OUT = 20_000, 20_000
#: fixed values: tokens of a page's or image's request and answer
IMAGE_IN, IMAGE_OUT, PAGE_OUT = 1500, 1000, 2000
#: prices for a million tokens: input, output, cache read factor; the second model has no cache
MODEL_PRICE, SECOND_PRICE = (2.0, 10.0, 0.10), (0.75, 3.75)


def estimates(books: DataFrame, batch: bool, price=MODEL_PRICE, second=SECOND_PRICE) -> DataFrame:
    """books(book, tokens, map_tokens, units, unit_tokens, alive) with the cost of each stage before any call, in dollars.

    tokens: of the whole book; unit_tokens: summed over its units; alive: whether the model's cache still holds the book.
    """
    p_in, p_out, read = price
    off = BATCH_FACTOR if batch else 1.0
    t, n, u, m = F.col("tokens"), F.col("units"), F.col("unit_tokens"), F.col("map_tokens")
    big = t > BIG_TOKENS
    parts = F.when(big, F.ceil(t / PART_TOKENS)).otherwise(1)
    write = F.lit(1.0) if batch else F.when(big, 1.0).otherwise(CACHE_WRITE_FACTOR)
    whole = F.lit(p_in) if batch else F.lit(p_in * read)
    each = (u + n * (m + EXTRACT_IN)) * p_in
    extract_in = each if batch else F.when(big, each).otherwise(n * t * (p_in * read))
    material = F.least(EXTRACT_SHARE * t, F.lit(float(MATERIAL_TOKENS))) + m + SYNTHESIS_IN
    costs = {
        "map_cost": (t * p_in * write + parts * (MAP_OUT * p_out)) / 1e6 * off,
        "cache_cost": F.lit(0.0) if batch else F.when(big | F.col("alive"), 0.0).otherwise(t * p_in * CACHE_WRITE_FACTOR / 1e6),
        "extract_cost": (extract_in + (EXTRACT_SHARE * u + EXTRACT_OUT * n) * p_out) / 1e6 * off,
        "verify_cost": ((VERIFY_IN_SHARE * u + VERIFY_IN * n) * second[0] + (VERIFY_OUT_SHARE * u + VERIFY_OUT * n) * second[1]) / 1e6,
        "synthesis_cost": (F.when(big, material * p_in).otherwise(t * whole) + SYNTHESIS_OUT * p_out) / 1e6 * off,
    }
    out = books.select("book", "tokens", big.alias("big"), parts.cast("long").alias("parts"), *[F.round(c, 6).alias(k) for k, c in costs.items()])
    later = [F.col(k) for k in costs if k != "map_cost"]
    return out.withColumn("total_cost", F.round(later[0] + later[1] + later[2] + later[3], 4))


_BOOKS = "(select source as book, cast(sum(length(text)) // 4 * case when length(source) % 2 = 0 then 1000 else 1 end as bigint) as tokens, cast(sum(length(text)) // 40 as bigint) as m, count(*) as n, cast(sum(length(text) // 4) as bigint) as u, min(doc_id) % 3 = 0 as alive from book_docs group by source)"


def _estimate_sql(batch: bool) -> str:
    off, read = (0.5, 1.0) if batch else (1.0, 0.1)
    extract = "(u + n * (m + 3500)) * 2.0" if batch else "case when big then (u + n * (m + 3500)) * 2.0 else n * tokens * 0.2 end"
    return f"""select book, tokens, big, parts, map_cost, cache_cost, extract_cost, verify_cost, synthesis_cost, round(cache_cost + extract_cost + verify_cost + synthesis_cost, 4) as total_cost, {str(batch).lower()} as batch from (select book, tokens, big, parts,
  round((tokens * 2.0 * {"1.0" if batch else "case when big then 1.0 else 2.0 end"} + parts * 90000.0) / 1e6 * {off}, 6) as map_cost, {"cast(0.0 as double)" if batch else "round(case when big or alive then 0.0 else tokens * 2.0 * 2.0 / 1e6 end, 6)"} as cache_cost,
  round(({extract} + (0.6 * u + 3000 * n) * 10.0) / 1e6 * {off}, 6) as extract_cost, round(((1.6 * u + 4000 * n) * 0.75 + (0.15 * u + 4000 * n) * 3.75) / 1e6, 6) as verify_cost,
  round((case when big then (least(0.6 * tokens, 700000.0) + m + 20000) * 2.0 else tokens * {2.0 * read} end + 200000.0) / 1e6 * {off}, 6) as synthesis_cost
  from (select *, tokens > 880000 as big, case when tokens > 880000 then cast(ceil(tokens / 600000.0) as bigint) else 1 end as parts from (select book, cast(tokens as double) as t_, tokens, cast(m as double) as m, cast(n as double) as n, cast(u as double) as u, alive from {_BOOKS})))"""


@query(f"select * replace (cast(map_cost as double) as map_cost, cast(cache_cost as double) as cache_cost, cast(extract_cost as double) as extract_cost, cast(verify_cost as double) as verify_cost, cast(synthesis_cost as double) as synthesis_cost, cast(total_cost as double) as total_cost) from ({_estimate_sql(True)} union all {_estimate_sql(False)})")
def estimate_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost of every stage of each book before any call, with and without batches, from lengths alone; here every other book is a thousand times as long."""
    n = F.length("text")
    b = table(spark, d, "book_docs").groupBy(F.col("source").alias("book")).agg(F.sum(n).alias("chars"), F.count("*").alias("units"), F.sum(F.floor(n / 4)).cast("long").alias("unit_tokens"), (F.min("doc_id") % 3 == 0).alias("alive"))
    tokens = F.floor(F.col("chars") / 4) * F.when(F.length("book") % 2 == 0, 1000).otherwise(1)
    b = b.select("book", tokens.cast("long").alias("tokens"), F.floor(F.col("chars") / 40).cast("long").alias("map_tokens"), "units", "unit_tokens", "alive")
    return estimates(b, True).withColumn("batch", F.lit(True)).unionByName(estimates(b, False).withColumn("batch", F.lit(False)))


@query(f"select source, count(*) filter (doc_id % 3 <> 0) as images, count(*) filter (doc_id % 3 = 0) as pages, round((count(*) * {IMAGE_IN} * 0.75 + count(*) filter (doc_id % 3 <> 0) * {IMAGE_OUT} * 3.75 + count(*) filter (doc_id % 3 = 0) * {PAGE_OUT} * 3.75) / 1e6, 6) as cost from book_docs group by source")
def estimate_images(spark: SparkSession, d: str) -> DataFrame:
    """Cost of reading images and pages before any call."""
    page = F.col("doc_id") % 3 == 0
    b = table(spark, d, "book_docs").groupBy("source").agg(F.count_if(~page).alias("images"), F.count_if(page).alias("pages"))
    n, (p_in, p_out) = F.col("images") + F.col("pages"), SECOND_PRICE
    return b.withColumn("cost", F.round((n * IMAGE_IN * p_in + F.col("images") * IMAGE_OUT * p_out + F.col("pages") * PAGE_OUT * p_out) / 1e6, 6))


_STATE = f"{[stream.QUEUED, *stream.WORKING, *stream.FINAL]}[1 + cast(event_id % 9 as int)]"


@query(f"select event_id, {_STATE} as state, event_id % 9 < 5 as can_cancel, event_id % 9 >= 5 and not (event_id % 9 = 5 and user_id % 2 = 0) as can_resume, event_id % 9 >= 5 as can_remove, cast(value * 100 as bigint) in (429, 500, 502, 503, 529) as retryable from events")
def job_flags(spark: SparkSession, d: str) -> DataFrame:
    """What can be done with a job in each state; one that ended without problems isn't resumed."""
    from .jobs import RETRYABLE

    states = F.array(*[F.lit(x) for x in (stream.QUEUED, *stream.WORKING, *stream.FINAL)])
    e = table(spark, d, "events").withColumn("state", F.element_at(states, (F.col("event_id") % 9 + 1).cast("int")))
    can = stream.flags(F.col("state"), F.col("user_id") % 2)
    return e.select("event_id", "state", *[c.alias(k) for k, c in can.items()], F.round(F.col("value") * 100).cast("long").isin(list(RETRYABLE)).alias("retryable"))
