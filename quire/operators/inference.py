"""Calls of language models as operators: requests, immediate calls with further tries, batches, change-sets of units."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..sources import ledger
from ..staging import materialise
from ..views import duck, table
from .jobs import FATAL, FINISH, RETRYABLE, finished
from .knowledge import numbered

QUERIES, ORACLES = {}, {}
#: fixed values: tries of a call, the seconds that the n-th wait takes n times, and the answer's end that marks it as cut
CALL_TRIES, CALL_WAIT, CUT_STOP = 3, 30, "max_tokens"
#: what a request tells of the text that it holds; callers may give their own
PART_NOTE = "Only part {k} of {n} of the book follows; number its units P{k}U01, P{k}U02 and so on, without gaps.\n\n"
UNIT_NOTE = "Only the text of the unit follows, not the whole book; the map tells of the rest.\n\n"
MATERIAL_NOTE = "The entries already taken from the book follow in place of its text; add nothing that they don't support.\n\n"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


# ---------------------------------------------------------------- requests

def _tagged(name: str, text: Column, head: Column | None = None) -> Column:
    return F.concat(F.lit(f"<{name}"), F.lit("") if head is None else head, F.lit(">\n"), text, F.lit(f"\n</{name}>"))


def book_request(book: Column, task: Column) -> Column:
    """A request of two texts: the whole book, which may be cached, and the task."""
    return F.array(_tagged("book", book), task)


def part_request(part: Column, k: Column, n: Column, task: Column, note: str = PART_NOTE) -> Column:
    which = {"k": k.cast("string"), "n": n.cast("string")}
    return F.array(_tagged("book_part", part, X.fill(' n="{k}" of="{n}"', which)), F.concat(X.fill(note, which), task))


def unit_request(unit: Column, task: Column, note: str = UNIT_NOTE) -> Column:
    return F.array(_tagged("unit", unit), F.concat(F.lit(note), task))


def material_request(material: Column, task: Column, note: str = MATERIAL_NOTE) -> Column:
    return F.array(_tagged("extracted_entries", material), F.concat(F.lit(note), task))


def unit_or_book(unit: Column, book: Column, task: Column, batch: bool, big: Column) -> Column:
    """A unit's request: its own text in a batch or of a big book, else the whole book, whose cache then pays."""
    return F.when(F.lit(batch) | big, unit_request(unit, task)).otherwise(book_request(book, task))


@query("""
select doc_id, md5(case when doc_id % 4 = 0 then '<book>' || chr(10) || text || chr(10) || '</book>' || 'task ' || doc_id when doc_id % 4 = 1 then '<book_part n="' || (doc_id % 3 + 1) || '" of="3">' || chr(10) || text || chr(10) || '</book_part>' || 'Only part ' || (doc_id % 3 + 1) || ' of 3 of the book follows; number its units P' || (doc_id % 3 + 1) || 'U01, P' || (doc_id % 3 + 1) || 'U02 and so on, without gaps.' || chr(10) || chr(10) || 'task ' || doc_id
  when doc_id % 4 = 2 then '<unit>' || chr(10) || text || chr(10) || '</unit>' || 'Only the text of the unit follows, not the whole book; the map tells of the rest.' || chr(10) || chr(10) || 'task ' || doc_id else '<extracted_entries>' || chr(10) || text || chr(10) || '</extracted_entries>' || 'The entries already taken from the book follow in place of its text; add nothing that they don''t support.' || chr(10) || chr(10) || 'task ' || doc_id end) as request_md5 from documents""")
def requests(spark: SparkSession, d: str) -> DataFrame:
    """The four kinds of requests, here of documents."""
    t, task, kind = F.col("text"), F.concat(F.lit("task "), F.col("doc_id").cast("string")), F.col("doc_id") % 4
    k = F.col("doc_id") % 3 + 1
    both = F.when(kind == 0, book_request(t, task)).when(kind == 1, part_request(t, k, F.lit(3), task)).when(kind == 2, unit_request(t, task)).otherwise(material_request(t, task))
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(both, "")).alias("request_md5"))


_FINISHES = ["STOP", "FinishReason.RECITATION", "SAFETY", "PROHIBITED_CONTENT", "BLOCKLIST", "SPII", "MAX_TOKENS", ""]


@query(f"select event_id, case when contains(finish, 'RECITATION') then 'recitation' when contains(finish, 'SAFETY') or contains(finish, 'PROHIBITED') or contains(finish, 'BLOCKLIST') or contains(finish, 'SPII') then 'blocked' when contains(finish, 'MAX_TOKENS') then 'truncated' when user_id % 3 > 0 then 'ok' end as status from (select *, {_FINISHES}[1 + cast(event_id % 8 as int)] as finish from events)")
def finish_status(spark: SparkSession, d: str) -> DataFrame:
    """The status that follows from a call's finish reason and text; none if it has to be tried again."""
    e = table(spark, d, "events")
    finish = F.element_at(F.array(*[F.lit(x) for x in _FINISHES]), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select("event_id", finished(finish, F.when(F.col("user_id") % 3 > 0, "text").otherwise(" \n")).alias("status"))


# ---------------------------------------------------------------- immediate calls

class CallError(Exception):
    """An error of a model call with the status code of its answer, if any."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def persistent(call: Callable, request, tries: int = CALL_TRIES, wait: float = CALL_WAIT, sleep: Callable = time.sleep):
    """call(request), tried again after connection errors, timeouts and status codes that may pass; other errors are raised."""
    last = None
    for n in range(1, tries + 1):
        try:
            return call(request)
        except CallError as e:
            if e.status not in RETRYABLE:
                raise
            last = e
        except (ConnectionError, TimeoutError) as e:
            last = e
        sleep(wait * n)
    raise RuntimeError(f"falló tras {tries} intentos: {last}")


def ask(requests: DataFrame, call: Callable[[list[str]], tuple[str, str]], tries: int = CALL_TRIES, wait: float = CALL_WAIT) -> DataFrame:
    """(id, text, truncated, error) of requests(id, request: array of texts) by an injected call that returns (text, stop reason)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key, request in zip(pdf["id"], pdf["request"]):
                try:
                    text, stop = persistent(call, list(request), tries, wait)
                    rows.append((key, text, stop == CUT_STOP, None))
                except Exception as e:  # told as the request's result; the others go on
                    rows.append((key, None, False, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["id", "text", "truncated", "error"])

    return requests.select("id", "request").mapInPandas(run, "id string, text string, truncated boolean, error string")


def ask_after_first(requests: DataFrame, call: Callable, **options) -> DataFrame:
    """As `ask`, of requests(id, book, request): one request of each book is answered before the others are sent.

    It writes the cache of the prefix that a book's requests share, from which the others then read.
    """
    least = requests.groupBy("book").agg(F.min("id").alias("id"))
    first = materialise(ask(requests.join(least, ["book", "id"], "left_semi"), call, **options), "first")  # done before the rest starts
    return first.unionByName(ask(requests.join(least, ["book", "id"], "left_anti"), call, **options))


def verify_units(units: DataFrame, extracts: DataFrame, verified: DataFrame, template: str, call: Callable, **options) -> DataFrame:
    """Change-sets (id, text, truncated, error) of the units that have entries but no change-set yet.

    units(unit_id, title, start_line, end, source_text), extracts(unit_id, pos, dest, title, body), verified(unit_id). The
    template's fields unit_id, unit_title, unit_start, unit_end and entries are filled; summaries and logs aren't shown.
    """
    shown = numbered(extracts.where("dest not in ('SUMMARY', 'LOG')")).withColumnRenamed("text", "entries")
    todo = units.join(extracts.select("unit_id").distinct(), "unit_id", "left_semi").join(verified, "unit_id", "left_anti").join(shown, "unit_id", "left")
    values = {"unit_id": F.col("unit_id").cast("string"), "unit_title": F.coalesce("title", F.lit("")), "unit_start": F.col("start_line"), "unit_end": F.col("end"), "entries": F.coalesce("entries", F.lit(""))}
    rows = todo.select(F.col("unit_id").cast("string").alias("id"), unit_request(F.col("source_text"), X.fill(template, values)).alias("request"))
    return ask(rows, call, **options)


# ---------------------------------------------------------------- batches

def batch_step(state: dict | None, jobs: list[dict], client) -> tuple[str, dict | None, list[tuple]]:
    """(status, state, answers) of a stage's batch: submitted, waiting or done.

    state: of a batch that was sent, as JSON keeps it; without one, jobs (id, label, request) are sent. client.send(jobs)
    gives a batch id, client.poll(id) tells whether it ended, client.results(id) yields (custom id, text, stop, error) in any
    order. An answer is (id, text, truncated, error, fatal); unknown ids are left out.
    """
    if state is not None:
        if not client.poll(state["batch_id"]):
            return "waiting", state, []
        known = {j["id"] for j in state["jobs"]}
        answers = []
        for key, text, stop, error in client.results(state["batch_id"]):
            if key in known:
                told = str(error) if error is not None else None
                answers.append((key, text, stop == CUT_STOP, told, told is not None and any(x in told for x in FATAL)))
        return "done", None, answers
    if not jobs:
        return "done", None, []
    state = {"batch_id": client.send(jobs), "jobs": [{"id": j["id"], "label": j["label"]} for j in jobs]}
    return "submitted", json.loads(json.dumps(state)), []


REQUESTS = "id string, label string, request array<string>"
SUBMISSIONS = "file string, batch_id string, n_requests long"
ANSWERS = "batch_id string, id string, text string, stop string, error string"


def write_requests(requests: DataFrame, root: str, per_file: int = 10_000) -> None:
    """More requests(id, label, request) to root/requests, as JSON lines; a file, of per_file requests at most, is one batch."""
    requests.select("id", "label", "request").write.option("maxRecordsPerFile", per_file).mode("append").json(f"{root}/requests")


def submit_batches(spark: SparkSession, root: str, client) -> None:
    """Send each file of requests once, by a stream that takes what is new and ends; submissions(file, batch_id, n_requests) grow by a transaction.

    client.send(key, requests) gives a batch id, and the same one if it is asked again with a key: a file's name. Thus a
    stream that was stopped between sending and writing sends nothing twice. Tasks send; no request passes through the driver.
    """

    def send(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                requests = [json.loads(x) for x in bytes(content).decode().splitlines() if x.strip()]
                name = path.rpartition("/")[2]
                if requests:
                    rows.append((name, client.send(name, requests), len(requests)))
            yield pd.DataFrame(rows, columns=["file", "batch_id", "n_requests"])

    def step(df, n):
        ledger.commit(df.select("path", "content").mapInPandas(send, SUBMISSIONS), f"{root}/submissions", f"submit-{n}")

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").load(f"{root}/requests")
    query = files.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/_submit").trigger(availableNow=True).start()
    query.awaitTermination()


def collect_batches(spark: SparkSession, root: str, client) -> int:
    """Ask for all batches that are still open, take the answers of those that ended, and count those that wait on.

    client.poll(batch id) tells whether it ended, client.results(batch id) yields (custom id, text, stop, error) in any order.
    The answers of a round and the marks of their batches are one transaction: a round that fails adds neither.
    """

    def poll(batches):
        for pdf in batches:
            yield pdf.assign(ended=[bool(client.poll(x)) for x in pdf["batch_id"]])

    def fetch(batches):
        import itertools

        import pandas as pd

        for pdf in batches:
            for batch_id in pdf["batch_id"]:
                rows = iter(client.results(batch_id))
                while some := list(itertools.islice(rows, 1000)):
                    yield pd.DataFrame([(batch_id, key, text, stop, None if error is None else str(error)) for key, text, stop, error in some], columns=["batch_id", "id", "text", "stop", "error"])
                yield pd.DataFrame([(batch_id, None, None, None, None)], columns=["batch_id", "id", "text", "stop", "error"])  # its mark

    sent = ledger.read(spark, f"{root}/submissions", SUBMISSIONS).select("batch_id").distinct()
    done = ledger.read(spark, f"{root}/answers", ANSWERS).where("id is null").select("batch_id")
    asked = materialise(sent.join(done, "batch_id", "left_anti").mapInPandas(poll, "batch_id string, ended boolean"), "polled")
    ended = asked.where("ended").select("batch_id")
    if ended.take(1):
        ledger.commit(ended.mapInPandas(fetch, ANSWERS), f"{root}/answers", f"answers-{uuid.uuid4().hex}")
    return asked.where("not ended").count()


def batch_answers(spark: SparkSession, root: str) -> DataFrame:
    """(id, text, truncated, error, fatal) of all answers taken, those to requests that were never written left out."""
    known = spark.read.schema(REQUESTS).json(f"{root}/requests").select("id").distinct()
    told = ledger.read(spark, f"{root}/answers", ANSWERS).where("id is not null").join(known, "id", "left_semi")
    fatal = F.coalesce(F.col("error").rlike("|".join(re.escape(x) for x in FATAL)), F.lit(False))
    return told.select("id", "text", (F.coalesce(F.col("stop"), F.lit("")) == CUT_STOP).alias("truncated"), "error", fatal.alias("fatal"))


def collected(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """jobs(id, ...) with text, truncated and state: succeeded, fatal (not asked again), errored or missing (both asked again)."""
    state = F.when(F.col("fatal"), "fatal").when(F.col("error").isNotNull(), "errored").when(F.col("text").isNotNull(), "succeeded").otherwise("missing")
    return jobs.join(answers.select("id", "text", "truncated", "error", "fatal"), "id", "left").withColumn("state", state).drop("fatal")
