"""Inference jobs: keys, cache, runner, second tries, rendering, substitution. Models are injected calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

PLACEHOLDER = "ZZOCRZZ[0-9a-f]{16}ZZ"
#: fixed values: status codes that a further try may mend, errors that none does
RETRYABLE = (429, 500, 502, 503, 529)
FATAL = ("invalid_request_error", "prompt is too long", "not_found_error", "permission_error", "authentication_error")
#: fixed values: all statuses of a job; what a finish reason holds, in the order of the tests, and the status that follows
STATUSES = ("ok", "cached", "decorative", "truncated", "recitation", "blocked", "failed", "skipped")
FINISH = {"RECITATION": "recitation", "SAFETY": "blocked", "PROHIBITED": "blocked", "BLOCKLIST": "blocked", "SPII": "blocked", "MAX_TOKENS": "truncated"}
#: fixed values: an answer that an image is decoration, and that a page has no tables; tries of a call and the seconds between them
DECORATIVE, NO_TABLES = "[DECORATIVE]", "[NO TABLES]"
TRIES, WAITS = 3, (3, 10, 30)
#: fixed values: what stands for a job in a text
IMAGE_TEXT = "\n\n<!-- IMAGE: {label} -->\n{text}\n<!-- /IMAGE -->\n\n"
PAGE_TEXT = "\n\n{text}\n\n"
CAPTIONED_TEXT = "\n\n[IMAGE MARKED DECORATIVE DESPITE CAPTION: {label}]\n\n"
TABLES_TEXT = (
    "\n\n<!-- {label}: la página completa fue bloqueada ({reason}); texto nativo del PDF, seguido de sus tablas y recuadros transcritos de la "
    "imagen. Para los números de las tablas usar la versión transcrita. -->\n\n{native}\n\n<!-- TABLES FROM IMAGE: {label} -->\n{tables}\n<!-- /TABLES -->\n\n"
)
TRUNCATED_MARK = "\n[TRANSCRIPTION TRUNCATED: {label}]"
NATIVE_TEXT = "\n\n<!-- {label}: transcripción con imagen falló ({reason}); se usa el texto nativo del PDF -->\n\n{native}\n\n"
PAGE_LOST = "\n\n[PAGE NOT PROCESSED: {label} — {reason}]\n\n"
IMAGE_LOST = "\n\n[IMAGE NOT PROCESSED: {label} — {reason}]\n\n"


def is_decorative() -> Column:
    """Of columns status and text: whether the model took the image for decoration."""
    return F.col("status").isin("ok", "cached") & (X.strip(F.col("text")) == DECORATIVE)


def rendered() -> Column:
    """What stands for a job, of its columns status, kind, label, text, reason, captioned, native and tables; failures stay visible."""
    status, page, image = F.col("status"), F.col("kind") == "page", F.col("kind") == "image"
    text, native, tables = (X.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("text", "native", "tables"))
    values = {"label": F.col("label"), "reason": F.coalesce("reason", F.lit("")), "native": native, "tables": tables}
    put = lambda template, **more: X.fill(template, values | more)
    cut = F.concat(text, put(TRUNCATED_MARK))
    done = status.isin("ok", "cached")
    return (
        F.when(done & (text == DECORATIVE) & F.col("captioned"), put(CAPTIONED_TEXT))
        .when(done & (text == DECORATIVE), F.lit(""))
        .when(done & image, put(IMAGE_TEXT, text=text))
        .when(done, put(PAGE_TEXT, text=text))
        .when(page & (tables != "") & (native != ""), put(TABLES_TEXT))
        .when((status == "truncated") & image, put(IMAGE_TEXT, text=cut))
        .when(status == "truncated", put(PAGE_TEXT, text=cut))
        .when(page & (native != ""), put(NATIVE_TEXT))
        .when(page, put(PAGE_LOST))
        .otherwise(put(IMAGE_LOST))
    )


def substitute(texts: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """texts(key, text) with each placeholder replaced by its job's text: pieces are exploded, joined and put together in order."""
    pieces = texts.select(key, F.posexplode(F.arrays_zip(F.split("text", PLACEHOLDER, -1).alias("piece"), F.concat(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0)), F.array(F.lit(None).cast("string"))).alias("token"))).alias("i", "p"))
    found = pieces.select(key, "i", "p.piece", "p.token").join(jobs.select("token", F.col("text").alias("__put")), "token", "left")
    parts = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "piece", F.coalesce("__put", F.lit("")).alias("put")))).alias("p"))
    return parts.select(key, F.array_join(F.transform("p", lambda s: F.concat(s["piece"], s["put"])), "").alias("text"))


def pending(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """One job for each key that the cache hasn't, the first by position."""
    left = jobs.join(cache, "key", "left_anti")
    return left.groupBy("key").agg(F.min_by(F.struct(*[c for c in left.columns if c != "key"]), "pos").alias("j")).select("key", "j.*")


def finished(finish: Column, text: Column) -> Column:
    """The status that a call's finish reason and stripped text give; null if it has to be tried again."""
    out = None
    for sign, status in FINISH.items():
        out = (F if out is None else out).when(F.contains(F.coalesce(finish, F.lit("")), F.lit(sign)), status)
    return out.when(F.coalesce(X.strip(text), F.lit("")) != "", "ok")


def attempt(call: Callable, kind: str, data: bytes, tries: int = TRIES, waits=WAITS, sleep: Callable = time.sleep) -> tuple[str, str, str]:
    """(status, text, reason) of a call that returns (finish reason, text): empty answers and errors are tried again."""
    last = ""
    for n in range(tries):
        try:
            finish, text = call(kind, data)
            finish, text = str(finish or ""), (text or "").strip()
            status = next((s for sign, s in FINISH.items() if sign in finish), "ok" if text else None)
            if status:
                return status, text, "" if status == "ok" else finish
            last = f"respuesta vacía ({finish or 'sin motivo'})"
        except Exception as e:  # the failure is the job's result
            last = str(e)[:200]
        if n < tries - 1:
            sleep(waits[n])
    return "failed", "", last


def transcribe(jobs: DataFrame, call: Callable[[str, bytes], tuple[str, str]], tries: int = TRIES, waits=WAITS) -> DataFrame:
    """(key, status, text, reason) by an injected model call, batch by batch; see attempt."""

    def run(batches) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [(k, *attempt(call, kind, bytes(data or b""), tries, waits)) for k, kind, data in zip(pdf["key"], pdf["kind"], pdf["data"])]
            yield pd.DataFrame(rows, columns=["key", "status", "text", "reason"])

    return jobs.select("key", "kind", "data").mapInPandas(run, "key string, status string, text string, reason string")


def run_jobs(jobs: DataFrame, cache: DataFrame, call: Callable | None, **options) -> tuple[DataFrame, DataFrame]:
    """(jobs with status, text, reason; rows (key, text) new to the cache) of jobs(key, kind, data, pos, ...) and cache(key, text).

    Each key that the cache hasn't is asked once, for its first job; its other jobs share the answer. Without a call, the
    work is skipped. Only `ok` answers are cached, and not those of forced images that still say decoration. Write the
    results before they are used twice, or the calls are made twice.
    """
    todo = pending(jobs.select("key", "kind", "data", "pos"), cache.select("key"))
    if call is None:
        done = todo.select("key", F.lit("skipped").alias("status"), F.lit("").alias("text"), F.lit("sin llave").alias("reason"))
    else:
        done = transcribe(todo, call, **options)
    old = cache.select("key", F.lit("cached").alias("status"), "text", F.lit("").alias("reason"))
    out = jobs.drop("status", "text", "reason").join(done.unionByName(old), "key", "left")
    fresh = out.where("status = 'ok'").where((F.col("kind") != "image_forced") | (X.strip(F.col("text")) != DECORATIVE))
    return out, fresh.groupBy("key").agg(F.min("text").alias("text"))


def captioned_again(jobs: DataFrame) -> DataFrame:
    """The jobs of captioned images that were taken for decoration, one for each key, to be asked with a firmer request."""
    first = jobs.where(is_decorative() & F.col("captioned")).groupBy("key").agg(F.min_by(F.struct("data", "pos"), "pos").alias("j"))
    return first.select(F.col("key").alias("first_key"), X.content_key(F.col("j.data"), F.lit("image_forced")).alias("key"), F.lit("image_forced").alias("kind"), "j.data", "j.pos")


def blocked_again(jobs: DataFrame) -> DataFrame:
    """The jobs of pages that were refused as recitation but have a text of their own, one for each key, to be asked for their tables."""
    some = (F.col("kind") == "page") & (F.col("status") == "recitation") & (X.strip(F.coalesce("native", F.lit(""))) != "")
    first = jobs.where(some).groupBy("key").agg(F.min_by(F.struct("data", "pos"), "pos").alias("j"))
    return first.select(F.col("key").alias("first_key"), X.content_key(F.col("j.data"), F.lit("tables")).alias("key"), F.lit("tables").alias("kind"), "j.data", "j.pos")


def rescued(jobs: DataFrame, again: DataFrame) -> DataFrame:
    """jobs with `tables`: the answers to blocked_again(first_key, status, text) that hold tables."""
    text = X.strip(F.coalesce("text", F.lit("")))
    good = again.where(F.col("status").isin("ok", "cached")).select(F.col("first_key").alias("key"), text.alias("tables")).where(F.col("tables").isin("", NO_TABLES) == F.lit(False))
    return jobs.drop("tables").join(good, "key", "left").withColumn("tables", F.coalesce("tables", F.lit("")))


def override(jobs: DataFrame, again: DataFrame, columns=("status", "text")) -> DataFrame:
    """Results of a second try take the place of the first ones, for the keys that have one."""
    new = again.select("key", F.lit(True).alias("__again"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = jobs.join(new, "key", "left")
    keep = [c for c in jobs.columns if c not in columns]
    return both.select(*keep, *[F.when(F.col("__again"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns])
