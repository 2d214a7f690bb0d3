"""Jobs as streams: event lines, the job state machine, and its latest state as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

MARK = "@@BPP "
EVENT = "evento string, programa string, costo double, lineas array<string>, minutos double"
#: fixed values: states in which a job ends, is at work, and waits
FINAL = ("terminado", "error", "cancelado", "interrumpido")
WORKING = ("convirtiendo", "extrayendo", "esperando_confirmacion", "esperando_lote")
QUEUED, INTERRUPTED = "en_fila", "interrumpido"
WAITING = ("esperando_confirmacion", "esperando_lote")
#: the state that a stage has while it works; BACK leads there
STAGES = {"convirtiendo": "conversion", "extrayendo": "extraccion"}
BACK = "@"
#: event, the states in which it counts (none: before a job exists, or after it was removed), the state that follows
TRANSITIONS = [
    ("crear", ("",), QUEUED),
    ("iniciar", (QUEUED,), "convirtiendo"),
    ("convertido", ("convirtiendo",), "extrayendo"),
    ("preguntar", ("convirtiendo", "extrayendo", "esperando_lote"), "esperando_confirmacion"),
    ("aprobar", ("esperando_confirmacion",), BACK),
    ("rechazar", ("esperando_confirmacion",), "cancelado"),
    ("lote", ("convirtiendo", "extrayendo"), "esperando_lote"),
    ("listo", ("extrayendo", "esperando_lote"), "terminado"),
    ("fallar", WORKING, "error"),
    ("cancelar", (QUEUED, *WORKING), "cancelado"),
    ("cerrar", (QUEUED, *WORKING), INTERRUPTED),
    ("reanudar", FINAL, QUEUED),
    ("eliminar", FINAL, ""),
]
#: an event without a transition: a line of the log; characters of lines that only decorate; the length of a message
LINE, RULES, MESSAGE = "linea", "-=─═ ", 200
EVENTS = [e for e, _, _ in TRANSITIONS] + [LINE]
_NEXT = {(state, event): after for event, states, after in TRANSITIONS for state in states}


def advance(state: str, stage: str, message: str, event: str, line: str | None) -> tuple[str, str, str]:
    """(state, stage, message) after an event; one that doesn't count in this state changes nothing."""
    if event == LINE:
        text = (line or "").strip()
        told = text and not set(text) <= set(RULES) and state not in WAITING
        return state, stage, text[:MESSAGE] if told else message
    after = _NEXT.get((state, event), state)
    if after == BACK:
        after = next((s for s, name in STAGES.items() if name == stage), "extrayendo")
    return after, STAGES.get(after, stage), message


#: all pairs of state and stage; what an event does, or any stretch of events, is a map of these, and such maps compose
PAIRS = [(s, g) for s in ("", QUEUED, *WORKING, *FINAL) for g in ("", *STAGES.values())]
_AT = {p: i for i, p in enumerate(PAIRS)}
_STEP = {e: tuple(_AT[advance(s, g, "", e, None)[:2]] for s, g in PAIRS) for e, _, _ in TRANSITIONS}
_TOLD = [s not in WAITING for s, _ in PAIRS]
_SAME = tuple(range(len(PAIRS)))


class Stretch:
    """What consecutive events of one job do to each pair it may start from: the pair it ends in, and the message, if any."""

    composed: dict = {}  # of a worker: few maps arise, and each is composed with an event once

    def __init__(self):
        self.ends, self.told, self.n, self.last = _SAME, {}, 0, None

    def add(self, event_id, event, text) -> None:
        self.n, self.last = self.n + 1, event_id
        if text is not None:
            self.told[self.ends] = (self.n, text)  # heard by the starts that don't wait now
        elif event in _STEP:
            key = self.ends, event
            if key not in self.composed:
                self.composed[key] = tuple(_STEP[event][p] for p in self.ends)
            self.ends = self.composed[key]

    def messages(self) -> tuple[list[int], list[str]]:
        """(place in the messages of each start, -1 for none; the messages)."""
        heard = [max((v for ends, v in self.told.items() if _TOLD[ends[p]]), default=None) for p in _SAME]
        kept = sorted({v for v in heard if v is not None})
        return [-1 if v is None else kept.index(v) for v in heard], [text for _, text in kept]


def _stretches(batches):
    """Rows (job, event_id, event, text), sorted, to one row for each run of a job."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["job", "place", "n", "last", "ends", "which", "messages"]
    at = TaskContext.get().partitionId()  # ranges of ids: later ones have greater numbers
    done, job, held = [], None, None

    def row():
        which, messages = held.messages()
        return job, at, held.n, held.last, held.ends, which, messages

    def out():
        cols = list(zip(*done)) or [[]] * len(names)
        done.clear()
        kinds = (jobs, pa.int64(), pa.int64(), ids, pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    for batch in batches:
        jobs, ids = batch.schema.field(0).type, batch.schema.field(1).type
        for own, event_id, event, text in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or own != job:
                if held is not None:
                    done.append(row())
                job, held = own, Stretch()
            held.add(event_id, event, text)
        if len(done) >= 1000:
            yield out()
    if held is not None:
        done.append(row())
        yield out()


def history(events: DataFrame) -> DataFrame:
    """(job, state, stage, message, events, last_event) of events(job, event_id, event, line), in the order of event_id, ties by event and line.

    Events are range-sorted by job and id, so that a long job lies in several partitions. Each partition makes one map of each
    job's stretch there, and a job's maps, at most one a partition, are applied in turn to the state before any event.
    """
    text = F.regexp_replace(F.coalesce(F.col("line"), F.lit("")), r"(?U)^\s+|\s+$", "")
    told = (F.col("event") == LINE) & (F.regexp_replace(text, f"[{RULES[1:]}-]", "") != "")
    order = ["job", "event_id", "event", "line"]
    rows = events.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("job", "event_id", "event", F.when(told, F.substring(text, 1, MESSAGE)).alias("text"))
    kind = {c: events.schema[c].dataType.simpleString() for c in order}
    runs = rows.mapInArrow(_stretches, f"job {kind['job']}, place long, n long, last {kind['event_id']}, ends array<tinyint>, which array<int>, messages array<string>")
    runs = runs.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("place", "ends", "which", "messages"))).alias("r"), F.sum("n").alias("events"), F.max("last").alias("last_event"))

    def step(acc, r):
        at = acc["at"] + 1
        return F.struct(F.element_at(r["ends"], at).cast("int").alias("at"), F.coalesce(F.get(r["messages"], F.element_at(r["which"], at)), acc["message"]).alias("message"))

    done = runs.withColumn("s", F.aggregate("r", F.struct(F.lit(_AT["", ""]).alias("at"), F.lit("").alias("message")), step))
    name = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in PAIRS]), F.col("s.at") + 1)
    return done.select("job", name(0).alias("state"), name(1).alias("stage"), F.col("s.message").alias("message"), "events", "last_event")


def flags(state: Column, problems: Column) -> dict[str, Column]:
    """What can be done with a job: cancelled, resumed (not once it ended without problems), removed."""
    final = state.isin(list(FINAL))
    return {
        "can_cancel": state.isin(list(WORKING)) | (state == QUEUED),
        "can_resume": final & ~((state == "terminado") & (F.coalesce(problems, F.lit(0)) == 0)),
        "can_remove": final,
    }


def demux(lines: DataFrame, col: str = "line") -> DataFrame:
    """lines with `kind` (event or log) and the event's fields; works on streams alike. Malformed events are log text."""
    marked = F.col(col).startswith(MARK)
    told = F.when(marked, F.from_json(F.substring(F.col(col), len(MARK) + 1, 1_000_000_000), EVENT, {"mode": "PERMISSIVE"}))
    sound = told["evento"].isNotNull()
    return lines.withColumn("__e", told).withColumn("kind", F.when(sound, "event").otherwise("log")).select(*lines.columns, "kind", "__e.evento", "__e.programa", "__e.costo", "__e.lineas")


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs found in a state that isn't final when the queue starts are interrupted."""
    return jobs.withColumn("estado", F.when(F.col("estado").isin(*FINAL), F.col("estado")).otherwise(INTERRUPTED))


def _advance(key, batches: Iterator, state) -> Iterator:
    import pandas as pd

    now, last, n, late = (state.get[:3], *state.get[3:]) if state.exists else (("", "", ""), None, 0, 0)
    new = sorted((r for pdf in batches for r in zip(pdf["event_id"], pdf["event"], pdf["line"])), key=lambda r: r[0])
    for event_id, event, line in new:
        n += 1
        if last is not None and event_id <= last:
            late += 1
            continue
        now, last = advance(*now, event, line if isinstance(line, str) else None), int(event_id)
    state.update((*now, last, n, late))
    yield pd.DataFrame([(key[0], *now, n, late)], columns=["job", "state", "stage", "message", "n_events", "n_late"])


def job_states(events: DataFrame) -> DataFrame:
    """A stream of (job, state, stage, message, n_events, n_late), one row for each job of each batch, of events(job, event_id, event, line).

    All events of a batch are put in order before they count; one older than the last of an earlier batch is late and only counted.
    """
    out = "job long, state string, stage string, message string, n_events long, n_late long"
    held = "state string, stage string, message string, last long, n long, late long"
    return events.groupBy("job").applyInPandasWithState(_advance, out, held, "update", "NoTimeout")


class _Ordered:
    """Holds a job's events until the watermark has passed them, then lets them count in the order of time and id."""

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, stage string, message string, n long")
        self.held = handle.getListState("held", "at long, event_id long, event string, line string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        first = None
        for pdf in rows:
            at = (pdf["time"].astype("datetime64[us]").astype("int64")).tolist()
            new = [(a, int(i), e, x if isinstance(x, str) else None) for a, i, e, x in zip(at, pdf["event_id"], pdf["event"], pdf["line"])]
            if new:
                self.held.appendList(new)
                first = min([min(at)] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        all_held = sorted((tuple(r) for r in self.held.get()), key=lambda r: (r[0], r[1], r[2] or "", r[3] or ""))
        due = [r for r in all_held if r[0] // 1000 < mark]
        rest = all_held[len(due) :]
        state, stage, message, n = self.now.get() if self.now.exists() else ("", "", "", 0)
        now = state, stage, message
        for _, _, event, line in due:
            now = advance(*now, event, line)
        n += len(due)
        self.now.update((*now, n))
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.held.clear()
        if due:
            yield pd.DataFrame([(key[0], *now, n)], columns=["job", "state", "stage", "message", "n_events"])

    def close(self) -> None:
        pass


class _Sessions:
    """Calls of a key in sessions that end a time to live after their last call; each ends by a timer."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues):
        calls = [(t, t, 1) for pdf in rows for t in pdf["time"].astype("datetime64[us]").astype("int64").tolist()]
        merged: list[tuple[int, int, int]] = []
        for first, last, n in sorted([*calls, *(tuple(r) for r in (self.open.get() if self.open.exists() else []))]):
            if merged and first < merged[-1][1] + self.ttl * 1000:  # a call at the very end begins a new one
                a, b, m = merged[-1]
                merged[-1] = a, max(b, last), m + n
            else:
                merged.append((first, last, n))
        self.open.put(merged)
        for _, last, _ in merged:
            self.handle.registerTimer(last // 1000 + self.ttl + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        over = [r for r in held if r[1] // 1000 + self.ttl < mark]
        left = [r for r in held if r not in over]
        self.open.put(left) if left else self.open.clear()
        if over:
            yield pd.DataFrame([(key[0], pd.Timestamp(a, unit="us"), pd.Timestamp(b, unit="us"), n) for a, b, n in over], columns=["key", "first", "last", "n"])

    def close(self) -> None:
        pass


class _Polled:
    """Waiting things are asked again by a timer until they are done; what is known of them goes after `keep_ms` (state TTL)."""

    def __init__(self, ask, rest_ms: int, keep_ms: int):
        self.ask, self.rest, self.keep = ask, rest_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.calls = handle.getValueState("calls", "n long", self.keep)

    def _ask(self, key, timerValues):
        import pandas as pd

        n = (self.calls.get()[0] if self.calls.exists() else 0) + 1
        status = self.ask(key[0])
        if status == "pending":
            self.calls.update((n,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.rest)
        else:
            self.calls.clear()
        yield pd.DataFrame([(key[0], status, n)], columns=["key", "status", "calls"])

    def handleInputRows(self, key, rows, timerValues):
        for _ in rows:
            pass
        if not self.calls.exists():  # one that is waiting already has its timer
            yield from self._ask(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._ask(key, timerValues)

    def close(self) -> None:
        pass


def _processor(cls, *args):
    """An instance of cls as Spark's stateful processor; such streams need the RocksDB state store (see `timers`)."""
    from pyspark.sql.streaming import StatefulProcessor

    return type(cls.__name__, (cls, StatefulProcessor), {})(*args)


def timers(spark) -> None:
    """Set the state store that streams with timers need, for the streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ordered_states(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of (job, state, stage, message, n_events), a row for each job that moved, of events(job, event_id, event, line, time).

    Events count in the order of time and id, whatever batch they come in, once the watermark, `delay` behind the latest
    time seen, has passed them; those that come later still are dropped by the engine. Only events within the delay are held.
    """
    out = "job long, state string, stage string, message string, n_events long"
    return events.withWatermark("time", delay).groupBy("job").transformWithStateInPandas(_processor(_Ordered), out, "Update", "EventTime")


def ended_sessions(calls: DataFrame, ttl_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """A stream of (key, first, last, n): sessions of calls(key, time) that have ended, each given once, by a timer."""
    out = "key long, first timestamp, last timestamp, n long"
    return calls.withWatermark("time", delay).groupBy("key").transformWithStateInPandas(_processor(_Sessions, ttl_seconds * 1000), out, "Append", "EventTime")


def polled(waiting: DataFrame, ask, seconds: float = 180, keep_hours: float = 24) -> DataFrame:
    """A stream of (key, status, calls) of waiting(key string): ask(key) is called at once and again by a timer while it says "pending".

    What is known of a key goes when it is done, or after keep_hours without an answer.
    """
    out = "key string, status string, calls long"
    return waiting.groupBy("key").transformWithStateInPandas(_processor(_Polled, ask, int(seconds * 1000), int(keep_hours * 3_600_000)), out, "Update", "ProcessingTime")


def poll(step, seconds: float = 180, sleep=None, most: int | None = None) -> int:
    """Call step() until it doesn't return "pending", with a rest between two calls; the number of calls. most: of calls, if any."""
    import time

    calls = 1
    while step() == "pending" and (most is None or calls < most):
        (sleep or time.sleep)(seconds)
        calls += 1
    return calls
