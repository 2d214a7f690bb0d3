import datetime
import io
import json
import random
import time
import zipfile
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from quire import dims
from quire.functions import text as X
from quire.operators import assembly, documents, images, inference, jobs, knowledge, segment, usage
from quire.sources import epub, files, html, ledger
from quire.streaming import jobs as stream


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text, found", [("12.5kg", ["12"]), ("125kg", []), ("1,234,567", ["1,234", "567"]), ("3.5.2", ["3.5"]), ("v2.0", []), ("-7", ["7"]), ("5%", ["5"]), ("10-12", ["10", "12"]), ("ñ5", []), ("a.5", [])])
def test_numbers(spark, text, found):
    assert one(spark, text, X.numbers) == found


def test_tidy_and_strip(spark):
    assert one(spark, " a \r\n\r\n\r\n\r\nb\t\n ", X.tidy) == "a\n\nb\n"


def test_slugs(spark):
    assert one(spark, " Él & Ella -- 2 ", X.slug) == "l-ella-2"
    assert one(spark, "¿?", X.slug) == "libro"
    assert one(spark, "x" * 69 + " yz", X.slug) == "x" * 69 + "-"
    assert one(spark, "a-b c1", X.abbreviation) == "ABC1"


def test_caesar_and_garbled(spark):
    plain = "the cat and the dog of the house is in the garden with that bird"
    shifted = one(spark, plain, lambda c: X.caesar(c, 1))
    assert one(spark, shifted, lambda c: X.caesar(c, -1)) == plain
    assert one(spark, shifted, X.garbled) and not one(spark, plain, X.garbled)


def test_bodies_and_errors(spark):
    assert one(spark, ">\nx\n>>>\ny\n", X.clean_body) == "x\ny"
    assert one(spark, "well-\nknown Well-\nKnown", X.dehyphenate) == "wellknown Well-\nKnown"
    assert one(spark, "Error(message='no credit')", X.friendly_error) == "no credit"
    assert one(spark, "{'message': 'no credit'}", X.friendly_error) == "{'message': 'no credit'}"
    assert one(spark, "prompt is too long: 1234567 tokens > 1000000 maximum", X.friendly_error) == "el texto es demasiado largo para el modelo (1,234,567 tokens; máximo 1,000,000)"
    assert one(spark, "D:19990102", X.pdf_year) == "1999" and one(spark, "1999", X.pdf_year) is None
    assert one(spark, "c. 1998", X.year_of) == 1998 and one(spark, "?", X.year_of) is None
    assert one(spark, "v", lambda c: X.fill("a {k} {k}", {"k": c})) == "a v v"


@pytest.mark.parametrize("text, symbols, caption, box", [("take ##30 mg", True, False, False), ("value ,63 g", True, False, False), ("# 45 %", True, False, False), ("a$7%", False, False, False), ("(.3,500 kcal", True, False, False), ("1.3,500", False, False, False), ("see Chart 5", False, True, False), ("Gráfica 2", False, True, False), ("GRAFICO 2.1", False, True, False), ("## Panel B3", False, False, True), ("x\n\n  Recuadro 4", False, False, True), ("ver Tabla 2", False, True, False), ("Fig. 3", False, True, False), ("Fig 3", False, False, False), ("tableau 3", False, False, False)])
def test_signs_of_damage(spark, text, symbols, caption, box):
    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(X.SYMBOL_LOSS).alias("s"), F.col("t").rlike(X.CAPTION).alias("c"), F.col("t").rlike(X.LINE_CAPTION).alias("b")).first()
    assert tuple(row) == (symbols, caption, box)


def test_garbled_blocks(spark):
    plain = "the cat and the dog of the house is in the garden with that bird"
    moved = one(spark, plain, lambda c: X.caesar(c, 2))
    assert one(spark, moved + " J Med 12(3): 45; 12(3): 45", X.garbled) is False
    assert one(spark, moved + " 1999 and 2003", X.garbled) is False
    assert one(spark, "xx zz ww vvvv bcdf ghjk lmnp qrst", X.garbled) is True
    assert one(spark, "xx zz ww vvvv", X.garbled) is False
    blocks = lambda c: X.unreliable(c, c, F.split(c, "\n"))
    assert one(spark, plain + "\n" + moved, blocks) == X.DAMAGED
    assert one(spark, plain + " ##30", blocks) == X.SYMBOLS and one(spark, plain + "\nBox 2", blocks) == X.BOXED and one(spark, plain, blocks) == ""


def test_tags(spark):
    fixed, removed, has = knowledge.fix_tags(F.col("t"))
    texts = ["x\nTags: condition:Renal,bogus,renal,bogus  k:v\ncondition:bogus", "  tags: CONDITION:Renal,bogus", "tags: condition:bogus", "tags:\tk:v   a", "no tags"]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fixed, removed, has).collect()]
    assert got == [("x\nTags: condition:renal k:v\ncondition:bogus", ["bogus", "bogus"], True), ("tags: condition:renal", ["bogus"], True), ("tags:", ["bogus"], False), ("tags: k:v a", [], False), ("no tags", [], False)]
    free = knowledge.fix_tags(F.lit("tags: condition:A,b"), ())
    assert tuple(spark.range(1).select(*free).first()) == ("tags: condition:a,b", [], True)


def test_entry_grammar(spark):
    raw = '<<<ENTRY dest="c01" title=" A " replace="e02">>\nbody\n<<<END>\n<<<ENTRY C07" title="B" subtitle="no">\n>\nx\n<<<END>>>\n<<<ENTRY dest="C02" title="E">>>\n\n<<<END>>>\n<<<ENTRY   summary title="U04" title="U05">>>\ny\n<<<END>>>'
    units = spark.createDataFrame([(1, raw)], "unit_id long, raw string")
    out = knowledge.parse_entries_of(units).collect()
    assert [(r.dest, r.title, r.replace, r.body) for r in out] == [("C01", "A", "E02", "body"), ("C07", "B", "", "x"), ("SUMMARY", "U05", "", "y")]
    assert knowledge.parse_entries_of(units, keep_junk=True).count() == 4


def test_changes(spark):
    e = spark.createDataFrame([(1, k, "C01", f"t{k}", f"b{k}") for k in range(3)], "unit_id long, pos long, dest string, title string, body string")
    ops = [(0, "C02", "n", "E01", "old"), (1, "C03", "m", "e1: E1", "new"), (2, "DELETE", "drop E02 now", "", "-"), (3, "C04", "z", "E02", "z"), (4, "C04", "q", "E09", "q"), (5, "C09", "add", "", "a"), (6, "LOG", "note", "", "l"), (7, "DELETE", "E2 again", "", "-"), (8, "DELETE", "none", "", "-"), (9, "C04", "lost", "nothing", "-"), (10, "XX", "later", "", "c")]
    o = spark.createDataFrame([(1, *r) for r in ops], "unit_id long, pos long, dest string, title string, replace string, body string")
    out = [tuple(r)[1:] for r in knowledge.apply_changes(e, o).orderBy("place").collect()]
    assert out == [(1, "C03", "m", "new", "corrected"), (2, "C01", "t2", "b2", "kept"), (3, "C09", "add", "a", "added"), (4, "XX", "later", "c", "added")]
    many = spark.createDataFrame([(1, k, "C01", "t", "b") for k in range(10_050)], e.schema)
    places = [r.place for r in knowledge.apply_changes(many, o.where("pos = 5")).collect()]
    assert sorted(places) == list(range(1, 10_052))


def test_terms(spark):
    rows = [(1, "C05", 1, " Term ", "ab"), (1, "C05", 2, "term", "abcd"), (1, "C05", 3, "TERM", "wxyz"), (1, "C05", 10**7, "other", "z"), (1, "C06", 4, "term", "z"), (2, "C05", 5, "term", "q")]
    e = spark.createDataFrame(rows, "book_id long, code string, at long, title string, body string")
    got = sorted((r.book_id, r.code, r.at) for r in knowledge.one_of_each_term(e).collect())
    assert got == [(1, "C05", 2), (1, "C05", 10**7), (1, "C06", 4), (2, "C05", 5)]


def test_material(spark):
    """Each rendering has its turn as the room shrinks; headings count, and the library goes before anything is cut."""
    rows = [(1, 1, "T", 1, "C01", "a", "x" * 3000), (1, 1, "T", 2, "L1", "b", "y" * 4000), (1, 2, "T", 1, "ZZ", "c", "z" * 9000)]
    e = spark.createDataFrame(rows, "book_id long, unit_id long, unit_title string, place long, dest string, title string, body string")
    full = "## 1 — T\n\n[C01] a\n{}\n\n[L1] b\n{}\n\n\n\n## 2 — T\n\n".format("x" * 3000, "y" * 4000)
    less = "## 1 — T\n\n[C01] a\n{}\n\n\n\n## 2 — T\n\n"
    want = [(len(full), full), (len(full) - 1, less.format("x" * 3000)), (2600, less.format("x" * 2500 + " [...]")), (1100, less.format("x" * 1000 + " [...]")), (50, less.format("x" * 1000 + " [...]")[:50])]
    for k, (most, text) in enumerate(want):
        r = knowledge.material(e, most).first()
        assert (r.text, r.n_chars) == (text, len(text)) and r.note == [*[c[2] for c in knowledge.CUTS], knowledge.HARD_CUT][k]


def test_sections_of_all_books(spark):
    e = spark.createDataFrame([(1, "C01"), (1, "C01"), (2, "L5"), (2, "ZZ"), (None, "C02")], "book_id long, dest string")
    out = knowledge.by_section(e).collect()
    assert len(out) == 3 * len(dims.SECTIONS)
    assert {(r.book_id, r.code, r.n) for r in out if r.n} == {(1, "C01", 2), (2, "L5", 1), (2, dims.FALLBACK, 1), (None, "C02", 1)}


def test_substitution_and_pending(spark):
    t = "ZZOCRZZ" + "0" * 16 + "ZZ"
    u = "ZZOCRZZ" + "1" * 16 + "ZZ"
    texts = spark.createDataFrame([(1, f"a{t}b{u}c{t}"), (2, "plain")], "k long, text string")
    got = jobs.substitute(texts, spark.createDataFrame([(t, "X")], "token string, text string"), "k")
    assert {tuple(r) for r in got.collect()} == {(1, "aXbcX"), (2, "plain")}
    j = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, pos long")
    assert [tuple(r) for r in jobs.pending(j, spark.createDataFrame([("b",)], "key string")).collect()] == [("a", 1)]


def test_transcriber(spark):
    def call(kind, data):
        if data == b"e":
            raise ValueError("empty")
        return {b"r": ("FinishReason.RECITATION", ""), b"s": ("SPII", "x"), b"t": ("MAX_TOKENS", " cut "), b"n": ("STOP", " ")}.get(data, ("STOP", f" {kind}{data.decode()} "))

    df = spark.createDataFrame([(k, "page", k.encode()) for k in "xersnt"], "key string, kind string, data binary")
    got = {r.key: (r.status, r.text, r.reason) for r in jobs.transcribe(df, call, waits=(0, 0, 0)).collect()}
    assert got == {"x": ("ok", "pagex", ""), "e": ("failed", "", "empty"), "r": ("recitation", "", "FinishReason.RECITATION"), "s": ("blocked", "x", "SPII"), "t": ("truncated", "cut", "MAX_TOKENS"), "n": ("failed", "", "respuesta vacía (STOP)")}


def test_attempts():
    told, slept = [RuntimeError("a"), ("STOP", ""), ("STOP", "good")], []

    def call(kind, data):
        x = told.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert jobs.attempt(call, "page", b"", sleep=slept.append) == ("ok", "good", "") and slept == [3, 10]


def test_runner(spark):
    """Keys are asked once, the cache answers first, only good answers are cached, and without a model work is skipped."""
    rows = [("a", "page", b"1", 1), ("a", "page", b"1", 2), ("b", "image", b"2", 3), ("c", "image_forced", b"3", 4), ("d", "page", b"4", 5)]
    j = spark.createDataFrame(rows, "key string, kind string, data binary, pos long")
    cache = spark.createDataFrame([("b", "known")], "key string, text string")
    call = lambda kind, data: ("MAX_TOKENS", "cut") if data == b"4" else ("STOP", jobs.DECORATIVE if kind == "image_forced" else "new")
    out, fresh = jobs.run_jobs(j, cache, call)
    assert sorted((r.key, r.pos, r.status, r.text) for r in out.collect()) == [("a", 1, "ok", "new"), ("a", 2, "ok", "new"), ("b", 3, "cached", "known"), ("c", 4, "ok", "[DECORATIVE]"), ("d", 5, "truncated", "cut")]
    assert [tuple(r) for r in fresh.collect()] == [("a", "new")]
    out, fresh = jobs.run_jobs(j, cache, None)
    assert {r.status for r in out.collect()} == {"cached", "skipped"} and fresh.count() == 0


def test_second_tries(spark):
    schema = "key string, kind string, data binary, pos long, status string, text string, reason string, captioned boolean, native string, label string"
    rows = [("a", "image", b"1", 1, "ok", " [DECORATIVE] ", "", True, "", "i1"), ("b", "image", b"2", 2, "ok", "[DECORATIVE]", "", False, "", "i2"), ("c", "page", b"3", 3, "recitation", "", "why", False, "own", "p3"), ("d", "page", b"4", 4, "recitation", "", "why", False, " ", "p4"), ("e", "page", b"5", 5, "recitation", "", "why", False, "own", "p5")]
    j = spark.createDataFrame(rows, schema)
    assert [(r.first_key, r.kind, bytes(r.data)) for r in jobs.captioned_again(j).collect()] == [("a", "image_forced", b"1")]
    assert sorted(r.first_key for r in jobs.blocked_again(j).collect()) == ["c", "e"]
    again = spark.createDataFrame([("c", "ok", " | t | "), ("e", "ok", "[NO TABLES]")], "first_key string, status string, text string")
    out = {r.key: r.tables for r in jobs.rescued(j, again).collect()}
    assert out == {"a": "", "b": "", "c": "| t |", "d": "", "e": ""}
    shown = {r.key: r.t for r in jobs.rescued(j, again).select("key", jobs.rendered().alias("t")).collect()}
    assert shown["a"] == "\n\n[IMAGE MARKED DECORATIVE DESPITE CAPTION: i1]\n\n" and shown["b"] == ""
    assert "<!-- TABLES FROM IMAGE: p3 -->\n| t |\n<!-- /TABLES -->" in shown["c"] and shown["d"] == "\n\n[PAGE NOT PROCESSED: p4 — why]\n\n" and shown["e"].endswith("-->\n\nown\n\n")


def test_immediate_calls(spark):
    slept, told = [], [inference.CallError("busy", 529), TimeoutError("t"), ("x", "end")]

    def call(request):
        x = told.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert inference.persistent(call, "r", sleep=slept.append) == ("x", "end") and slept == [30, 60]
    with pytest.raises(inference.CallError):
        inference.persistent(lambda r: (_ for _ in ()).throw(inference.CallError("bad", 400)), "r")

    def answer(request):
        if "bad" in request[1]:
            raise ValueError("no")
        return request[1].upper(), "max_tokens" if "long" in request[1] else "end_turn"

    df = spark.createDataFrame([("1", ["a", "x"]), ("2", ["a", "long"]), ("3", ["a", "bad"])], "id string, request array<string>")
    assert {tuple(r) for r in inference.ask(df, answer).collect()} == {("1", "X", False, None), ("2", "LONG", True, None), ("3", None, False, "no")}


def test_change_sets_of_units(spark):
    units = spark.createDataFrame([(k, "T", "# a", "# b", f"text {k}") for k in (1, 2, 3)], "unit_id long, title string, start_line string, end string, source_text string")
    e = spark.createDataFrame([(1, 0, "C01", "t", "b"), (1, 1, "LOG", "n", "l"), (2, 0, "C01", "t", "b")], "unit_id long, pos long, dest string, title string, body string")
    done = spark.createDataFrame([(2,)], "unit_id long")
    got = inference.verify_units(units, e, done, "{unit_id} {unit_start} {unit_end}: {entries}", lambda r: (r[0] + "|" + r[1], "end")).collect()
    assert [(r.id, r.text) for r in got] == [("1", "<unit>\ntext 1\n</unit>|" + inference.UNIT_NOTE + '1 # a # b: [E01] <<<ENTRY dest="C01" title="t">>>\nb\n<<<END>>>')]


def test_batches(spark):
    class Client:
        ended = False

        def send(self, sent):
            self.sent = [j["id"] for j in sent]
            return "b1"

        def poll(self, batch):
            return self.ended

        def results(self, batch):
            return iter([("y", None, None, "invalid_request_error: x"), ("x", "t", "max_tokens", None), ("?", "t", "end", None), ("z", None, None, "overloaded")])

    client, sent = Client(), [{"id": k, "label": k.upper(), "request": 1} for k in "xyzw"]
    assert inference.batch_step(None, [], client) == ("done", None, [])
    status, state, _ = inference.batch_step(None, sent, client)
    assert status == "submitted" and client.sent == list("xyzw") and json.loads(json.dumps(state)) == state
    assert inference.batch_step(state, [], client)[0] == "waiting"
    client.ended = True
    status, state, answers = inference.batch_step(state, [], client)
    assert (status, state) == ("done", None) and answers == [("y", None, False, "invalid_request_error: x", True), ("x", "t", True, None, False), ("z", None, False, "overloaded", False)]
    j, a = spark.createDataFrame([(k,) for k in "xyzw"], "id string"), spark.createDataFrame(answers, "id string, text string, truncated boolean, error string, fatal boolean")
    assert {r.id: r.state for r in inference.collected(j, a).collect()} == {"x": "succeeded", "y": "fatal", "z": "errored", "w": "missing"}


def folder_client(folder):
    class FolderClient:
        """A provider whose state is a folder, so that all workers share it; a batch ends when it is polled the second time."""

        def __init__(self, folder):
            self.folder = str(folder)

        def _files(self, sign):
            import pathlib

            return sorted(pathlib.Path(self.folder).glob(sign))

        def send(self, key, requests):
            import pathlib

            (pathlib.Path(self.folder) / f"call-{time.time_ns()}-{random.random()}").write_text(key)
            path = pathlib.Path(self.folder) / f"sent-{key}"
            if not path.exists():
                path.write_text(json.dumps(requests))
            return f"b-{key}"

        def poll(self, batch_id):
            import pathlib

            path = pathlib.Path(self.folder) / f"polled-{batch_id}"
            if path.exists():
                return True
            path.touch()
            return False

        def results(self, batch_id):
            import pathlib

            for r in json.loads((pathlib.Path(self.folder) / f"sent-{batch_id[2:]}").read_text()):
                if (pathlib.Path(self.folder) / "broken").exists() and r["id"].endswith("7"):
                    raise OSError("the line broke")
                yield r["id"], " ".join(r["request"]), "max_tokens" if r["id"] == "r5" else "end_turn", "invalid_request_error: x" if r["id"] == "r6" else None
            yield "unknown", "x", None, None

    return FolderClient(folder)


def test_batches_in_tables(spark, tmp_path):
    """Requests go out by files and come back by transactions; what breaks off is done again, and nothing is sent or kept twice."""
    box, root = tmp_path / "provider", str(tmp_path / "stage")
    box.mkdir()
    client = folder_client(box)
    requests = spark.range(60).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.lit("L").alias("label"), F.array(F.lit("text"), F.col("id").cast("string")).alias("request"))
    inference.write_requests(requests.repartition(3), root, per_file=8)
    commit = inference.ledger.commit
    try:
        inference.ledger.commit = lambda df, *a: df.collect() and 1 / 0  # killed between sending and writing
        with pytest.raises(Exception):
            inference.submit_batches(spark, root, client)
    finally:
        inference.ledger.commit = commit
    inference.submit_batches(spark, root, client)
    inference.submit_batches(spark, root, client)
    n = len(client._files("sent-*"))
    assert n >= 9 and len(client._files("call-*")) == 2 * n  # asked again after the kill, sent once
    assert inference.batch_answers(spark, root).count() == 0
    assert inference.collect_batches(spark, root, client) == n
    (box / "broken").touch()
    with pytest.raises(Exception):
        inference.collect_batches(spark, root, client)
    assert inference.batch_answers(spark, root).count() == 0
    (box / "broken").unlink()
    assert inference.collect_batches(spark, root, client) == 0 and inference.collect_batches(spark, root, client) == 0
    got = {r.id: (r.text, r.truncated, r.fatal) for r in inference.batch_answers(spark, root).collect()}
    assert got == {f"r{k}": (f"text {k}", k == 5, k == 6) for k in range(60)} and inference.batch_answers(spark, root).count() == 60
    inference.write_requests(requests.limit(2).withColumn("id", F.concat(F.lit("new"), "id")), root)
    inference.submit_batches(spark, root, client)
    assert inference.collect_batches(spark, root, client) == len(client._files("sent-*")) - n


def test_ledger(spark, tmp_path):
    """A replayed batch adds nothing, a reader sees whole books, old or new, and two writers don't lose each other's."""
    import threading

    root, schema = str(tmp_path / "usage"), "label string, n long"
    assert ledger.read(spark, root, schema).count() == 0
    one = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    add = ledger.once(root, "usage")
    add(one, 0), add(one, 1), add(one, 1), add(one, 0)
    assert ledger.read(spark, root, schema).count() == 4 and ledger.manifest(spark, root)[0] == 2

    books, form = str(tmp_path / "books"), "book long, name string, text string"

    def book(k, version):
        return spark.createDataFrame([(k, f"f{i}", f"v{version}") for i in range(20)], form)

    ledger.commit(book(1, 0).union(book(2, 0)), books, "first")
    seen, stop, failed = set(), threading.Event(), []

    def watch():
        try:
            while not stop.is_set():
                rows = ledger.latest(ledger.read(spark, books, form), ["book"]).groupBy("book").agg(F.count("*").alias("n"), F.count_distinct("text").alias("v"), F.max("text").alias("t")).collect()
                assert sorted((r.book, r.n, r.v) for r in rows) == [(1, 20, 1), (2, 20, 1)]
                seen.add(next(r.t for r in rows if r.book == 1))
        except Exception as e:
            failed.append(e)

    reader = threading.Thread(target=watch)
    reader.start()
    for v in range(1, 6):
        ledger.commit(book(1, v), books, f"again-{v}")
    stop.set()
    reader.join()
    assert not failed and len(seen) > 1

    writers = [threading.Thread(target=lambda k=k: ledger.commit(book(k, 9), books, f"w{k}")) for k in range(10, 14)]
    [w.start() for w in writers], [w.join() for w in writers]
    held = ledger.latest(ledger.read(spark, books, form), ["book"]).groupBy("book").count().collect()
    assert sorted(map(tuple, held)) == [(k, 20) for k in (1, 2, 10, 11, 12, 13)]
    ledger.compact(spark, books, form, ["book"])
    assert ledger.read(spark, books, form).count() == 120 and ledger.commit(book(1, 7), books, "w10") == ledger.manifest(spark, books)[0]
    assert len(ledger.vacuum(spark, books, 1)) == 10 and ledger.latest(ledger.read(spark, books, form), ["book"]).count() == 120


def test_first_call_before_the_others(spark, tmp_path):
    folder = str(tmp_path)

    def call(request):
        import pathlib

        (pathlib.Path(folder) / f"{time.time_ns()}-{request[0]}").touch()
        return request[0], "end_turn"

    df = spark.createDataFrame([(f"{b}{k}", b, [f"{b}{k}"]) for b in "xy" for k in range(5)], "id string, book string, request array<string>").repartition(4)
    got = inference.ask_after_first(df, call)
    assert sorted(r.text for r in got.collect()) == sorted(f"{b}{k}" for b in "xy" for k in range(5))
    order = [p.name.split("-")[1] for p in sorted(tmp_path.iterdir())]
    assert set(order[:2]) == {"x0", "y0"} and len(order) == 10


def test_polling():
    told, slept = ["pending", "pending", "done"], []
    assert stream.poll(lambda: told.pop(0), sleep=slept.append) == 3 and slept == [180, 180]


def test_changed_spans(spark):
    s = "source string, unit_id string, a long, b long"
    old, new = spark.createDataFrame([("s", "U01", 0, 5), ("s", "U02", 5, 9)], s), spark.createDataFrame([("s", "U01", 0, 6), ("s", "U02", 5, 9), ("s", "U03", 9, 10)], s)
    assert {r.unit_id for r in segment.changed_spans(old, new).collect()} == {"U01"}


def test_units_in_whole_texts(spark):
    """A contents page is skipped, a start within a line is found, lines of the texts count, a lost unit doesn't move the search."""
    head = "# One\n\n# Three\n# Four\ni\nj\n"
    text = head + "intro\n # One \nx\n# Lost?\ny\nsee ## Two here\nz\n# Three\nw\n# Four\nv"
    books = spark.createDataFrame([("s", text), ("t", "## A\nb")], "source string, text string")
    units = spark.createDataFrame([("s", 1, "# One"), ("s", 2, "\n# Nowhere"), ("s", 3, "## Two\n\n# Sub"), ("s", 4, "# Three"), ("s", 5, "# Four"), ("t", 1, "A")], "source string, k long, start string")
    got = [tuple(r) for r in segment.locate_texts(books, units).orderBy("source", "a").collect()]
    two, three, four = text.index("see ## Two"), text.rindex("# Three"), text.rindex("# Four")
    got = [(r[0], r[2], *r[3:]) for r in got]
    assert got == [("s", "U01", 0, two, True, "# One", "see ## Two here"), ("s", "U03", two, three, False, "see ## Two here", "# Three"), ("s", "U04", three, four, False, "# Three", "# Four"), ("s", "U05", four, len(text), False, "# Four", "(end of book)"), ("t", "U01", 0, 6, False, "## A", "(end of book)")]
    plain = [tuple(r)[3:5] for r in segment.locate_texts(books.where("source = 's'"), units, skip_contents=False).orderBy("a").collect()]
    assert plain[0][1] == two and plain[1][0] == two
    kinds = spark.createDataFrame([("s", "U01", "content", 0, 399), ("s", "U02", "content", 0, 400), ("s", "U03", "front", 0, 5)], "source string, unit_id string, kind string, a long, b long")
    assert [r.unit_id for r in segment.tiny_units(kinds).collect()] == ["U01"]


def _unit_spans(text: str, starts: list[str], skip_contents: bool = True) -> list[tuple[int, int, int, bool, str, str]]:
    """(place in starts, a, b, contents skipped, first line, line after it) of the units found in a book, in order.

    Every line from behind the previous hit is searched: those that equal the start, stripped, else those that contain it.
    Of these the first that isn't beside two other starts counts, or the first of all if each is; a unit that isn't found
    leaves the search where it was. Of a start with several lines the first that isn't blank counts.
    """
    lines = text.split("\n")
    bare = [x.strip() for x in lines]
    solid = [i for i, x in enumerate(bare) if x]
    rank = {i: r for r, i in enumerate(solid)}
    known = {x.strip() for x in starts if x and x.strip()}
    equal: dict[str, list[int]] = {}
    for i in solid:
        equal.setdefault(bare[i], []).append(i)

    def contents(i, own):
        r = rank[i]
        near = solid[max(0, r - segment.TOC_NEIGHBOURS) : r] + solid[r + 1 : r + 1 + segment.TOC_NEIGHBOURS]
        return sum(bare[j] in known and bare[j] != own for j in near) >= segment.TOC_HITS

    def containing(start, at):
        for i in range(at, len(lines)):
            if start in lines[i]:
                yield i

    def found(start, at):
        same = equal.get(start, [])
        for hits in (iter(same[bisect_left(same, at) :]), containing(start, at)):
            first = next(hits, None)
            if first is None:
                continue
            if not skip_contents or not contents(first, start):
                return first, False
            later = next((i for i in hits if not contents(i, start)), None)
            return (first, False) if later is None else (later, True)
        return None, False

    got, at = [], 0
    for k, start in enumerate(starts):
        start = next((x.strip() for x in (start or "").splitlines() if x.strip()), "")
        i, skipped = found(start, at) if start else (None, False)
        if i is not None:
            got.append((k, i, skipped))
            at = i + 1
    offsets = [0, *accumulate(len(x) + 1 for x in lines)]
    heads = [0 if n == 0 else i for n, (_, i, _) in enumerate(got)]
    begins = [offsets[i] for i in heads] + [len(text)]
    after = [bare[i] for i in heads[1:]] + [segment.END_OF_BOOK]
    return [(k, begins[n], begins[n + 1], skipped, bare[heads[n]], after[n]) for n, (k, _, skipped) in enumerate(got)]


def test_units_are_brute_force(spark):
    """Books in pieces against a search of the whole text: contents pages, starts within lines, repeated and odd starts, 1,000 starts."""
    rng, pieces, units, want = random.Random(9), [], [], []
    for b in range(12):
        n = 1000 if b == 0 else rng.randrange(0, 9)
        starts = [rng.choice([f"# Ch {k}", f"# Ch {rng.randrange(5)}", f"\n  # Ch {k} \nsub", "ch", "é x", "", None]) if b else f"# Chapter {k}" for k in range(n)]
        lines = ["# Book", *[(x or "").strip() for x in starts], "", "a", "b"] if rng.random() < 0.7 else []
        for k, x in enumerate(starts):
            if rng.random() < 0.9:
                lines.append(rng.choice(["{}", "  {} ", "see {} now", "{}\t"]).format((x or "").strip().split("\n")[0]))
            lines += [rng.choice(["", " ", "text", "# Ch", "ch ch", "\x1c", "é x!"]) for _ in range(rng.randrange(0, 6))]
        cuts = sorted({0, *(rng.randrange(len(lines) + 1) for _ in range(rng.randrange(1, 6 if b else 700)))} - {len(lines)}) or [0]
        parts = ["\n".join(lines[a:c]) for a, c in zip(cuts, [*cuts[1:], len(lines)])]
        pieces += [(f"b{b}", p, x) for p, x in enumerate(parts)]
        units += [(f"b{b}", k, x) for k, x in enumerate(starts)]
        want += [(f"b{b}", *x) for x in _unit_spans("\n".join(parts), starts)]
    pieces += [("alone", 0, "# x"), ("empty", 0, None)]
    units += [("empty", 0, "# x"), ("nowhere", 0, "# x")]
    p = spark.createDataFrame(pieces, "source string, pos long, text string").repartition(7)
    u = spark.createDataFrame(units, "source string, k long, start string").repartition(3)
    got = segment.locate_pieces(p, u).drop("unit_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    whole = p.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    assert sorted(map(tuple, segment.locate_texts(whole, u).drop("unit_id").collect())) == sorted(want)
    assert segment.locate_pieces(p.limit(0), u).count() == 0 and segment.locate_pieces(p, u.limit(0)).count() == 0


def test_split_into_parts(spark):
    """Three parts: a chapter within the window wins over nearer lines and sections; where there is no heading, the nearest line."""
    line = "x" * 9 + "\n"
    text = line * 8 + "# A chap\n" + "\n" + "## Bsect\n" + "\n" + line * 20
    got = [tuple(r) for r in documents.split_parts(spark.createDataFrame([("s", text, 3), ("t", "ab", 1)], "source string, text string, parts long")).orderBy("source", "part").collect()]
    n = len(text)
    starts = [i + 1 for i, c in enumerate(text) if c == "\n"]
    second = min((p for p in starts if p > 80), key=lambda p: (abs(p - 2 * n / 3), p))
    assert got == [("s", 1, 0, 80), ("s", 2, 80, second), ("s", 3, second, n), ("t", 1, 0, 2)]
    assert documents.cuts("a\nb", 4) == [2]


def test_merged_maps(spark):
    one = {"title": "T", "thesis": "", "metadata": {"a": "", "b": 1}, "domains": ["general", "x"], "conditions": ["p"], "conditions_secondary": ["q"], "commercial_interests": " c ", "units": [{"id": "U01", "t": 1}, {"id": "U02"}], "cross_unit_items": ["U01 and U02, not U012"]}
    two = {"title": "S", "thesis": "th", "metadata": {"a": 2, "b": 3}, "domains": ["x", "y"], "conditions": ["q"], "conditions_secondary": ["p", "r"], "commercial_interests": "d", "units": [{"id": "U01"}, {"id": "U02"}, {"id": "U03"}], "cross_unit_items": ["U01, U03"]}
    rows = [(1, 2, json.dumps(two)), (1, 1, json.dumps(one)), (1, 3, json.dumps({"commercial_interests": "c"})), (2, 1, json.dumps(two))]
    got = {r.book_id: json.loads(r.map) for r in knowledge.merge_maps(spark.createDataFrame(rows, "book_id long, part long, map string")).collect()}
    assert got[2] == two
    m = got[1]
    assert (m["title"], m["thesis"], m["metadata"], m["domains"]) == ("T", "th", {"a": 2, "b": 1}, ["x", "y"])
    assert (m["conditions"], m["conditions_secondary"], m["commercial_interests"]) == (["p", "q"], ["r"], "c; d")
    assert [u["id"] for u in m["units"]] == ["U01", "U02", "U03", "U04", "U05"] and m["units"][0]["t"] == 1
    assert m["cross_unit_items"] == ["U01 and U02, not U012", "U03, U05"] and m["_map_parts"] == 3


def test_captions_keep_images(spark):
    a, b, c, e = ("ZZOCRZZ" + k * 16 + "ZZ" for k in "abce")
    far = "x " * 250
    texts = [f"{a} {far}Table 3", f"{c} Fig. 2"] + [f"{a} {b} {c}"] * 5 + [f"{b}Table {a} 9{far}", f"{e} Figure{b}1", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.token: (r.uses, r.captioned, r.dropped) for r in documents.image_tokens(df, spark.createDataFrame([(c,), (e,)], "token string")).collect()}
    assert got == {a: (7, True, False), b: (7, True, False), c: (6, True, False), e: (1, True, False)}
    bare = spark.createDataFrame([(f"{a} {far}Table 3",)] * 6 + [(e,)], "text string")
    got = {r.token: (r.uses, r.captioned, r.dropped) for r in documents.image_tokens(bare, spark.createDataFrame([(e,)], "token string")).collect()}
    assert got == {a: (6, False, True), e: (1, False, True)}


def test_markdown(spark):
    page = '<head><title>t</title></head><h2>A</h2><p>x <a href="http://a">l</a> <a href="#n">m</a> <a href="HTTP://b">n</a></p><ul><li>i</li></ul><span role="doc-pagebreak" title="12">p.</span><span epub:type="pagebreak">1 3</span><hr role="pagebreak" id="pg-14"/><span role="pagebreak"></span><img src="s.PNG" alt="Logo"><img src="x.svg">'
    out, found = html.parsed(page)
    assert "## A" in out and "[l](http://a) m n" in out and "- i" in out and "t\n" not in out[:3] and "p." not in out
    assert [x for x in out.split() if "PAGE" in x] == ["ZZPAGEZZ12ZZ", "ZZPAGEZZ13ZZ", "ZZPAGEZZ14ZZ"] and out.count("ZZOCRZZ") == 1
    assert [(a, b) for a, b, _ in found] == [("s.PNG", "Logo")]
    assert "ZZOCRZZ" + "a" * 16 + "ZZ" in html.parsed('<img src="q">', {"q": "a" * 40})[0]
    assert one(spark, "a ZZPAGEZZ12ZZ b", html.with_pages) == "a <!-- PAGE 12 --> b"
    s = spark.createDataFrame([("b", 2, "two.html", " y "), ("b", 1, "one.html", "x"), ("b", 3, "no.html", " \n")], "book string, pos int, entry string, text string")
    assert html.sections(s).first().text == "<!-- SECTION: one.html -->\n\nx\n\n<!-- SECTION: two.html -->\n\ny"


def test_epub(spark):
    buf = io.BytesIO()
    items = {"a": ("C%201.xhtml#x", "application/xhtml+xml", ""), "n": ("nav.xhtml", "application/xhtml+xml", ""), "t": ("titlepage.xhtml", "application/xhtml+xml", ""), "m": ("toc9.xhtml", "application/xhtml+xml", "nav"), "i": ("p%23.png", "image/png", ""), "c": ("x.css", "text/css", ""), "g": ("gone.xhtml", "application/xhtml+xml", "")}
    manifest = "".join(f'<item id="{k}" href="{h}" media-type="{m}" properties="{p}"/>' for k, (h, m, p) in items.items())
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", f'<package xmlns:dc="d"><metadata><dc:title> </dc:title><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:date>1999</dc:date><dc:publisher>P</dc:publisher><dc:language>en</dc:language><dc:identifier>id</dc:identifier></metadata><manifest>{manifest}</manifest><spine>{"".join(f"<itemref idref={chr(34)}{k}{chr(34)}/>" for k in [*items, "?"])}</spine></package>')
        for name, text in {"O/c 1.XHTML": "<p>hi</p>", "O/nav.xhtml": "n", "O/titlepage.xhtml": " ", "O/toc9.xhtml": "n", "O/p#.png": "PNG", "O/x.css": "c"}.items():
            z.writestr(name, text)
    df = spark.createDataFrame([("b.epub", buf.getvalue()), ("c.pdf", b"x")], "path string, content binary")
    out = epub.scan(df).orderBy("path", "pos").collect()
    assert [(r.id, r.role, r.content) for r in out[:-1]] == [("a", "section", "<p>hi</p>"), ("n", "skipped", None), ("t", "section", " "), ("m", "skipped", None), ("i", "page", None)]
    assert bytes(out[4].image) == b"PNG" and out[-1].role == "error" and out[-1].path == "c.pdf"
    assert (out[0].title, out[0].authors, out[0].date, out[0].publisher, out[0].language, out[0].identifier) == ("T", ["A", "B"], "1999", "P", "en", "id")
    n = epub.counts(epub.scan(df.where("path = 'b.epub'")).withColumn("markdown", F.col("content"))).first()
    assert (n.sections, n.skipped) == (2, 2)
    assert {r.branch for r in epub.routes(df).collect()} == {"epub", "pdf"}


def test_usage_files(spark, tmp_path):
    path = str(tmp_path / "usage")
    rows = spark.createDataFrame([("MAP", "m0", False, 5)], "label string, model string, batch boolean, input long")
    files.append_usage(rows, path)
    files.append_usage(rows, path)
    (tmp_path / "usage" / "own.json").write_text('{"label":"VERIFY U01","input":7}\n\n')
    assert sorted((r.label, r.input, r.cost) for r in files.read_usage(spark, path).collect()) == [("MAP", 5, None), ("MAP", 5, None), ("VERIFY U01", 7, None)]


def test_uploads(spark):
    rows = [("a/B.EPUB", 3, b"abc"), ("x.txt", 1, b"a"), ("x", 1, b"a"), ("b.pdf", 0, b""), ("c.pdf", 301 << 20, b"x"), ("d.pdf", 4, b"abc")]
    got = [r.rejected for r in files.uploads(spark.createDataFrame(rows, "path string, length long, content binary")).collect()]
    assert got == [None, "format", "format", "empty", "size", "broken"]


def test_settings_snapshots_rejects(spark, tmp_path):
    env = {"KEY": "general", "APP_KEY": " own ", "OTHER": "x", "APP_OTHER": " "}
    assert [files.setting(env, k, "APP_") for k in ("KEY", "OTHER", "NONE")] == ["own", "x", None]
    for value in ({"a": "é"}, {"a": 2}):
        files.snapshot(spark, value, str(tmp_path / "s.json"))
        assert json.loads((tmp_path / "s.json").read_text()) == value
    df = spark.createDataFrame([(1, None), (2, "invalido"), (3, "sin_temas"), (4, "unidad_perdida")], "id long, quarantine string")
    assert [r.id for r in files.quarantine(df, str(tmp_path / "q")).collect()] == [1]
    assert {(r.id, r.quarantine) for r in spark.read.parquet(str(tmp_path / "q")).collect()} == {(2, "invalido"), (3, "sin_temas"), (4, "unidad_perdida")}


def test_as_of(spark):
    from quire.operators.extensions import as_of

    t = lambda day, h: f"2024-01-{day:02d} {h:02d}:00:00"
    left = spark.createDataFrame([(k, "a", t(*x)) for k, x in enumerate([(1, 0), (1, 5), (2, 1), (5, 5), (5, 4)])] + [(9, "b", t(1, 1))], "id long, k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    right = spark.createDataFrame([("a", t(1, 5), 1), ("a", t(1, 5), 2), ("a", t(1, 9), 3), ("a", t(5, 5), 4), ("c", t(1, 0), 5)], "k string, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.id: r.as_of_v for r in as_of(left, right, "k", "ts", "v").collect()} == {0: None, 1: 2, 2: 3, 3: 4, 4: 3, 9: None}


def test_archives_and_generic_documents(spark):
    df = spark.createDataFrame([(1, "b.md", "two"), (1, "a.md", "one"), (2, "c.md", None)], "book_id long, name string, text string")
    got = {r.book_id: zipfile.ZipFile(io.BytesIO(bytes(r.content))) for r in files.archives(df).collect()}
    assert got[1].namelist() == ["a.md", "b.md"] and got[1].read("b.md") == b"two" and got[2].read("c.md") == b""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>')
    rows = [("a.html", b"<h1>T</h1>"), ("b.docx", buf.getvalue()), ("c.csv", b"a,b\n1,\"x|y\"\n"), ("d.txt", "é".encode()), ("e.docx", b"no"), ("f.json", b'{"a":1}')]
    out = {r.path: (r.text, r.error is None) for r in files.documents(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert out["a.html"] == ("# T\n", True) and out["b.docx"] == ("## Head\n\na b\n\n| x |  |\n| --- | --- |", True) and out["c.csv"] == ("| a | b |\n| --- | --- |\n| 1 | x\\|y |", True)
    assert out["d.txt"] == ("é", True) and out["e.docx"] == (None, False) and '"a": 1' in out["f.json"][0]


def test_decoration(spark):
    rows = [("img/COVER.jpg", "", 9000, 500, 500, 1, False), ("a.jpg", "Our Logo", 9000, 500, 500, 1, True), ("a.jpg", None, 2999, 0, 0, 1, False), ("a.jpg", None, 3000, 99, 500, 6, False), ("a.jpg", None, 12345, 99, 0, 1, False), ("a.jpg", None, 12345, 99, 100, 1, False)]
    df = spark.createDataFrame(rows, "name string, alt string, n long, w int, h int, uses long, captioned boolean")
    rule = images.rule_reason(*[F.col(c) for c in ("name", "alt", "n", "w", "h")])
    got = [tuple(r) for r in df.withColumn("rule", rule).select("rule", images.drop_reason(F.col("uses"), F.col("rule"), F.col("captioned"))).collect()]
    assert got == [(images.BY_NAME, images.BY_NAME), (images.BY_NAME, ""), ("reglas: muy pequeña (0x0px, 2,999 bytes)",) * 2, ("reglas: muy pequeña (99x500px, 3,000 bytes)", "reglas: repetida 6 veces (viñeta/separador)"), ("", ""), ("reglas: muy pequeña (99x100px, 12,345 bytes)",) * 2]


def test_scans_and_page_images(spark):
    pages = spark.createDataFrame([(k, 500, 100.0) for k in range(1, 7)] + [(9, 99, 100.0)], "page long, n_chars long, area double")
    shots = spark.createDataFrame([(1, 5, 85.0), (2, 6, 84.0)] + [(k, 7, 99.0) for k in (3, 4, 5, 6)], "page long, xref long, area double")
    assert {r.page for r in images.page_scans(pages, shots).where("scanned").collect()} == {1, 9}
    some = [(1, 1, 71.0, 200.0, False), (1, 2, 36.0, 36.0, True), (1, 3, 72.0, 100.0, False), (2, 4, 200.0, 200.0, False)] + [(k, 8, 300.0, 300.0, False) for k in (3, 4, 5, 6)]
    got = {(r.page, r.xref): (r.reason, r.listed) for r in images.page_images(spark.createDataFrame(some, "page long, xref long, w double, h double, captioned boolean"), 612.0 * 792).collect()}
    assert got[1, 1] == (images.TOO_SMALL, True) and got[1, 2] == ("", False) and got[1, 3] == (images.SMALL_AREA, True) and got[2, 4] == ("", False)
    assert got[3, 8] == ("reglas: repetida en 4 páginas (logo/fondo)", True) and not got[4, 8][1]


def test_demux_and_interrupted(spark):
    lines = spark.createDataFrame([('@@BPP {"evento":"terminado","costo":0.5}',), ("@@BPP {bad",), ("log",), (None,)], "line string")
    assert [(r.kind, r.evento) for r in stream.demux(lines).collect()] == [("event", "terminado"), ("log", None), ("log", None), ("log", None)]
    j = spark.createDataFrame([("error",), ("extrayendo",)], "estado string")
    assert [r.estado for r in stream.interrupted(j).collect()] == ["error", "interrumpido"]


def test_job_history(spark):
    """States come back from a question to their stage; events that don't count change nothing; messages hold while a job waits."""
    told = ["listo", "crear", "crear", "iniciar", "linea one ", "preguntar", "linea hidden", "aprobar", "convertido", "linea ====", "lote", "linea hidden", "preguntar", "aprobar", "listo", "cancelar", "reanudar", "iniciar", "cerrar", "reanudar", "cancelar", "eliminar"]
    want = ["", "en_fila", "en_fila", "convirtiendo", "convirtiendo", "esperando_confirmacion", "esperando_confirmacion", "convirtiendo", "extrayendo", "extrayendo", "esperando_lote", "esperando_lote", "esperando_confirmacion", "extrayendo", "terminado", "terminado", "en_fila", "convirtiendo", "interrumpido", "en_fila", "cancelado", ""]
    rows = [(n, k, x.split(" ")[0], x.partition(" ")[2]) for n in range(1, len(told) + 1) for k, x in enumerate(told[:n])]
    random.Random(2).shuffle(rows)
    got = stream.history(spark.createDataFrame(rows, "job long, event_id long, event string, line string")).orderBy("job").collect()
    assert [r.state for r in got] == want and got[-1].message == "one" and got[6].stage == "conversion" and got[-1].events == len(told)
    now = ("", "", "")
    for k, x in enumerate(told):
        now = stream.advance(*now, x.split(" ")[0], x.partition(" ")[2])
        assert now == (got[k].state, got[k].stage, got[k].message)


def test_job_flags(spark):
    rows = [("en_fila", 0), ("esperando_lote", 0), ("terminado", 0), ("terminado", 2), ("error", 0)]
    df = spark.createDataFrame(rows, "s string, p int")
    assert [tuple(r) for r in df.select(*stream.flags(F.col("s"), F.col("p")).values()).collect()] == [(True, False, False), (True, False, False), (False, False, True), (False, True, True), (False, True, True)]


def test_stream_of_job_states(spark, data, tmp_path):
    """The same states as over all events at once, though files hold them out of order; late events are only counted."""
    events = usage.job_events(spark, data)
    folder = tmp_path / "in"
    events.where("event_id % 2 = 0 and event_id < 600").coalesce(1).write.mode("append").parquet(str(folder))
    events.where("event_id % 2 = 1 and event_id < 600").coalesce(1).write.mode("append").parquet(str(folder))

    seen = {}

    def run():
        source = spark.readStream.schema(events.schema).parquet(str(folder))
        q = stream.job_states(source).writeStream.foreachBatch(lambda df, _: seen.update({r.job: tuple(r)[1:] for r in df.collect()}))
        q = q.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return dict(seen)

    first = run()
    want = {r.job: (r.state, r.stage, r.message, r.events, 0) for r in stream.history(events.where("event_id < 600")).collect()}
    assert first == want
    late = events.where("event_id = 10").collect()[0]
    spark.createDataFrame([late], events.schema).write.mode("append").parquet(str(folder))
    events.where("event_id >= 600").write.mode("append").parquet(str(folder))
    second = run()
    for r in stream.history(events).collect():
        assert second[r.job] == (r.state, r.stage, r.message, r.events + (r.job == late.job), int(r.job == late.job))


def test_long_histories(spark):
    """Jobs of any length against one event after the other; one job's events lie in several partitions."""
    rng, rows = random.Random(6), []
    for i in range(30_000):
        job = 0 if rng.random() < 0.6 else rng.randrange(1, 400)
        line = rng.choice([None, "", " --- ", "x " + str(i), "\u3000wide " + "w" * 300, "== a"])
        rows.append((job if job != 7 else None, rng.choice([i, i // 3]), rng.choice([*stream.EVENTS, "linea", "other", None]), line))
    df = spark.createDataFrame(rows, "job long, event_id long, event string, line string").repartition(6)
    want = {}
    key = lambda r: [(x is not None, x if x is not None else 0) for x in r[1:]]
    for job, event_id, event, line in sorted(rows, key=key):
        now, n, _ = want.get(job, (("", "", ""), 0, None))
        want[job] = stream.advance(*now, event, line), n + 1, event_id
    got = {r.job: ((r.state, r.stage, r.message), r.events, r.last_event) for r in stream.history(df).collect()}
    assert got == want
    parts = df.repartitionByRange(4, "job", "event_id").where("job = 0").groupBy(F.spark_partition_id()).count().count()
    assert parts > 1  # the hot job is dealt
    assert stream.history(df.limit(0)).count() == 0


@pytest.fixture
def with_timers(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stream.timers(spark)
    yield
    spark.conf.set(key, before)


def _streamed(spark, df, make, tmp_path, files, flush=None):
    """All rows that make(stream of df's rows, in shuffled chunks) gives, in batches of one file."""
    folder, rows = tmp_path / "in", df.collect()
    for k in range(files):
        spark.createDataFrame(rows[k::files], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    if flush is not None:
        spark.createDataFrame([flush], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    got = []
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = make(source).writeStream.foreachBatch(lambda out, _: got.extend(out.collect())).outputMode("update" if flush is None or len(flush) > 2 else "append")
    q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return got


def test_ordered_stream(spark, tmp_path, with_timers):
    """Events in any order within the delay end in the states of all events at once."""
    rng, start, rows = random.Random(3), datetime.datetime(2024, 1, 1), []
    for i in range(400):
        rows.append((rng.randrange(6), i, rng.choice([*stream.EVENTS, "linea"]), f"line {i}", start + datetime.timedelta(seconds=i)))
    rng.shuffle(rows)
    schema = "job long, event_id long, event string, line string, time timestamp"
    df = spark.createDataFrame(rows, schema)
    got = _streamed(spark, df, lambda s: stream.ordered_states(s, "1 hour"), tmp_path, 3, (99, 10**6, "linea", "flush", start + datetime.timedelta(days=2)))
    last = {}
    for r in got:
        last[r.job] = tuple(r)[1:] if r.n_events >= last.get(r.job, (0, 0, 0, 0))[3] else last[r.job]
    want = {r.job: (r.state, r.stage, r.message, r.events) for r in stream.history(df).collect()}
    assert {j: v for j, v in last.items() if j != 99} == want


def test_sessions_end_by_timers(spark, tmp_path, with_timers):
    rng, start, rows = random.Random(5), datetime.datetime(2024, 1, 1), []
    for k in range(5):
        t = start
        for _ in range(40):
            t += datetime.timedelta(minutes=rng.choice([1, 20, 54, 55, 56, 300]))
            rows.append((k, t))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, time timestamp")
    got = _streamed(spark, df, lambda s: stream.ended_sessions(s, 3300, "60 days"), tmp_path, 3, (99, start + datetime.timedelta(days=90)))
    want = []
    for key, t in sorted(rows):
        if want and want[-1][0] == key and t - want[-1][2] < datetime.timedelta(minutes=55):
            want[-1] = (key, want[-1][1], t, want[-1][3] + 1)
        else:
            want.append((key, t, t, 1))
    assert sorted(tuple(r) for r in got if r.key != 99) == want


def test_polled_by_timers(spark, tmp_path, with_timers):
    """A thing that stays pending twice is asked three times; one that is done at once, once."""
    folder, marks = tmp_path / "in", tmp_path / "asked"
    marks.mkdir()
    spark.createDataFrame([("slow",), ("quick",)], "key string").write.parquet(str(folder))

    def ask(key):
        n = len(list(marks.glob(f"{key}-*")))
        (marks / f"{key}-{n}").touch()
        return "pending" if key == "slow" and n < 2 else "ended"

    got = []
    q = stream.polled(spark.readStream.schema("key string").parquet(str(folder)), ask, seconds=0.2)
    q = q.writeStream.foreachBatch(lambda out, _: got.extend(out.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    for _ in range(200):
        if sum(r.status == "ended" for r in got) == 2:
            break
        time.sleep(0.5)
    q.stop()
    assert sorted((r.key, r.status, r.calls) for r in got) == [("quick", "ended", 1), ("slow", "ended", 3), ("slow", "pending", 1), ("slow", "pending", 2)]


def test_assembled_book(spark):
    """One small book from raw answers to its files, index and report."""
    raw = '<<<ENTRY dest="C05" title="Beta">>>\nshort\n<<<END>>>\n<<<ENTRY dest="C05" title="alpha">>>\ntags: condition:Renal,zz\nmore 12 and 99\n<<<END>>>\n<<<ENTRY dest="C05" title="beta ">>>\nlonger text\n<<<END>>>\n<<<ENTRY dest="QQ" title="lost">>>\nx\n<<<END>>>\n<<<ENTRY dest="L2" title="Plan">>>\ny\n<<<END>>>\n<<<ENTRY dest="C18" title="old">>>\nz\n<<<END>>>'
    e = knowledge.parse_entries_of(spark.createDataFrame([(3, raw)], "unit_id long, raw string"))
    ops = knowledge.parse_entries_of(spark.createDataFrame([(3, '<<<ENTRY dest="C01" title="New">>>\nfirst\n<<<END>>>\n<<<ENTRY dest="DELETE" title="E99">>>\n-\n<<<END>>>')], "unit_id long, raw string"))
    e = knowledge.apply_changes(e, ops).withColumn("book_id", F.lit(7).cast("long"))
    c = assembly.checked(e, spark.createDataFrame([(3, ["12"])], "unit_id long, numbers array<string>"), ("renal",))
    synth = spark.createDataFrame([(7, 0, "C01", "One", "s1"), (7, 1, "C01", "Two", "s2"), (7, 2, "C10", "End", "s3"), (7, 3, "XX", "no", "s4")], "book_id long, pos long, dest string, title string, body string")
    one_map = dict(book_id=7, slug="b", abbreviation="a-b c1", title="T", subtitle=None, authors=["A", "B"], edition="", year="c. 1999", publisher="", language="es", domains=["x"], conditions=["renal"], conditions_secondary=[], authority_level="B", authority_rationale="r", author_credentials=[], commercial_interests="", source_file="b.md", kb_version="1", extracted="2024-01-01", model="m")
    schema = ", ".join(f"{k} {'long' if k == 'book_id' else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in one_map.items())
    wanted = spark.createDataFrame([(7, 3), (7, 4)], "book_id long, unit_id long")
    maps = assembly.described(spark.createDataFrame([one_map], schema), wanted, wanted.where("unit_id = 3"))
    placed = assembly.in_sections(c, synth)
    done = assembly.with_ids(placed, maps.select("book_id", "abbr"))
    text = {r.kind: (r.name, r.text) for r in assembly.files(done, maps).collect()}
    name, core = text["CORE"]
    assert name == "b_core.md" and core.startswith('---\ntitle: "T"\nsubtitle: ""\nauthors: ["A", "B"]\n') and 'coverage: "partial: U03"\n---\n\n# KB CORE — A, B — T (c. 1999)\n\nCompanion file: `b_biblioteca.md`' in core
    assert "> PARTIAL KB — only these units were extracted: U03.\n\n## C01 Overview & Scope\n\n### [ABC1-C01-001] Two\n\ns2\n\n### [ABC1-C01-002] One\n\ns1\n\n### [ABC1-C01-003] New\n\nfirst\n\n## C02" in core
    assert "### [ABC1-C05-001] alpha\n\ntags: condition:renal\nmore 12 and 99\n\n### [ABC1-C05-002] beta\n\nlonger text\n\n## C06" in core
    assert "### [ABC1-C10-001] lost\n\nx\n\n### [ABC1-C10-002] End" in core
    assert core.endswith("## C18 Library Index\n\n### [ABC1-C18-001] Contents of the library file\n\n**L2 Workouts & Protocols**\n- ABC1-L2-001 — Plan\n")
    assert text["LIBRARY"][1].endswith("## L5 Worksheets, Questionnaires & Templates\n\nNo content in this section.\n")
    record = json.loads(assembly.index_records(maps).first().record)
    assert record["ano"] == 1999 and record["autor"] == "A, B" and list(record) == ["archivo", "biblioteca", "titulo", "autor", "ano", "nivel", "dominios", "temas", "temas_secundarios", "nota"]
    units = spark.createDataFrame([(7, 3, False, True)], "book_id long, unit_id long, verified boolean, truncated boolean")
    told = assembly.warnings(c, units, knowledge.coverage(placed), maps.select("book_id"))
    lines = [r.line for r in told.orderBy("a", "b", "c").collect()]
    assert lines[0].startswith("TEMAS: solo 0 de 2 entradas útiles") and lines[1:] == ["U03: sin VERIFY", "U03: la extracción se cortó por longitud (revisar; dividir la unidad)", "U03 · alpha: etiqueta condition: desconocida (zz); se quitó", "U03 · alpha: números que no aparecen en el capítulo: 99", "U03: entrada con sección desconocida 'QQ' → C10: lost"]
    s = assembly.stats(c, spark.createDataFrame([(7, 1)], "book_id long, n long")).first()
    assert (s.entries, s.corrected, s.added, s.deleted, s.bad_dest) == (7, 0, 1, 1, 1)


def test_warnings_and_logs_of_a_book(spark):
    """A clinical map without topics, the map's own lines, numbers that a book lacks, deletions out of range, logs of all stages."""
    lists = "domains array<string>, conditions array<string>, conditions_secondary array<string>, clinical_scope boolean, topic_warnings array<string>, unit_warnings array<string>"
    maps = spark.createDataFrame([(1, ["nutrition"], [], [], False, ["t"], ["MAP: u", "MAP: v"]), (2, ["nutrition"], [], ["sop"], None, None, None), (3, None, None, None, True, None, []), (4, ["sport"], [], [], False, [], [])], "book_id long, " + lists)
    told = [(r.book_id, r.line) for r in assembly.map_warnings(maps).orderBy("book_id", "a", "b", "c").collect()]
    lost = "TEMAS: El MAP no declaró ningún tema principal para un libro clínico (dominio: %s). Sin temas, el sistema de nutrición nunca usaría este libro."
    assert told == [(1, lost % "nutrition"), (1, "t"), (1, "MAP: u"), (1, "MAP: v"), (3, lost % "?")]
    synth = spark.createDataFrame([(1, 0, "C09", "A", "1,5 and 12 and 99 and 7\ntags: 55"), (1, 1, "ZZ", "B", "88"), (1, 2, "LOG", "L", "77"), (2, 0, "C01", "C", "12")], "book_id long, pos long, dest string, title string, body string")
    numbers = spark.createDataFrame([(1, ["1.5"]), (1, ["12", "3"]), (2, [])], "book_id long, numbers array<string>")
    got = sorted((r.book_id, r.line) for r in assembly.synthesis_warnings(synth, numbers).collect())
    assert got == [(1, "SYNTHESIS · A: números que no aparecen en el libro: 99"), (2, "SYNTHESIS · C: números que no aparecen en el libro: 12")]
    ops = spark.createDataFrame([(3, 0, "DELETE", "E99", ""), (3, 1, "DELETE", "drop E99 and E1", ""), (3, 2, "DELETE", "none", ""), (3, 3, "LOG", "n", "late"), (4, 0, "DELETE", "x", "")], "unit_id long, pos long, dest string, title string, body string")
    assert [tuple(r) for r in assembly.deletions(ops).collect()] == [(3, 1)]
    first = spark.createDataFrame([(3, 9, "LOG", "m", "early"), (3, 1, "C01", "e", "x")], ops.schema)
    logs = assembly.logged(first).unionByName(assembly.logged(ops, 1)).drop("unit_id").unionByName(assembly.synthesis_log(synth).drop("book_id"))
    assert [(r.unit, r.title, r.body) for r in logs.orderBy("b", "c").collect()] == [("U03", "m", "early"), ("U03", "n", "late"), ("SYNTHESIS", "L", "77")]
    some = spark.createDataFrame([(1, None, "x y", "T t", ["A B"]), (2, "", "x", None, []), (3, "Own Slug", "x", "T", ["A"])], "book_id long, slug string, abbreviation string, title string, authors array<string>")
    unit = spark.createDataFrame([(1, 3)], "book_id long, unit_id long")
    assert sorted((r.book_id, r.slug) for r in assembly.described(some, unit, unit).collect()) == [(1, "a-b-t-t"), (2, "autor"), (3, "own-slug")]


def test_estimates(spark):
    rows = [("s", 100_000, 1000, 2, 50_000, False), ("t", 100_000, 1000, 2, 50_000, True), ("big", 1_300_000, 1000, 3, 600_000, False)]
    b = spark.createDataFrame(rows, "book string, tokens long, map_tokens long, units long, unit_tokens long, alive boolean")
    now = {r.book: r for r in usage.estimates(b, False).collect()}
    assert (now["s"].map_cost, now["s"].cache_cost, now["t"].cache_cost, now["big"].cache_cost) == (0.49, 0.4, 0.0, 0.0) and now["big"].parts == 3
    assert now["s"].extract_cost == pytest.approx((2 * 100_000 * 0.2 + (0.6 * 50_000 + 6000) * 10) / 1e6)
    assert now["big"].extract_cost == pytest.approx(((600_000 + 3 * 4500) * 2 + (360_000 + 9000) * 10) / 1e6) and now["big"].synthesis_cost == pytest.approx(((700_000 + 21_000) * 2 + 200_000) / 1e6)
    lot = {r.book: r for r in usage.estimates(b, True).collect()}
    assert lot["s"].map_cost == pytest.approx(0.145) and lot["s"].synthesis_cost == pytest.approx(0.2) and lot["s"].cache_cost == 0


def test_conversion_reports(spark):
    """One book with problems and discarded images, one without either."""
    from quire.operators import conversion

    books = spark.createDataFrame([("a", "a.epub", "out/a.md", "EPUB", "gemini-3.8-flash", "2024-01-01 10:00", 12.4, 1234567, 1_000_000, 2000), ("b", "b.pdf", "b.md", "PDF", "x", "d", 0.0, 5, 0, 0)], "book string, source string, out string, kind string, model string, date string, seconds double, chars long, tokens_in long, tokens_out long")
    counted = spark.createDataFrame([(b, k, i, i * (b == "a")) for b in "ab" for i, k in enumerate(usage.COUNTERS)], "book string, key string, ord int, n long")
    lines = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one")], "book string, pos long, line string")
    bad = spark.createDataFrame([("a", 1, "p. 2", "failed"), ("a", 0, "p. 1", "blocked")], "book string, pos long, place string, reason string")
    gone = spark.createDataFrame([("a", 0, "img", "IA: decorativa")], bad.schema)
    got = {r.book: (r.name, r.text) for r in conversion.reports(books, counted, lines, bad, gone).collect()}
    name, text = got["a"]
    assert name == "out/a.conversion_report.txt" and got["b"][0] == "b.conversion_report.txt"
    assert text.startswith("REPORTE DE CONVERSIÓN\n" + "=" * 60 + "\nFuente          : a.epub\nSalida          : out/a.md\nTipo            : EPUB\nModelo imágenes : gemini-3.8-flash\nFecha           : 2024-01-01 10:00\nDuración        : 12 s\nCaracteres      : 1,234,567\n\none\ntwo\n\nTRANSCRIPCIONES CON GEMINI\n" + "-" * 60 + "\nImágenes/páginas enviadas                   : 0\n")
    assert text.endswith("Imágenes decorativas descartadas (reglas)   : 11\nTokens (entrada / salida)                   : 1,000,000 / 2,000\nCosto real aproximado                       : $0.758 USD\n\nPROBLEMAS (2) — revisar\n" + "-" * 60 + "\n  - p. 1: blocked\n  - p. 2: failed\n\nPara reintentar solo lo que falló, vuelve a correr la misma\nconversión: lo que ya salió bien se toma de la caché.\n\nIMÁGENES DESCARTADAS COMO DECORATIVAS (1) — para auditoría\n" + "-" * 60 + "\n  - img: IA: decorativa\n")
    assert got["b"][1].endswith("$0.000 USD\n\nSin problemas: todo el contenido quedó transcrito.\n") and "\n\n\nTRANSCRIPCIONES" in got["b"][1]


def test_image_headers(spark):
    """Each kind's header, a JPEG with long and odd segments before its frame, cut and broken files."""
    from quire.sources import pictures

    le, be = (lambda x, n: x.to_bytes(n, "little")), (lambda x, n: x.to_bytes(n, "big"))
    png = b"\x89PNG\r\n\x1a\n" + be(13, 4) + b"IHDR" + be(300, 4) + be(70_000, 4)
    gif = b"GIF89a" + le(640, 2) + le(480, 2)
    seg = lambda m, body: b"\xff" + bytes([m]) + be(len(body) + 2, 2) + body
    frame = lambda m: seg(m, b"\x08" + be(480, 2) + be(641, 2) + b"\x03" * 10)
    thumb = b"\xff\xd8" + frame(0xC0)
    jpegs = [b"\xff\xd8" + x for x in (frame(0xC0), seg(0xE1, thumb) + b"\xff\xff" + frame(0xC2), seg(0xC4, b"xx") + b"\xff\x01" + seg(0xDB, b"\xff" * 300) + b"zz" + frame(0xC1))]
    vp8 = b"RIFF" + le(30, 4) + b"WEBPVP8 " + le(10, 4) + b"abc\x9d\x01\x2a" + le(0x4000 | 99, 2) + le(77, 2)
    vp8l = b"RIFF" + le(30, 4) + b"WEBPVP8L" + le(10, 4) + b"\x2f" + le(98 | 76 << 14 | 1 << 28, 4) + b"12345"
    vp8x = b"RIFF" + le(30, 4) + b"WEBPVP8X" + le(10, 4) + bytes(4) + le(98, 3) + le(76, 3)
    want = [(png, (300, 70_000, "PNG")), (gif, (640, 480, "GIF")), *[(j, (641, 480, "JPEG")) for j in jpegs], *[(w, (99, 77, "WEBP")) for w in (vp8, vp8l, vp8x)]]
    none = (0, 0, None)
    want += [(None, none), (b"", none), (b"text", none), (png[:20], none), (gif[:9], none), (jpegs[1][:37], none), (b"\xff\xd8" + seg(0xDA, b"x") + frame(0xC0), none), (vp8[:20], none), (b"\xff\xd8\xff", none)]
    df = spark.createDataFrame([(k, None if d is None else bytearray(d), "t") for k, (d, _) in enumerate(want)], "k long, content binary, type string")
    got = {r.k: (r.width, r.height, r.type, r.n_bytes) for r in pictures.with_headers(df).collect()}
    assert got == {k: (*f, len(d or b"")) for k, (d, f) in enumerate(want)}
    assert pictures.with_headers(df.limit(0)).count() == 0


def test_epub_source(spark, tmp_path, monkeypatch):
    """The rows of a scan over whole files; runs of the spine; pruned columns and filtered paths read less."""
    import builtins

    for b, n in (("a", 40), ("b", 3)):
        with zipfile.ZipFile(tmp_path / f"{b}.epub", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("META-INF/container.xml", "<c><rootfile full-path='o/p.opf'/></c>")
            items = "".join(f"<item id='i{k}' href='s{k}.xhtml' media-type='application/xhtml+xml'/>" for k in range(n)) + "<item id='p' href='p.png' media-type='image/png'/><item id='n' href='nav.xhtml' media-type='application/xhtml+xml' properties='nav'/>"
            z.writestr("o/p.opf", f"<package><metadata><title>T{b}</title><creator>A</creator></metadata><manifest>{items}</manifest><spine>{''.join(f'<itemref idref={chr(39)}i{k}{chr(39)}/>' for k in range(n))}<itemref idref='p'/><itemref idref='n'/></spine></package>")
            for k in range(n):
                z.writestr(f"o/s{k}.xhtml", f"<p>{k}</p>" + random.Random(k).randbytes(3000).hex())
            z.writestr("o/p.png", random.Random(1).randbytes(50_000))
            z.writestr("o/nav.xhtml", "<p>nav</p>")
    (tmp_path / "c.epub").write_bytes(b"no archive")
    epub.register(spark)
    files_ = spark.read.format("binaryFile").load(str(tmp_path / "*.epub"))
    bare = lambda df: sorted(tuple("" if v is None else str(v).replace("file:", "") for v in r) for r in df.collect())
    whole = spark.read.format("epub").option("runBytes", 20_000).load(str(tmp_path))
    assert whole.rdd.getNumPartitions() > 3
    assert bare(whole) == bare(epub.scan(files_)) and whole.count() == 42 + 5 + 1
    few = spark.read.format("epub").schema("entry string, pos int").load(str(tmp_path / "a.epub"))
    assert few.count() == 42 and few.columns == ["entry", "pos"]

    read = [0]
    plain = builtins.open

    class Counted(io.FileIO):
        def read(self, n=-1):
            data = super().read(n)
            read[0] += len(data)
            return data

    monkeypatch.setattr(builtins, "open", lambda path, mode="r", *a, **k: Counted(path) if str(path).endswith(".epub") else plain(path, mode, *a, **k))

    def cost(columns, part=None):
        from pyspark.sql.types import StringType, StructField, StructType

        reader = epub.EpubReader(StructType([StructField(c, StringType()) for c in columns]), {"path": str(tmp_path / "a.epub"), "runbytes": "40000"})
        read[0], n = 0, 0
        for p in reader.partitions() if part is None else reader.partitions()[part : part + 1]:
            n += len(list(reader.read(p)))
        return n, read[0] / len(reader.partitions() if part is None else [1])

    names, texts, images, first = cost(["path", "pos"]), cost(["path", "content"]), cost(["image"]), cost(["content"], 0)
    size = (tmp_path / "a.epub").stat().st_size
    assert names[0] == texts[0] == images[0] == 42 and first[0] < 42
    assert names[1] < 0.1 * size < texts[1] and names[1] < images[1] and first[1] < size / 2
    with pytest.raises(Exception):
        spark.read.format("epub").schema("nothing string").load(str(tmp_path)).collect()

    reader = epub.EpubReader(whole.schema, {"path": str(tmp_path)})
    rest = list(reader.pushFilters([epub.EqualTo(("path",), str(tmp_path / "b.epub")), epub.EqualTo(("pos",), 1)]))
    assert reader.paths == [str(tmp_path / "b.epub")] and len(rest) == 1
    assert spark.read.format("epub").load(str(tmp_path)).where(F.col("path") == str(tmp_path / "b.epub")).count() == 5


def test_cache_behind_its_filter(spark):
    """No key of the cache is missed, few others pass, merged filters hold both, null keys are nowhere, and only what may be there is shuffled."""
    from quire.operators import bloom

    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id")
    cache = keys.where("id < 1000").withColumn("answer", F.col("id") * 2).drop("id")
    assert bloom.bits_for(0) == 1 << 16 and bloom.bits_for(10**6) == 1 << 24 and bloom.bits_for(10**12) == bloom.MOST_BITS
    bits = bloom.bits_for(1000)
    one, two = bloom.words(cache.where("answer < 900"), bits), bloom.words(cache.where("answer >= 900"), bits)
    whole = bloom.merged(one, two)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, bloom.words(cache, bits).collect()))
    jobs = keys.unionByName(keys.limit(3)).unionByName(spark.createDataFrame([(None, 1)], "key string, id long")).withColumn("maybe", F.lit("own"))
    seen = bloom.marked(jobs, whole, bits, name="__m")
    assert seen.where("id < 1000 and key is not null and not __m").count() == 0 and seen.where("key is null and __m").count() == 0
    assert seen.where("id >= 1000 and __m").count() < 100 and seen.columns == [*jobs.columns, "__m"]
    got = bloom.looked_up(jobs, cache, whole, bits)
    assert sorted((r.id, r.answer) for r in got.where("key is not null").collect()) == sorted([(i, 2 * i if i < 1000 else None) for i in range(3000)] + [(i, 2 * i) for i in range(3)])
    assert got.count() == 3004 and bloom.looked_up(jobs, cache.limit(0), bloom.words(cache.limit(0), bits), bits).where("answer is null").count() == 3004


def test_rebuild_of_what_changed(spark, tmp_path):
    """One changed unit: its answers, its book's synthesis and files are made again; other files aren't touched."""
    from quire.operators import rebuild

    def units(text):
        return spark.createDataFrame([(b, u, text if (b, u) == (1, 11) else f"t{u}") for b in (1, 2) for u in (10 * b, 10 * b + 1, 10 * b + 2)] , "book_id long, unit_id long, text string")

    versions = {"extract": "p", "verify": "p", "synthesis": "p"}
    nodes, edges = rebuild.book_nodes(units("old"), versions)
    none = nodes.limit(0)
    first = rebuild.stale(nodes, edges, none)
    assert first.count() == nodes.count() == 2 * (3 * 2 + 2)
    stored = rebuild.remember(nodes, first, none).cache()
    assert rebuild.stale(nodes, edges, stored).count() == 0
    path = str(tmp_path / "made")
    rebuild.write_changed(first.withColumn("made", F.lit("once")), path, ("book_id", "node"))
    new, edges = rebuild.book_nodes(units("new"), versions)
    again = rebuild.stale(new, edges, stored)
    assert {tuple(r) for r in again.collect()} == {(1, "extract/11"), (1, "verify/11"), (1, "synthesis"), (1, "files")}
    times = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before = times()
    rebuild.write_changed(again.withColumn("made", F.lit("twice")), path, ("book_id", "node"))
    kept = {p for p, t in times().items() if before.get(p) == t}
    assert len(kept) == 12 and not any("U11" in p for p in kept) and spark.read.parquet(path).where("made = 'twice'").count() == 4
    stored = rebuild.remember(new, again, stored)
    assert rebuild.stale(new, edges, stored).count() == 0 and stored.count() == 16
    other, edges = rebuild.book_nodes(units("new"), versions | {"verify": "q"})
    assert {r.node for r in rebuild.stale(other, edges, stored).where("book_id = 2").collect()} == {"verify/20", "verify/21", "verify/22", "synthesis", "files"}
    chain = spark.createDataFrame([(1, str(k), "x") for k in range(6)], "book_id long, node string, own string")
    ring = spark.createDataFrame([(1, str(k), str((k + 1) % 6)) for k in range(6)], "book_id long, node string, needs string")
    assert rebuild.stale(chain, ring, chain.where("node <> '3'")).count() == 6


def test_boxes_by_a_sweep(spark):
    """The greatest share of each block in a table against all pairs: many boxes, empty and equal ones, and 1,000 blocks beside 100 tables."""
    from quire.operators import boxes

    def plain(held):
        side = lambda a, b, k: max(0, min(a[k + 2], b[k + 2]) - max(a[k], b[k]))
        return {k: max([side(b[1:], t[1:], 0) * side(b[1:], t[1:], 1) / max(1, (b[3] - b[1]) * (b[4] - b[2])) for t in held if t[0] and min(b[3] - b[1], b[4] - b[2], t[3] - t[1], t[4] - t[2]) > 0], default=0) for k, b in enumerate(held) if not b[0]}

    rng = random.Random(3)

    def box(size):
        x, y = rng.randrange(0, 600), rng.randrange(0, 800)
        return x, y, x + rng.randrange(-1, size), y + rng.randrange(-1, size)

    for n in (1, 2, 5, 30, 200):
        for _ in range(20):
            held = [(rng.random() < 0.3, *box(rng.choice([3, 60, 400]))) for _ in range(n)]
            assert boxes.swept(held) == pytest.approx(plain(held))
    many = [(k < 100, *box(40)) for k in range(1100)]
    met, beside = [0], boxes._Open.beside

    def counted(self, *a):
        for x in beside(self, *a):
            met[0] += 1
            yield x

    boxes._Open.beside = counted
    try:
        assert boxes.swept(many) == pytest.approx(plain(many))
    finally:
        boxes._Open.beside = beside
    assert met[0] < 5_000  # of 100,000 pairs
    blocks = spark.createDataFrame([(p, k, *b[1:]) for p in (1, 2) for k, b in enumerate(many) if not b[0]] + [(3, 0, 0, 0, 9, 9)], "page long, block long, x0 int, y0 int, x1 int, y1 int")
    tables = spark.createDataFrame([(p, *b[1:]) for p in (1, 2, 4) for b in many if b[0]], "page long, x0 int, y0 int, x1 int, y1 int")
    got = {(r.page, r.block): r.share for r in boxes.in_tables(blocks.repartition(5), tables).collect()}
    assert got == pytest.approx({(p, k): s for p in (1, 2) for k, s in plain(many).items()} | {(3, 0): 0.0})


def test_boxes_leave_in_batches(spark):
    """Many small pages leave a task together, not a batch each; a box without a side shares nothing."""
    import pyarrow as pa

    from quire.operators import boxes

    n = 3000
    blocks = spark.range(n, numPartitions=1).selectExpr("id as page", "'b' as block", "if(id = 5, null, 0.0d) as x0", "0.0d as y0", "10.0d as x1", "10.0d as y1")
    tables = spark.range(n, numPartitions=1).where("id % 2 = 0").selectExpr("id as page", "0.0d as x0", "0.0d as y0", "4.0d as x1", "if(id = 8, null, 10.0d) as y1")
    assert {r.page: r.share for r in boxes.in_tables(blocks, tables).collect()} == {k: 0.4 if k % 2 == 0 and k != 8 else 0.0 for k in range(n)}
    pages = 3 * boxes.ROWS
    columns = {"page": range(pages), "is_table": [False] * pages, "block": range(pages), **{c: [float(c[1])] * pages for c in ("x0", "y0", "x1", "y1")}}
    out = list(boxes._shares(pa.RecordBatch.from_pydict({c: list(v)[k : k + 1000] for c, v in columns.items()}) for k in range(0, pages, 1000)))
    assert len(out) <= 4 and [x for batch in out for x in batch.column(0).to_pylist()] == list(range(pages))


def test_distinct_pairs_hold_no_sketch(spark, tmp_path):
    """approx_distinct hands on pairs, not a sketch of 3 kB for each."""
    from quire.operators import extensions

    spark.range(4000).selectExpr("id as event_id", "if(id % 7 = 0, null, id % 7) as user_id", "if(id % 5 = 0, null, 'e' || id % 3) as event_type").write.parquet(f"{tmp_path}/events.parquet")
    out = extensions.approx_distinct(spark, str(tmp_path))
    assert {(r.event_type, r.users, r.near) for r in out.collect()} == {(x, 6, True) for x in (None, "e0", "e1", "e2")}
    grouped = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate(keys=[event_type" in x and "user_id" in x.split("functions")[0]]
    assert grouped and not any("approx_count_distinct" in x for x in grouped)


def test_pages_from_spans(spark):
    """Lines, cut words, covered blocks and tables of pages; spans are shuffled by page once, tables once."""
    box = lambda y: (0.0, y, 50.0, y + 10.0)
    some = [
        (1, 1, 1, 5.0, *box(12.0)[1:], 5.0, False, "text"), (1, 1, 1, *box(12.0), 5.0, False, "ple "), (1, 1, 0, *box(0.0), 5.0, False, " exam-"),
        (1, 2, 0, *box(100.0), 5.0, False, "in the table"), (1, 3, 0, *box(200.0), 9.0, True, "after"), (3, 1, 0, *box(0.0), 5.0, False, "  "), (4, 1, 0, *box(0.0), 5.0, False, "alone"),
    ]
    spans = spark.createDataFrame(some, "page long, block int, line int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, text string")
    tables = spark.createDataFrame([(1, 0.0, 90.0, 60.0, 130.0, "|t|"), (2, 0.0, 0.0, 1.0, 1.0, "|u|"), (4, 0.0, 50.0, 1.0, 60.0, "|v|")], "page long, x0 double, y0 double, x1 double, y1 double, text string")
    out = images.page_texts(spans.repartition(3), tables, F.lit(5.0))
    assert {r.page: r.text for r in out.collect()} == {1: "example text\n\n|t|\n\n# after", 2: "|u|", 4: "alone\n\n|v|"}
    plan = images.page_texts(spans, tables, F.lit(5.0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 2


def test_an_image_on_every_page_is_many_tasks(spark):
    """Rows of one image meet their counts in many partitions; images on few pages and rows without one stay as they are."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = spark.range(4000).selectExpr("id as page", "1L as xref").unionByName(spark.createDataFrame([(7, 2), (9, 2), (9, 2), (5, 0), (6, None)], "page long, xref long"))
        out = images.with_image_pages(rows).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    one = [r for r in out if r.xref == 1]
    assert len(out) == 4005 and {(r.pages, r.first_page) for r in one} == {(4000, 0)}
    assert len({r.task for r in one}) == 4 and max(Counter(r.task for r in one).values()) < 2000
    assert sorted((r.page, r.xref or 0, r.pages, r.first_page) for r in out if r.xref != 1) == [(5, 0, None, None), (6, 0, None, None), (7, 2, 2, 7), (9, 2, 2, 7), (9, 2, 2, 7)]


def test_search_leaves_in_small_batches():
    """Pieces that reach a worker in one batch leave it in many small ones, with the rows that they give one by one."""
    import pyarrow as pa

    starts = [{"k": k, "start": f"# Chapter {k}"} for k in range(1, 4)]
    rows = [("s", 0, 0, None, None, starts)] + [("s", 0, 1, k, f"# Chapter {k % 5}\nbody {k}\n# Chapter 1", None) for k in range(1, 3001)]
    kind = pa.schema([("source", pa.string()), ("chunk", pa.int64()), ("kind", pa.int32()), ("pos", pa.int64()), ("text", pa.string()), ("starts", pa.list_(pa.struct([("k", pa.int64()), ("start", pa.string())])))])
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kind)], schema=kind)
    whole, single = list(segment._search([batch(rows)])), list(segment._search(batch([r]) for r in rows))
    every = lambda found: sorted(str(r) for b in found for r in b.to_pylist())
    assert every(whole) == every(single) and sum(b.num_rows for b in whole) > 9000
    assert len(whole) > 3 and max(b.num_rows for b in whole) < 2 * segment.MANY


def test_changed_units_are_located_once(spark, data):
    """What changed is told from stored spans: units aren't sought for each side of the comparison."""
    from quire.operators import books

    assert "MapInArrow" not in books.span_invalidate(spark, data)._jdf.queryExecution().executedPlan().toString()


def test_redone_files_locate_once_and_merge(spark, data, monkeypatch):
    """Units are located once for all stored answers; tables that grow with the input are merged, not sent through the driver."""
    from quire.operators import books

    calls, locate = [], books.locate_pieces
    monkeypatch.setattr(books, "locate_pieces", lambda *a: calls.append(a) or locate(*a))
    books.redone_files(spark, data)
    assert len(calls) == 1
    spans = spark.createDataFrame([("s", "U01", 0, 5), ("s", "U02", 5, 9)], "source string, unit_id string, a long, b long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    moved = segment.changed_spans(spans, spans)
    assert "BroadcastHashJoin" not in plan(moved) and "SortMergeJoin" in plan(moved)
    located = plan(segment.locate_pieces(*segment.chapter_pieces(books.table(spark, data, "book_docs"))))
    assert located.count("BroadcastHashJoin") <= 1  # with a row for each book


def test_slides(spark):
    """Slides in the order of the show, with titles, tables, line breaks and notes; numbers and dates of the page are left out."""
    p = lambda *runs: "<a:p>" + "".join("<a:br/>" if r is None else f"<a:r><a:t>{r}</a:t></a:r>" for r in runs) + "</a:p>"
    sp = lambda body, kind="": f"<p:sp><p:nvSpPr><p:nvPr>{f'<p:ph type={chr(34)}{kind}{chr(34)}/>' if kind else ''}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>"
    slide = lambda *shapes: "<p:sld xmlns:p='P' xmlns:a='A'><p:cSld><p:spTree>" + "".join(shapes) + "</p:spTree></p:cSld></p:sld>"
    table = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody>" + p("h|1") + "</a:txBody></a:tc><a:tc><a:txBody>" + p("h2") + "</a:txBody></a:tc></a:tr><a:tr><a:tc><a:txBody>" + p("x") + "</a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    rels = lambda **r: "<Relationships>" + "".join(f"<Relationship Id='{k}' Type='http://x/{t}' Target='{to}'/>" for k, (t, to) in r.items()) + "</Relationships>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("ppt/presentation.xml", "<p:presentation xmlns:p='P' xmlns:r='R'><p:sldIdLst><p:sldId id='1' r:id='b'/><p:sldId id='2' r:id='a'/></p:sldIdLst></p:presentation>")
        z.writestr("ppt/_rels/presentation.xml.rels", rels(a=("slide", "slides/slide1.xml"), b=("slide", "/ppt/slides/slide2.xml"), c=("theme", "theme.xml")))
        z.writestr("ppt/slides/slide1.xml", slide(sp(p("Last")), sp(p("7"), "sldNum")))
        z.writestr("ppt/slides/slide2.xml", slide(sp(p("The ", "title"), "title"), sp(p("one", None, "two") + p(" ") + p("three")), table))
        z.writestr("ppt/slides/_rels/slide2.xml.rels", rels(n=("notesSlide", "../notesSlides/n1.xml")))
        z.writestr("ppt/notesSlides/n1.xml", slide(sp("", "sldImg"), sp(p("say this"), "body")))
    df = spark.createDataFrame([("a.PPTX", bytearray(buffer.getvalue())), ("b.pptx", bytearray(b"no"))], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in files.documents(df).collect()}
    assert got["a.PPTX"][0] == "<!-- Slide number: 1 -->\n\n# The title\n\none\ntwo\nthree\n\n| h\\|1 | h2 |\n| --- | --- |\n| x |  |\n\n### Notes:\n\nsay this\n\n<!-- Slide number: 2 -->\n\nLast"
    assert got["b.pptx"][0] is None and got["b.pptx"][1].startswith("broken document")
