"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import codec, common, components, html_text, lz_fingerprint, ngram_join, packing, piece_sampling, pii, quality_rules, sharding, token_counts, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, c long, t long, n long, `row` long, at string, part string"


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def sample():
    rng, texts = random.Random(5), []
    for _ in range(25):
        base = words_text(rng, rng.randrange(8, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            texts.append("  ".join(copy).upper() if rng.random() < 0.5 else "\n".join(copy))
    hub = words_text(rng, 200).split()
    for k in range(30):  # a hot group: one base, each copy edited elsewhere
        copy = list(hub)
        copy[5 * k + 3] = f"edit{k}"
        texts.append(" ".join(copy))
    texts += [None, "", " \n\t", "one", "One", "a b c d", "é" * 3, "same text here"] + ["same text here"] * 5 + ["long" * 5000, words_text(rng, 20_000)]
    return [(k, t, "en", f"s{k % 3}", len(t or ""), 1, 1, 1, 1, "x", "y") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


def text_of(rows):
    return {r[0]: r[1] or "" for r in rows}


# ---------------------------------------------------------------- 2

def shingles(text):
    w = WORD.findall(text.translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_copies_match_all_pairs(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(docs).collect()}
    assert got == classes(text_of(rows))


def test_near_copies_with_salted_shingles(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(docs).collect()}
    assert got == classes(text_of(rows))


def test_near_copies_without_a_hub(spark):
    """A chain: each text is near its neighbours only, so that the leaders' pairs don't reach all."""
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    rows = [(k, " ".join(w[3 * k : 3 * k + 60])) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(df).collect()} == classes(dict(rows))


def links(texts):
    sets = [shingles(t) for t in texts]
    return [sum(1 for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b)) for i, a in enumerate(sets)]


@pytest.mark.parametrize("block", [128, 3])
def test_near_copies_count_all_links(docs, rows, spark, monkeypatch, block):
    """Also between members of a group that aren't its leader, over several blocks, and with equal copies."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(5)
    w = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    group = [" ".join(w[:k] + [f"x{k}"] + w[k + 1 :]) for k in range(5, 95, 4)]
    chain = [" ".join(w[3 * k : 3 * k + 40][::-1]) for k in range(20)]
    texts = group + group[:3] + chain + ["", "alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in ngram_join.near_copies(df).collect()} == dict(enumerate(links(texts)))
    known = text_of(rows)
    assert {r.doc_id: r.n_links for r in ngram_join.near_copies(docs).collect()} == dict(zip(known, links(known.values())))


def test_keep_one(docs, rows):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in classes(text_of(rows)).values()}


def test_keep_one_with_repeated_ids(spark):
    """An id of several texts: each row is judged in its own component."""
    rng = random.Random(9)
    one, two, three, four = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(1, one), (5, one + " x"), (5, two), (5, two + " y"), (5, three), (5, three), (7, three), (5, four), (8, ""), (8, "  "), (8, ""), (None, one)]
    kept = sorted(map(tuple, ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    again = [r for r in kept if r[1] in (two, two + " y")]
    assert len(again) == 1
    assert [r for r in kept if r not in again] == sorted([(1, one), (5, three), (5, four), (8, ""), (8, "  "), (None, one)], key=str)


def test_near_copies_in_blocks_of_a_shingle(spark, docs, rows, monkeypatch):
    """Pairs across components, with the rows of each shingle in cells of a few."""
    monkeypatch.setattr(ngram_join, "CROSS_ROWS", 2)
    monkeypatch.setattr(ngram_join, "SEEN", 3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(docs).collect()} == classes(text_of(rows))
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    chain = [(k, " ".join(w[3 * k : 3 * k + 60])) for k in range(25)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_copies(df).collect()} == {k: v for k, (_, v) in classes(dict(chain)).items()}


def test_near_copies_with_clashing_keys(docs, rows, monkeypatch):
    """Different sets whose first keys are equal are told apart by the second."""
    whole = ngram_join.class_keys
    monkeypatch.setattr(ngram_join, "class_keys", lambda s: (whole(s)[0] % 20, whole(s)[1]))
    monkeypatch.setattr(ngram_join, "class_key", lambda s, clashes: whole(s)[1] if whole(s)[0] % 20 in clashes else whole(s)[0] % 20)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_copies(docs).collect()}
    text = text_of(rows)
    assert got == {k: (*v, n) for (k, v), n in zip(classes(text).items(), links(text.values()))}


def test_components_on_paths_and_hubs(spark, monkeypatch):
    rng, edges = random.Random(1), []
    edges += [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1200)] + [(7, 7), (None, 3), (61, None)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    for small in (components.SMALL, 0):
        monkeypatch.setattr(components, "SMALL", small)
        got = {r.node: r.root for r in components.connected_components(df).collect()}
        assert got == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1200)}


# ---------------------------------------------------------------- 1

def test_hilbert_neighbours():
    import itertools

    cells = np.array(list(itertools.product(range(8), repeat=3)))
    key = common.hilbert_numpy(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_hilbert_column_is_the_same(spark):
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 32, (300, 3))
    df = spark.createDataFrame([tuple(map(int, r)) for r in cells], "a int, b int, c int")
    got = [r.k for r in df.select(common.hilbert_column([F.col("a"), F.col("b"), F.col("c")], 5).alias("k")).collect()]
    assert got == common.hilbert_numpy(cells, 5).tolist()


def test_shards(docs, rows):
    got = sharding.shard_rows(docs).collect()
    text = text_of(rows)
    assert sorted(r.doc_id for r in got) == sorted(text)
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert set(by) == set(range(16)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_tell_whole_strings_apart(spark):
    """Long values that differ at their ends only lie in cells of their own, in their order; a hot value fills one."""
    head = "https://example.org/" + "p" * 300
    values = [f"{head}/{k:03d}" for k in range(64)]
    rows = [(k, "x", values[k % 64], "e") for k in range(640)] + [(1000 + k, "x", "zhot", "e") for k in range(300)] + [(2000, "x", None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    bounds = sharding._text_bounds(df, "source", 32)
    assert bounds == sorted(bounds) and 20 <= len(bounds) <= 31 and set(bounds) <= {*values, "zhot"}
    key = {r.source: r.hilbert for r in sharding.hilbert_key(df, ["source"], 5).collect()}
    own = [key[v] for v in values]
    assert own == sorted(own) and len(set(own)) >= 15 and key[None] == 0 and key["zhot"] >= own[-1]


def test_hilbert_of_the_finished_shards(docs, rows):
    """The curve's index of each row, from cells found by plain counting."""
    text = text_of(rows)
    got = sharding.shard_rows(docs, dims=("source", "size")).collect()
    size = sorted(len(t.encode()) + 1 for t in text.values())
    source = sorted(f"s{k % 3}" for k in text)
    n = len(size)
    bounds = {x: [v[max(0, -(-i * n // 32) - 1)] for i in range(1, 32)] for x, v in (("size", size),)}
    starts = sorted({min(v for v in set(source) if source.index(v) * 32 // n == c) for c in {source.index(v) * 32 // n for v in set(source)} if c > 0})
    cells = [[sum(b <= f"s{r.doc_id % 3}" for b in starts), sum(b < r.size for b in bounds["size"])] for r in got]
    assert [r.hilbert for r in got] == common.hilbert_numpy(np.array(cells), 5).tolist()
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in got)


def test_intermediate_tables_go(spark):
    import os

    df = spark.range(3)
    one, last = common.materialise(df, "a"), []
    two = common.materialise(one, "b", last)
    first = list(last)
    three = common.materialise(two, "c", last)
    folder = common.shared_dir(spark)
    assert not os.path.exists(first[0]) and os.path.exists(last[0]) and last[0].startswith(folder)
    assert sorted(r.id for r in three.collect()) == [0, 1, 2] and one.count() == 3
    common.clear(spark, last[0])
    assert not os.path.exists(last[0])


def test_ranges_and_counts_below(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 64):
        bounds = sorted(rng.randrange(-50, 50) for _ in range(n))
        df = spark.range(-60, 60).select("id", common.count_below(bounds, F.col("id")).alias("k"))
        assert all(r.k == sum(b < r.id for b in bounds) for r in df.collect())
    rows = [(None, f"t{k}") for k in range(400)] + [(k, "x") for k in range(800)]
    got = common.by_ranges(spark.createDataFrame(rows, "id long, text string"), F.col("id"), 12, tie=F.col("text")).collect()
    sizes = collections.Counter(r.range for r in got)
    assert len(sizes) == 12 and max(sizes.values()) < 200
    assert max(r.range for r in got if r.id is None) <= min(r.range for r in got if r.id is not None)


def test_written_shards_prune(docs, tmp_path):
    told = sharding.write_shards(docs, str(tmp_path / "s"), 4, ("source", "size")).orderBy("shard").collect()
    back = docs.sparkSession.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() == sum(r.n_rows for r in told)
    assert any(r.min_source == r.max_source or r.max_size < max(x.max_size for x in told) for r in told)


def test_shards_hold_every_row(spark, tmp_path):
    """Null and repeated ids, ties, clashing names: rows out are rows in; bounds of the files prune."""
    import pyarrow.parquet as pq

    rows = [(1, "a", "en", "s", 5, "r"), (1, "bb", "en", "s", 5, "r"), (None, "ccc", None, None, None, None), (2, "d", "en", "t", 1, "x"), (2, "d", "en", "t", 1, "x"), (3, None, "fr", "u", 0, "")]
    rows += [(k, "x" * (k % 50), ("de", "en", "fr", "es")[k % 4], f"s{k % 9}", k, "y") for k in range(10, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot long, `rank` string").repartition(5)
    told = sharding.write_shards(df, str(tmp_path / "a"), 8).collect()
    back = spark.read.parquet(str(tmp_path / "a"))
    assert collections.Counter(tuple(r) for r in back.drop("shard").select(*df.columns).collect()) == collections.Counter(rows)
    assert sorted(r.n_rows for r in told) == [49] * 4 + [50] * 4 and sum(r.n_bytes for r in told) == sum(len(r[1] or "") + 1 for r in rows)
    in_shard = {r.shard: (r.a, r.b) for r in back.groupBy("shard").agg(F.min("lang").alias("a"), F.max("lang").alias("b")).collect()}
    assert in_shard == {r.shard: (r.min_lang, r.max_lang) for r in told}
    files = list((tmp_path / "a").rglob("*.parquet"))
    stats = [pq.ParquetFile(f).metadata.row_group(0).column(2).statistics for f in files]
    assert sum(s.min <= "fr" <= s.max for s in stats) < len(files)  # a scan for one language skips files
    with pytest.raises(ValueError):
        sharding.write_shards(df.withColumn("Shard", F.lit(1)), str(tmp_path / "b"))
    assert sharding.write_shards(df.limit(0), str(tmp_path / "c")).count() == 0


# ---------------------------------------------------------------- 3

def luhn(s):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0


def digits(v):
    return re.sub("[^0-9]", "", v)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
]


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text) if ok(m.group())]


def test_spans_match_plain_patterns(spark):
    rng = random.Random(9)
    parts = ["a@b.co", "@", ".", "_x@y.z", "1.2.3.4", "300.1.1.1", "0255.007.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (415) 555-0132", "+49", " ", "-", "é😀", "12", "+", "%", "99999999999999999999.1.1.1", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(800)] + ["", "a." * 30_000 + "@b" + ".c" * 30_000, "1" * 50_000, "1 " * 20_000, "x" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_spans(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] == plain_spans(r.text), r.text[:200]


def test_added_kinds_and_scores(spark):
    good, bad = "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00"
    df = spark.createDataFrame([(1, f"my iban is {good}."), (2, f"iban {bad}"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")], "doc_id long, text string")
    got = {r.doc_id: {s.kind: s.score for s in r.spans if s.kind in ("iban", "ssn")} for r in pii.find_spans(df).collect()}
    assert got == {1: {"iban": 0.9}, 2: {}, 3: {"ssn": 0.6}, 4: {}}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to a@b.co and 1.2.3.4!", "k"), (2, None, "k"), (3, "none", "k")], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.text, r.spans) for r in pii.redact(df).collect()}
    assert got == {1: ("to [EMAIL] and [IP]!", "k"), 2: (None, "k"), 3: ("none", "k")}


def plain_redaction(text, spans):
    """A span that begins before an earlier one's end adds nothing to the text but its length."""
    out, at = [], 0
    for a, back, kind in sorted((s.start, -s.end, s.kind) for s in spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -back)
    return "".join(out) + text[at:]


def test_redaction_is_brute_force(spark):
    """Overlapping kinds, more spans than a block of them holds, and characters of two code units."""
    rng = random.Random(12)
    parts = ["a@b.co", "1.2.3.4", "1.2.3.4@x.yz", "4111 1111 1111 1111", "+1 415 555 0132.1.2.3", " ", "é😀", "mail ", "server ", ",", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in [0, 1, 3, 10, 50] * 40 + [600, 5000]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_spans(df).collect()}
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for k, text in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in spans[k] if s.kind in pii.BASE] == plain_spans(text)
        for s in spans[k]:
            near = text[max(s.start - 40, 0) : s.start] + " " + text[s.end : s.end + 40]
            score, words = next((x[3], x[4]) for x in pii.KINDS if x[0] == s.kind)
            assert s.value == text[s.start : s.end] and s.score == round(score + 0.2 * bool(re.search(words, near, re.I)), 2)
        assert got[k] == plain_redaction(text, spans[k])


def test_texts_full_of_spans(spark):
    """Two megabytes of numbers and 50,000 mails take seconds, not hours."""
    texts = ["12," * 700_000, "".join(f"user{i}@mail.example.com, " for i in range(50_000)), "1.1.1.1," * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    begin = time.time()
    got = {r.doc_id: r.n for r in pii.find_spans(df).select("doc_id", F.size("spans").alias("n")).collect()}
    sizes = {r.doc_id: r.n for r in pii.redact(df).select("doc_id", F.length("text").alias("n")).collect()}
    assert got == {0: 0, 1: 50_000, 2: 100_000} and sizes == {0: 2_100_000, 1: 9 * 50_000, 2: 5 * 100_000}
    assert time.time() - begin < 120


# ---------------------------------------------------------------- 4, 9, 10

def whole(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_path(name))


@pytest.mark.parametrize("name, drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_codec_equals_whole_encoding(name, drops):
    rng = random.Random(4)
    parts = [" ", "\n", "  ", "\t", " ", "a", "The", "word,", "É", "é", "́", "ß", "ΑΣ", "漢", "😀", "'s", "don't", "O'S,", "12", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "!!", "#x", "\r\n", "\x1c", " ", "İ", "ﬁ", ".", "$$$"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    expect = [e.ids for e in whole(name).encode_batch(texts, add_special_tokens=False)]
    for most in (1_000_000, 50):
        c = codec.Codec(name, drops, False, most)
        ids, counts = c.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == expect


def test_codec_offsets():
    texts = ["Ein Wort,\n\nnoch\teins  é😀x", "", "a  b", " lead"]
    spans = codec.Codec("byte_bpe_50k.json", False, True).encode(texts)[2]
    assert [tuple(s) for s in spans.tolist()] == [o for e in whole("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False) for o in e.offsets]


def test_token_files(spark, docs, rows, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(docs, path)
    tok, at = whole("byte_bpe_50k.json"), 0
    got = {r.doc_id: r for r in token_files.read_tokens(spark, path).collect()}
    for k, text in sorted(text_of(rows).items()):
        ids = tok.encode(text, add_special_tokens=False).ids + [0]
        assert (got[k].start, got[k].n_tokens, got[k].tokens) == (at, len(ids), ids)
        at += len(ids)
    plan = token_files.read_tokens(spark, path).select("doc_id", "start")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,part:int,part_start:bigint>" in plan


def test_packing(docs, rows):
    tok, text = whole("word_bpe_49k.json"), text_of(rows)
    pieces = packing.pack(docs, length=64).collect()
    ids = {k: tok.encode(t, add_special_tokens=False).ids + [1] for k, t in text.items()}
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    for k, own in ids.items():
        at = 0
        for p in sorted(by[k], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(own), zlib.crc32(np.array(own[at : at + p.length], "<u4").tobytes()))
            at += p.length
        assert at == len(own)
    for s, own in seq.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 64 or s == max(seq)


def test_section_rules():
    spans, sections = np.array([[0, 2], [2, 6], [6, 7], [8, 9]]), np.array([[0, 3], [3, 7]])
    assert [x.tolist() if hasattr(x, "tolist") else x for x in token_counts.attribute(spans, sections, "start")] == [[2, 1], 1, 1]
    assert token_counts.attribute(spans, sections, "most")[0].tolist() == [1, 2]
    assert token_counts.attribute(spans, sections, "share")[0].tolist() == [1.25, 1.75]


def test_section_counts(docs, rows):
    """Each line's tokens by every rule, by plain loops over the library's own offsets."""
    text, tok = text_of(rows), whole("byte_bpe_50k.json")
    for rule in token_counts.RULES:
        for r in token_counts.token_counts(docs, rule=rule).collect():
            t = text[r.doc_id]
            ends = [k + 1 for k, c in enumerate(t) if c == "\n"] + [len(t)]
            begins = [0, *ends[:-1]]
            want, crossing = [0.0] * len(ends), 0
            for a, b in tok.encode(t, add_special_tokens=False).offsets:
                b = max(b, a + 1)
                parts = {k: min(b, y) - max(a, x) for k, (x, y) in enumerate(zip(begins, ends)) if min(b, y) > max(a, x)}
                crossing += len(parts) > 1
                if not parts:
                    continue
                if rule == "share":
                    for k, n in parts.items():
                        want[k] += n / (b - a)
                else:
                    want[min(parts) if rule == "start" else max(parts, key=lambda k: (parts[k], -k))] += 1
            assert r.n_sections == len(ends) and r.n_crossing == crossing and r.section_tokens == pytest.approx(want), (rule, t[:80])


def test_curve_order_of_packing(docs, rows):
    """Documents come in the order of their keys, from weights and cells computed one by one."""
    tok, text = whole("word_bpe_49k.json"), text_of(rows)

    def weight(i):
        raw = plain_mix(i)
        return np.float32((sum((raw >> s & 0xFFFF) for s in (0, 16, 32, 48)) / 65536 - 2) * 3**0.5)

    def key(t):
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        mean = np.add.reduce([[weight((i & 0xFFFF) * 3 + d) for d in range(3)] for i in ids], axis=0) / len(ids)
        return common.hilbert_numpy(np.clip(((0.5 + np.arctan(10.0 * mean) / np.pi) * 1024).astype(np.int64), 0, 1023)[None, :], 10)[0]

    some = {k: t for k, t in text.items() if len(t) < 2000}
    df = docs.where(F.length(F.coalesce("text", F.lit(""))) < 2000)
    pieces = sorted((p.sequence_id, p.offset, p.doc_id) for p in packing.pack(df, length=64).where("start = 0").collect())
    keys = [key(some[d]) for _, _, d in pieces]
    assert len(pieces) == len(some) and sum(a > b for a, b in zip(keys, keys[1:])) <= len(keys) // 50


def test_given_sections(spark):
    df = spark.createDataFrame([(1, "alpha beta", [(0, 5), (5, 10)]), (2, None, None)], "doc_id long, text string, s array<struct<start:int,end:int>>")
    got = {r.doc_id: (r.n_tokens, r.section_tokens) for r in token_counts.token_counts(df, "s").collect()}
    assert sum(got[1][1]) == got[1][0] and got[2] == (0, [])


# ---------------------------------------------------------------- 5

def plain_counts(x):
    w = WORD.findall(x)
    c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    rep = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [line for line in x.split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(rep)


def test_quality_counts(spark, rows):
    texts = [r[1] for r in rows] + ["a b c a b c\n\na b c\n a b c", "é#é |\x0b|", "x\ny\nx\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.with_stats(df).collect():
        assert tuple(r.quality_stats)[:5] == plain_counts(r.text or "")


def test_rules_on_held_out_rows():
    rng = np.random.default_rng(2)
    x = {"a": rng.uniform(0, 10, 4000), "b": rng.uniform(0, 10, 4000), "c": rng.uniform(0, 10, 4000)}
    low = (x["a"] > 8) | ((x["b"] < 2) & (x["c"] > 5))
    half = {k: v[:2000] for k, v in x.items()}
    rules = quality_rules.fit_list(half, low[:2000])
    got = rules.low({k: v[2000:] for k, v in x.items()})
    assert (got == low[2000:]).mean() > 0.97 and 2 <= len(rules.rules) <= 12


def test_kept_documents(spark, data):
    """The verdict of every document, by plain comparison of its own counts with the fitted thresholds; and on labels held out."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rules = quality_rules.fit(docs, labels)
    got = {r.doc_id: (r.kept, r.rule) for r in quality_rules.QUERIES["op5_quality_rules"](spark, data).collect()}
    upper, digit, bang = re.compile("[A-Z]"), re.compile("[0-9]"), re.compile("!")
    for r in docs.collect():
        t = r.text or ""
        w = WORD.findall(t)
        n, chars, symbols, dups, repeats = plain_counts(t)
        lines, letters = [x for x in t.split("\n") if WORD.search(x)], len(re.findall("[A-Za-z]", t))
        share = lambda a, b: round(100 * a / b, 3) if b else 0.0
        m = {"n_words": n, "word_length": round(chars / n, 3) if n else 0.0, "symbols": share(symbols, n), "dup_lines": share(dups, len(lines)), "repeats": share(repeats, n), "upper": share(len(upper.findall(t)), letters), "digits": share(len(digit.findall(t)), chars), "bangs": share(len(bang.findall(t)), n), "distinct": share(len(set(w)), n)}
        fired = next((k for k, rule in enumerate(rules.rules, 1) if all(m[a] <= v if op == "<=" else m[a] >= v for a, op, v in rule.conditions)), 0)
        failed = n < 50 or 100 * repeats > 50 * n
        assert got[r.doc_id] == (not failed and fired == 0, fired)
    half = quality_rules.fit(docs, labels.where("doc_id % 2 = 0"))
    judged = quality_rules.keep_good(docs.join(labels.where("doc_id % 2 = 1 and quality = 1").select("doc_id"), "doc_id", "left_semi"), half).count()
    good = quality_rules.keep_good(docs.join(labels.where("doc_id % 2 = 1 and quality = 1").select("doc_id"), "doc_id", "left_semi"), quality_rules.DecisionList()).count()
    assert judged >= 0.85 * good


def test_rules_as_expression(spark):
    rules = quality_rules.DecisionList([quality_rules.Rule([("symbols", ">=", 50.0)]), quality_rules.Rule([("upper", ">=", 60.0), ("n_words", "<=", 5.0)])])
    df = spark.createDataFrame([(1, "a# b#"), (2, "AB CD"), (3, "ab cd"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.x for r in quality_rules.with_stats(df).select("doc_id", rules.column().alias("x")).collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: 0}
    assert quality_rules.fit_list({"a": np.zeros(4)}, np.zeros(4, bool)).rules == []


# ---------------------------------------------------------------- 6

def test_pieces_decode_and_repeat():
    rng = random.Random(2)
    parts = [" ", "\n", "  ", "\t", "▁", "a", "B", "é", "漢", "😀", "ing", "the", " of", "tion", "qu", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(500)] + ["ab" * 3000]
    s, keys = piece_sampling.Sampler(piece_sampling.MODEL, 0.25), np.arange(501).astype(np.uint64)
    ids, counts = s.encode(texts, keys)
    own = np.split(ids, np.cumsum(counts)[:-1])
    assert all(s.decode(x.tolist()) == t for x, t in zip(own, texts))
    again = piece_sampling.Sampler(piece_sampling.MODEL, 0.25)
    assert all(again.encode([texts[k]], keys[k : k + 1])[0].tolist() == own[k].tolist() for k in (3, 77, 500))


def test_pieces_follow_the_lattice():
    s = piece_sampling.Sampler(piece_sampling.MODEL, 0.25)

    def paths(u):
        if not u:
            yield (), 1.0
        for k in range(1, len(u) + 1):
            if hit := s.weights.get(u[:k]):
                for p, w in paths(u[k:]):
                    yield (hit[0], *p), w * hit[1]

    want, n = dict(paths(" thing")), 100_000
    ids, counts = s.encode([" thing"] * n, np.arange(n).astype(np.uint64))
    ends = np.cumsum(counts)
    got = collections.Counter(tuple(ids[b - m : b].tolist()) for b, m in zip(ends, counts))
    total = sum(want.values())
    assert set(got) <= set(want) and all(abs(got[p] / n - w / total) < 0.01 for p, w in want.items())


def test_short_and_long_lattices_agree():
    """The way of a unit is the same by the kept lattice of all units and by forward sums alone."""
    s = piece_sampling.Sampler(piece_sampling.MODEL, 0.25)
    units = [" thinking", "é漢x", "a", " ", "\n", "zzzzqqqq", "international", " 😀😀", "QmFzZTY0IGVuY29kZWQ"]
    stream = common.mix(np.arange(400 * len(units), dtype=np.uint64))
    ids, counts = s._walk(units * 400, stream)
    own = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert own == [s.sample(u, int(k)) for u, k in zip(units * 400, stream)]


def test_sampled_spellings_and_long_units(monkeypatch):
    """Probabilities of ways with byte pieces; and of a unit over 64 characters, by the shares of its last edges."""
    s = piece_sampling.Sampler(piece_sampling.MODEL, 0.25)

    def paths(u, at=0):
        if at == len(u):
            yield (), 1.0
        for k in range(at + 1, len(u) + 1):
            if hit := s.weights.get(u[at:k]):
                for p, w in paths(u, k):
                    yield (hit[0], *p), w * hit[1]
            elif k == at + 1:
                spelled = [s.spelled[b] for b in u[at].encode()]
                for p, w in paths(u, k):
                    yield (*spelled, *p), w * s.rare ** len(spelled)

    unit, n = "a漢\U0001F9FFing", 6_000
    want = dict(paths(unit))
    got = collections.Counter(tuple(s.sample(unit, int(k))) for k in common.mix(np.arange(n, dtype=np.uint64)))
    total = sum(want.values())
    assert any(len("".join(unit).encode()) > 3 and s.spelled[0xF0] in p for p in want)
    assert set(got) <= set(want) and all(abs(got[p] / n - w / total) < 0.04 for p, w in want.items())
    long = "the" * 30
    sums, scales = s.forward(long)
    exact = [1.0]
    for j in range(1, len(long) + 1):
        exact.append(sum(exact[i] * w for i, _, w in s._into(long, j)))
    assert all(abs(a * piece_sampling.HUGE ** -k - b) <= 1e-9 * b for a, k, b in zip(sums, scales, exact))
    monkeypatch.setattr(piece_sampling, "TINY", 1e-3)
    monkeypatch.setattr(piece_sampling, "HUGE", 1e3)
    monkeypatch.setattr(piece_sampling, "BLOCK", 17)
    small, more = s.forward(long)
    assert max(more) >= 2 and all(abs(a * 1e3**-k - b) <= 1e-9 * b for a, k, b in zip(small, more, exact))


def test_very_long_texts():
    """Ten million characters without a space: hashing, parsing, encoding and sampling take bounded memory beside the text."""
    import resource

    import pyarrow as pa

    rng = np.random.default_rng(3)
    text = bytes(rng.choice(np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8), 10_000_000)).decode()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    column = pa.array([text, "a b c d e f " + text[:3_000_000] + " z"])
    one, two = ngram_join.shingle_sets(column)
    assert len(one) == 1 and len(two) == 4
    assert quality_rules.counts_of(column)[:, 0].tolist() == [1, 8]
    assert len(lz_fingerprint.fingerprint(text[:3_000_000])) == 128
    short = text[:2_000_000]
    s = piece_sampling.Sampler(piece_sampling.MODEL, 0.25)
    ids, counts = s.encode([short], np.array([1], np.uint64))
    assert s.decode(ids.tolist()) == short and counts.tolist() == [len(ids)]
    c = codec.Codec("byte_bpe_50k.json", False, True)
    _, counts, spans = c.encode([short])
    assert spans[0, 0] == 0 and spans[-1, 1] == len(short) and counts[0] == len(spans)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1e6 < 1.8


def test_segment_hashes_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    base = 0x9E3779B97F4A7C15 | 1
    for starts in ([0], [3], [0, 1, 2, 999], [5, 130, 131, 500], list(range(0, 1000, 7))):
        ends = [*starts[1:], 1000]
        want = [plain_mix(sum(int(v) * pow(base, i, 1 << 64) for i, v in enumerate(data[a:b])) & M64) for a, b in zip(starts, ends)]
        for step in (1 << 18, 64, 7, 1):
            monkeypatch.setattr(common, "STEP", step)
            assert common.segment_hashes(1000, lambda a, b: data[a:b], np.array(starts)).tolist() == want


def test_pieces_round_trip_in_spark(docs, rows):
    back = {r.doc_id: r.text for r in piece_sampling.decode_pieces(piece_sampling.sample_pieces(docs)).collect()}
    assert back == text_of(rows)


# ---------------------------------------------------------------- 7

def plain_phrases(text):
    """LZ78 by longest known prefix: each phrase is the longest one known, and one more character."""
    known, at = set(), 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end] in known:
            end += 1
        if text[at:end] in known:
            break  # an unfinished phrase at the end of the text
        known.add(text[at:end])
        at = end
    return known


M64 = (1 << 64) - 1


def plain_mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain_fingerprint(text):
    """The 128 smallest of the phrases' hashes: polynomials in an odd number, over mixed code points, mixed again."""
    base = 0x9E3779B97F4A7C15 | 1
    hashes = {plain_mix(sum(plain_mix((ord(c) + 0x11) & M64) * pow(base, i, 1 << 64) for i, c in enumerate(p)) & M64) >> 32 for p in plain_phrases(text)}
    return sorted(hashes)[:128]


def plain_likeness(a, b):
    both = sorted(set(a) | set(b))[:128]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def test_fingerprints(spark):
    rng = random.Random(6)
    texts = [words_text(rng, rng.randrange(0, 150), 4000) for _ in range(60)] + [None, "", "é😀", "a", "aa", "a" * 500]
    texts += [texts[3], texts[5][:400] + texts[4]]
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in lz_fingerprint.fingerprints_with_next(df).collect()}
    ids, text = sorted((k for k, _ in rows), reverse=True), {k: t or "" for k, t in rows}
    fp = {k: plain_fingerprint(t) for k, t in text.items()}
    for at, k in enumerate(ids):
        x, nxt = text[k], ids[(at + 1) % len(ids)]
        half = len(x) // 2
        edited = x[: len(x) - half] + text[nxt][:half]
        fe = plain_fingerprint(edited)
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(f"{v:08x}" for v in fp[k]), "".join(f"{v:08x}" for v in fe))
        assert (r.near_edited, r.near_next) == (plain_likeness(fp[k], fe), plain_likeness(fp[k], fp[nxt]))


def test_fingerprints_of_repeated_ids(spark):
    """Rows of one id, and of none, each have one next: the texts' pairs make one ring over all rows."""
    rng = random.Random(4)
    rows = [(None, words_text(rng, 20, 4000)) for _ in range(40)] + [(7, words_text(rng, 20, 4000)) for _ in range(40)] + [(k, words_text(rng, 20, 4000)) for k in range(100, 120)] + [(7, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lz_fingerprint.fingerprints_with_next(df).collect()
    assert collections.Counter((r.doc_id, r.n_chars) for r in got) == collections.Counter((k, len(t or "")) for k, t in rows)
    heads = collections.Counter(hashlib.sha256(((t or "")[: len(t or "") - len(t or "") // 2] + (u or "")[: len(t or "") // 2]).encode()).hexdigest() for _, t in rows for _, u in rows)
    assert all(r.edited_sha256 in heads for r in got)


def test_likeness_is_near_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    b = np.concatenate([a[:2000], rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)])
    assert abs(lz_fingerprint.likeness(lz_fingerprint.signature(a), lz_fingerprint.signature(b)) - 0.5) < 0.15
    assert lz_fingerprint.likeness(lz_fingerprint.signature(a), lz_fingerprint.signature(a)) == 1.0


# ---------------------------------------------------------------- 8

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">menu one</a></li></ul></nav><div class="cookie-notice">We use cookies and such</div>
%s<h1>The  head</h1><p>First para with a good number of words in it, so that it counts &amp; stays.<p>Short.<p><b>Third <i>para</b> goes on for a while with other words in a row, and ends here.<br>After a break.
<div class="ad-box"><p>Buy now, buy a lot of this fine product that we advertise here at length.</p></div>%s
<section id="comments"><p>I think that this is a long comment by a reader of this page, isn't it.</p></section>
<aside>side words</aside><form><label>Mail</label><input name="m"></form><footer>&copy; foot words that may be many in number for a footer</footer>"""
TEXT = "The head First para with a good number of words in it, so that it counts & stays. Short. Third para goes on for a while with other words in a row, and ends here. After a break."


@pytest.mark.parametrize("a, b", [("<article>", "</article>"), ("<main>", "</main></body></html>"), ('<div id="content">', "</div>")])
def test_main_text(a, b):
    assert html_text.main_text(PAGE % (a, b)) == TEXT


def test_broken_pages():
    assert html_text.main_text("") == "" and html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain &lt;words") == "plain <words"
    assert html_text.main_text("<p>a" + "<div>" * 5000 + "deep") == "a deep"
    assert html_text.main_text("<<>><p a=b c='d>x") is not None


def test_main_text_drops_nothing_but_excluded_elements():
    long = "<p>" + "many words of the text " * 20 + "</p>"
    clean = " ".join(("many words of the text " * 20).split())
    more = "<p>the last words of the page, a good deal shorter than the text before</p>"
    last = more[3:-4]
    page = f"<body><nav>n</nav><div id=c><h1>T</h1><div class=text>{long * 5}</div><div class=more>{more}</div></div></body>"
    assert html_text.main_text(page) == " ".join(["T", *[clean] * 5, last])
    assert html_text.main_text(f"<main><article><h2>A</h2>{long * 9}</article><article><h2>B</h2>{more}</article></main>") == " ".join(["A", *[clean] * 9, "B", last])
    deep = "<div>" * 500 + long + "<nav>menu " + "<p>" + "of links " * 90 + "</nav><aside>beside</aside>" + more
    assert html_text.main_text(f"<body>{deep}") == f"{clean} {last}"


def paragraphs(rng, n, words):
    return [" ".join(f"w{rng.randrange(400)}" for _ in range(words)) for _ in range(n)]


def test_ratios_select_the_text_of_neutral_pages():
    """No article, no telling names: link lists, a short teaser and a foot line have low ratios."""
    rng = random.Random(8)
    for _ in range(20):
        text = paragraphs(rng, rng.randrange(4, 9), rng.randrange(40, 90))
        text[2] = "Short one."
        links = "".join(f"<li><a href='/{k}'>go {k}</a></li>" for k in range(8))
        page = f"<body><div class=x1><ul>{links}</ul></div><div class=x2><a href=/>Teaser words</a></div><div class=x3><h2>The title</h2>{''.join(f'<p>{t}</p>' for t in text)}</div><div class=x4><ul>{links}</ul></div><div class=x5>All rights</div></body>"
        assert html_text.main_text(page) == " ".join(["The title", *text])


def test_names_alone_do_not_decide(monkeypatch):
    """A telling name around the whole page says nothing, and with other ratios another text comes out."""
    rng = random.Random(8)
    text = paragraphs(rng, 5, 60)
    body = "".join(f"<p>{t}</p>" for t in text)
    assert html_text.main_text(f"<body><div class='page sidebar-left'><nav>menu</nav><h1>T</h1>{body}</div></body>") == " ".join(["T", *text])
    page = f"<body><div class=ad>buy this</div><article>{body}</article><div class=ad>and that</div></body>"
    assert html_text.main_text(page) == " ".join(text)
    monkeypatch.setattr(html_text, "upper_cluster", lambda values: np.ones(len(values), bool))
    monkeypatch.setattr(html_text, "SHARE", 0.0)
    assert html_text.main_text(page) == " ".join(["buy this", *text, "and that"])


def test_headings_and_headers():
    body = "".join(f"<p>{t}</p>" for t in paragraphs(random.Random(8), 4, 60))
    text = " ".join(paragraphs(random.Random(8), 4, 60))
    assert html_text.main_text(f"<body><div class=x><h1>Site</h1></div><article><div class='article-header'><h1>Title</h1></div>{body}</article></body>") == "Title " + text
    assert html_text.main_text(f"<body><div id=header><h1>Site</h1></div><div><h2>Title</h2><div>{body}</div></div></body>") == "Title " + text
    comment = "<section class=comments><p>" + "long words of a reader " * 30 + "</p></section>"
    assert html_text.main_text(f"<main><h1>Title</h1>{body}{comment}<p>End.</p></main>") == f"Title {text} End."


NAMED = [  # names of an article's own sections, and of what goes even within an article
    (True, ["related-work", "social-policy", "search-history", "login-security", "form-and-function", "notice-of-terms", "search", "cookies", "notice", "menu", "commentary", "share-of-market", "ad-hoc", "header2 text", "user-guide"]),
    (False, ["comments", "comment-list", "sidebar", "ads", "ad-box top", "site-nav", "sponsored links", "breadcrumbs"]),
]


@pytest.mark.parametrize("stays, name", [(stays, n) for stays, names in NAMED for n in names])
@pytest.mark.parametrize("of", ["id", "class"])
def test_named_sections(stays, name, of):
    text = paragraphs(random.Random(4), 6, 60)
    p = [f"<p>{t}</p>" for t in text]
    page = f"<body><nav>menu</nav><article><h1>Title</h1>{p[0]}{p[1]}<section {of}='{name}'>{p[2]}{p[3]}</section>{p[4]}{p[5]}</article><footer>foot</footer></body>"
    assert html_text.main_text(page) == " ".join(["Title", *(text if stays else text[:2] + text[4:])])


def test_reader_comments_go_whatever_is_around_them():
    """A long comment section after an article whose last short lines are flagged themselves, and comments with names and dates."""
    text = paragraphs(random.Random(5), 5, 60)
    body = "".join(f"<p>{t}</p>" for t in text)
    short = "<div class=notice>Note this.</div><div class=sidebar>See there.</div><blockquote class=comment>He said so.</blockquote>"
    said = " ".join(paragraphs(random.Random(6), 1, 90))
    for end in (f"<section id=comments><p>{said}</p></section>", f"<section id=comments><div><b>Ann</b> <time>1 May</time><p>{said}</p></div><div><b>Bob</b> <time>2 May</time><p>{said}</p></div></section>"):
        got = html_text.main_text(f"<body><article><h1>T</h1>{body}{short}</article>{end}</body>")
        assert got == " ".join(["T", *text])
        got = html_text.main_text(f"<body><div><h1>T</h1>{body}{short}</div>{end}</body>")
        assert got == " ".join(["T", *text])


def test_clusters_choose_the_text(monkeypatch):
    """Without the clusters, pages of neutral blocks give their link lists and teasers too."""
    text = paragraphs(random.Random(7), 6, 70)
    links = "".join(f"<div><a href='/{k}'>go {k}</a> more</div>" for k in range(12))
    page = f"<body><div class=x1>{links}</div><div class=x2>{''.join(f'<p>{t}</p>' for t in text)}</div><div class=x4>{links}</div></body>"
    assert html_text.main_text(page) == " ".join(text)
    monkeypatch.setattr(html_text, "upper_cluster", lambda values: None)
    assert html_text.main_text(page) != " ".join(text)


def test_pages_of_odd_tables(spark):
    rows = [(1, "u", "<article><p>one two</p></article>")] * 3 + [(None, None, None), (2, "v", ""), (3, "w", "<p>" + "long words " * 900_000)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = collections.Counter((r.page_id, r.url, r.text[:20], r.n_chars) for r in html_text.extract_main_text(df).collect())
    assert got == {(1, "u", "one two", 7): 3, (None, None, "", 0): 1, (2, "v", "", 0): 1, (3, "w", "long words long word", 9_899_999): 1}
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_menus_below_any_depth():
    assert html_text.main_text("<body><article><p>some text of the page" + "<div>" * 5000 + "<nav>MENU</nav><script>var x=1</script><style>p{}</style><p>deep text") == "some text of the page deep text"
    big = "<p>" + "x" * 10_000_000 + "</p>"
    assert len(html_text.main_text(f"<article>{big}</article>")) == 10_000_000


def test_main_text_against_a_slow_version():
    """Pages made of blocks with known tags: the same lines are chosen by loops over the definition."""
    import math

    rng = random.Random(21)
    for _ in range(300):
        blocks, html = [], "<body>"  # (text, tags, container, sealed, beside, heading, linked)
        first = 1  # the body's tag counts for the first line
        for c in range(rng.randrange(1, 5)):
            kind = rng.choice(["div", "div class=x", "div class=ad", "article", "section id=comments"])
            html += f"<{kind}>"
            lead = 1
            for _ in range(rng.randrange(0, 6)):
                words = " ".join("abcdefgh"[: rng.randrange(1, 8)] for _ in range(rng.choice([1, 2, 30, 90])))
                tag = rng.choice(["p", "p", "h2", "pa"])
                if tag == "pa":
                    html += f"<p><a>{words}</a></p>"
                    tags = first + lead + 3
                else:
                    html += f"<{tag}>{words}</{tag}>"
                    tags = first + lead + 1
                tags += 1
                blocks.append((words, tags, c, kind == "article", kind in ("div class=ad", "section id=comments"), tag == "h2", tag == "pa"))
                first = lead = 0
            html += f"</{kind.split()[0]}>"
            first += lead + 1
        if not blocks:
            continue
        n = len(blocks)
        beside = [b[4] and any(x[2] != b[2] for x in blocks) for b in blocks]
        score = [math.log((0.01 if y else 20 if b[3] else 1) * len(b[0]) / b[1] + 0.1) for b, y in zip(blocks, beside)]
        smooth = []
        for i in range(n):
            near = [(math.exp(-0.5 * d * d), score[i + d]) for d in range(-3, 4) if 0 <= i + d < n]
            smooth.append(sum(w * s for w, s in near) / sum(w for w, _ in near))
        cut = (min(smooth) + max(smooth)) / 2
        if max(smooth) - min(smooth) < 1:
            seeds = [i for i in range(n) if not beside[i]]
        else:
            for _ in range(50):
                up, low = [v for v in smooth if v > cut], [v for v in smooth if v <= cut]
                cut = (sum(up) / len(up) + sum(low) / len(low)) / 2
            if any(abs(v - cut) < 1e-9 for v in smooth):
                continue
            seeds = [i for i in range(n) if smooth[i] > cut]
        groups = [{i} for i in seeds]
        merged = True
        while merged:
            merged = False
            for x in range(len(groups)):
                for y in range(x + 1, len(groups)):
                    if any(abs(i - j) <= 4 or blocks[i][2] == blocks[j][2] for i in groups[x] for j in groups[y]):
                        groups[x] |= groups.pop(y)
                        merged = True
                        break
                if merged:
                    break
        mass = [sum(len(blocks[i][0]) for i in g) for g in groups]
        keep = {i for g, m in zip(groups, mass) if m >= 0.1 * max(mass, default=0) for i in g}
        homes = {blocks[i][2] for i in keep if not beside[i]}
        keep |= {i for i, b in enumerate(blocks) if b[2] in homes and (b[3] or not b[6]) and not beside[i]}
        for i in range(n - 2, -1, -1):
            if blocks[i][5] and not beside[i] and i + 1 in keep and blocks[i][2] == blocks[i + 1][2]:
                keep.add(i)
        kept = sorted(keep)
        for i, j in zip(kept, kept[1:]):
            if j - i <= 4:
                keep |= {k for k in range(i, j) if not beside[k]}
        assert html_text.main_text(html + "</body>") == " ".join(blocks[i][0] for i in sorted(keep)), html


def test_pages_in_spark(spark):
    df = spark.createDataFrame([(1, "u", PAGE % ("<article>", "</article>"), "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract_main_text(df).collect()}
    assert got == {(1, "u"): (TEXT, len(TEXT)), (2, None): ("", 0), (None, "v"): ("", 0)}


# ---------------------------------------------------------------- all of them

OPERATORS = {
    "shards": lambda df: sharding.shard_rows(df),
    "near copies": lambda df: ngram_join.near_copies(df),
    "pii": lambda df: pii.find_spans(df),
    "redact": lambda df: pii.redact(df),
    "packing": lambda df: packing.pack(df),
    "quality": lambda df: quality_rules.with_stats(df),
    "pieces": lambda df: piece_sampling.sample_pieces(df, digest=True),
    "fingerprints": lambda df: lz_fingerprint.fingerprints_with_next(df),
    "counts": lambda df: token_counts.token_counts(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(name, spark):
    nothing = spark.createDataFrame([], COLUMNS)
    assert OPERATORS[name](nothing).collect() == []
    odd = [(None, None), (None, "a b c d e f g"), (1, None), (1, "x y"), (1, "x y"), (2, "a b c d e f g"), (3, ""), (4, "x" * 300_000)]
    df = spark.createDataFrame([(i, t, None, None, None, None, 1, 1, 1, None, "p") for i, t in odd], COLUMNS)
    got = OPERATORS[name](df).collect()
    assert collections.Counter(r.doc_id for r in (got if name != "packing" else [p for p in got if p.start == 0])) == collections.Counter(i for i, _ in odd)


def test_odd_tables_of_filters(spark):
    """Rows that filters keep: of repeated rows one, of null ids all; short texts fail the base limits."""
    schema = COLUMNS + ", quality_stats string, component_id long, id long"
    nothing = spark.createDataFrame([], schema)
    good = " ".join(f"w{k}" for k in range(60))
    odd = [(None, None), (None, good), (1, None), (1, good), (1, good), (2, good + " x"), (3, ""), (4, "x" * 300_000)]
    df = spark.createDataFrame([(i, t, None, None, None, None, 1, 1, 1, None, "p", "q", 5, 6) for i, t in odd], schema)
    keep = quality_rules.keep_good
    assert ngram_join.keep_one(nothing).collect() == [] and keep(nothing, quality_rules.DecisionList()).collect() == []
    one = ngram_join.keep_one(df)
    assert one.columns == df.columns and sorted((r.doc_id or 0, len(r.text or "")) for r in one.collect()) == sorted([(0, 0), (0, len(good)), (1, 0), (1, len(good)), (3, 0), (4, 300_000)])
    assert sorted((r.doc_id or 0) for r in keep(df, quality_rules.DecisionList()).collect()) == [0, 1, 1, 2]
    assert quality_rules.fit(nothing, nothing.select("doc_id", F.col("n").alias("quality"))).rules == []


def test_token_files_of_odd_tables(spark, tmp_path):
    for k, rows in enumerate(([], [(None, None), (1, "x"), (1, "x"), (1, None)])):
        token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / str(k)))
        assert token_files.read_tokens(spark, str(tmp_path / str(k))).count() == len(rows)


def test_late_links_join_roots(spark):
    """Components after more links equal those of all links at once, with nodes new to both sides."""
    from quire.llm.components import connected_components
    from quire.llm.ngram_join import _joined

    early, late = [(1, 2), (2, 3), (5, 6), (8, 9)], [(3, 6), (6, 3), (10, 9), (11, 12), (1, 3)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = sorted(map(tuple, _joined(connected_components(frame(early)), frame(late)).collect()))
    assert got == [(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (8, 8), (9, 8), (10, 8), (11, 11), (12, 11)]
