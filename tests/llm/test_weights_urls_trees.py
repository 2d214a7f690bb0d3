"""URL filters, importance resampling and Merkle manifests against brute force, with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import common, importance, merkle, url_filter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- groups met by their keys

def test_join_groups(spark):
    rng = random.Random(3)
    keys = ["hot"] * 400 + [None] * 50 + [f"k{rng.randrange(40)}" for _ in range(200)] + ["alone"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k string").repartition(5)
    of = collections.Counter(keys)
    of.pop("alone")
    groups = spark.createDataFrame([(k, n, f"v{k}") for k, n in of.items()], "k string, n long, v string").cache()
    got = sorted((r["i"], r["k"], r["v"]) for r in common.join_groups(rows, groups, "k", "n").collect())
    assert got == [(i, k, f"v{k}" if k != "alone" else None) for i, k in enumerate(keys)]
    assert common.join_groups(rows, groups.limit(0), "k", "n").where("v is null").count() == len(keys)


# ---------------------------------------------------------------- 11

URLS = [
    ("https://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    ("http://a.www.example.com/en/q", "a.www.example.com", "/en/q", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://x.net/es/a#/b", "x.net", "/es/a", "net/es/", "block"),
    ("http://x.net/es", "x.net", "/es", None, None),
    ("http://x.com", "x.com", "", None, None),
    ("http://x.com?/en/", "x.com", "", None, None),
    ("//x.com/", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("http://ÄB.net/fr/ü", "Äb.net", "/fr/ü", "net/fr/", "block"),
]


def test_url_parts_and_rules(spark):
    rows = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(rows, spark.createDataFrame([], "id long, bad boolean")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow")
    with pytest.raises(ValueError):
        url_filter.fitting_rule(F.lit(""), F.lit(""), [(f"h{i}", "/", "block") for i in range(1001)])


def shrink(groups):
    """groups: {key: (n, bad, mean above)} to {key: (mean, alpha + beta)}."""
    num = sum((b - n * m) ** 2 - n * m * (1 - m) for n, b, m in groups.values() if n)
    den = sum(n * (n - 1) * m * (1 - m) for n, b, m in groups.values() if n)
    w = round(1 / min(max(num / den, 1 / 1001), 1 / 2) - 1, 6) if den > 0 else 10.0
    return {k: ((w * m + b) / (w + n), w + n) for k, (n, b, m) in groups.items()}


def levels(host):
    name = re.sub(r"^[^@]*@|:[0-9]*\Z|\.\Z", "", host)
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", name):
        return name, ""
    parts = name.split(".")
    k = 2 if ".".join(parts[-2:]) in url_filter.SUFFIXES else 1
    return ".".join(parts[-k - 1 :]), ".".join(parts[-k:])


def brute_reputation(pages, outcomes):
    told = {}
    for i, bad in outcomes:
        if i is not None and bad is not None:
            told[i] = told.get(i, False) or bad
    hosts = collections.defaultdict(lambda: [0, 0])
    for i, h in set(pages):
        hosts[h]
        if i in told:
            hosts[h][0] += 1
            hosts[h][1] += told[i]

    def sums(keys):
        out = collections.defaultdict(lambda: [0, 0])
        for h, (n, b) in hosts.items():
            out[keys(h)][0] += n
            out[keys(h)][1] += b
        return out

    n, b = (sum(v[k] for v in hosts.values()) for k in (0, 1))
    top = (b + 0.5) / (n + 1)
    suffix = shrink({k: (*v, top) for k, v in sums(lambda h: levels(h)[1]).items()})
    domain = shrink({k: (*v, suffix[k[1]][0]) for k, v in sums(levels).items()})
    own = shrink({h: (*v, domain[levels(h)][0]) for h, v in hosts.items()})
    return {h: (*hosts[h], m, max(m - 1.645 * math.sqrt(m * (1 - m) / (ab + 1)), 0)) for h, (m, ab) in own.items()}


def test_reputations(spark):
    rng = random.Random(8)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m", "blog") for b in ("good", "bad", "mixed", "few") for c in ("com", "co.uk", "net")] + ["1.2.3.4", "u@x.org:80", "", "localhost"]
    pages, outcomes = [], []
    for i in range(3000):
        h = "www.good.com" if rng.random() < 0.33 else rng.choice(hosts)
        pages.append((i, f"http://{h}/p{i}" if h else "none"))
        share = 0.95 if ".bad." in h else 0.3 if ".mixed." in h else 0.05
        if rng.random() < (0.01 if ".few." in h else 0.4):
            outcomes.append((i, rng.random() < share))
    pages += pages[:20] + [(None, "http://www.bad.com/"), (None, "http://www.bad.com/"), (5, "http://m.bad.com/")]
    outcomes += outcomes[:30] + [(None, True), (outcomes[0][0], None), (10**9, True)]
    df = spark.createDataFrame([(*p, "clash", 1.0) for p in pages], "page_id long, url string, host string, bad_bound double").repartition(6)
    told = spark.createDataFrame(outcomes, "id long, bad boolean")
    got = url_filter.judge(df, told, rules=[]).collect()
    host = {u: re.sub(r"^.*?://([^/]*).*", r"\1", u) if "://" in u else "" for _, u in pages}
    want = brute_reputation([(i, host[u]) for i, u in pages], outcomes)
    assert len(got) == len(pages)
    assert collections.Counter((r["page_id"], r["url"]) for r in got) == collections.Counter(pages)
    for r in got:
        n, b, m, bound = want[host[r["url"]]]
        assert (r["host"], r["n_labelled"], r["n_bad"]) == (host[r["url"]], n, b)
        assert abs(r["bad_mean"] - m) < 2e-6 and abs(r["bad_bound"] - bound) < 2e-6
        assert r["verdict"] == ("block" if round(bound, 6) > 0.5 else "allow") and r["rule"] is None
    blocked = {r["host"] for r in got if r["verdict"] == "block"}
    assert blocked and all(".bad." in h for h in blocked)  # few or mixed outcomes block nothing
    kept = url_filter.keep_allowed(df, told, rules=[])
    assert kept.columns == df.columns and kept.where("host = 'clash'").count() == sum(r["verdict"] == "allow" for r in got)
    assert url_filter.judge(df.limit(0), told).count() == 0 and url_filter.judge(df, told.limit(0), rules=[]).where("verdict = 'allow'").count() == len(pages)


def test_url_filter_stays_in_the_engine(spark, data):
    plan = url_filter.op11_url_filter(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "html" not in plan.split("Physical Plan")[1]


# ---------------------------------------------------------------- 12

def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute_resample(docs, target):
    def totals(texts):
        return collections.Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])

    s, t = totals(x for _, x in docs), totals(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[zlib.crc32(v.encode()) % 10000] for v in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def text_rows():
    rng, out = random.Random(4), []
    for i in range(300):
        n = rng.choice([0, 1, 5, 19, 20, 21, 60, 200])
        out.append((i, rng.choice([" ", "\n", ", ", "-"]).join(rng.choice(["Wort", "été", "THE", "x1", "日本", "a_b", "\u2028", f"w{rng.randrange(500)}"]) for _ in range(n))))
    same = " ".join(f"copy{i}" for i in range(40))
    out += [(1000 + i, same) for i in range(200)] + [(2000, None), (2001, ""), (2002, " .;"), (2003, "z" * 100_000 + " end"), (2004, "a" * 64 + " " + "b" * 65), (None, same), (3, "twice the id " * 10), (3, "twice the id " * 10)]
    return out


def test_resample_is_brute_force(spark):
    rows = text_rows()
    df = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, weight int, `rank` string, key int").repartition(6)
    target = [" ".join(f"w{i} w{i + 1}" for i in range(0, 80)), None, "The été"]
    to = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, to).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_resample(rows, target)
    assert importance.resample(df.limit(0), to).count() == 0 and importance.resample(df, to.limit(0)).count() == len(rows)
    with pytest.raises(ValueError):
        importance.draw(df, to)
    alone = df.where("doc_id >= 1000 and doc_id <> 2003")
    assert importance.draw(alone, to).columns == df.columns and importance.draw(alone, to).count() == 50


def test_long_texts_go_by_steps():
    rng = random.Random(2)
    text = " ".join("w" * rng.randrange(1, 9) + str(rng.randrange(10**5)) for _ in range(40_000)) + " " + "y" * 50_000 + " é" * 1000
    raw, step = np.frombuffer(text.encode(), np.uint8), importance.STEP
    try:
        importance.STEP = 10_000
        total, n = importance._long_text(raw)
    finally:
        importance.STEP = step
    want = features(text)
    assert n == want[0] and {b: c for b, c in enumerate(total.tolist()) if c} == dict(collections.Counter(zlib.crc32(f.encode()) % 10000 for f in want[1]))


# ---------------------------------------------------------------- 13

def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_merkle(rows, changed):
    """rows: (doc_id, source, lang, n_chars, text) to sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    leaf = lambda r: H("".join(map(field, r)))
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0], leaf(r), leaf((*r[:4], changed(r)))))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    paths, subroots = {}, []

    def climb(nodes, members):
        while len(nodes) > 1:
            up, moved = [], []
            for a in range(0, len(nodes), 8):
                run = nodes[a : a + 8]
                for k in range(len(run)):
                    for m in members[a + k]:
                        paths[m].append((run[:k], run[k + 1 :]))
                up.append(H("".join(run)))
                moved.append([m for ms in members[a : a + 8] for m in ms])
            nodes, members = up, moved
        return nodes[0]

    held = []
    for t in order:
        own = sorted(trees[t], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        for k in range(len(own)):
            paths[t, k] = []
        subroots.append(climb([x[1] for x in own], [[(t, k)] for k in range(len(own))]))
        held.append(own)
    root = climb(subroots, [[(t, k) for k in range(len(own))] for t, own in zip(order, held)])
    out = []
    for t, own, sub in zip(order, held, subroots):
        for k, (doc, a, b) in enumerate(own):
            proof, node = "", b
            for before, after in paths[t, k]:
                proof += "".join(before + after)
                node = H("".join(before) + node + "".join(after))
            out.append((doc, a, sub, root, H(proof), node, node == root))
    return sorted(out, key=str)


def tree_rows(n, langs, seed):
    rng = random.Random(seed)
    out = [(i, rng.choice(["s", None, "ü"]), rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", "Abc", "xyz é", "ÄB C" * 50])) for i in range(n)]
    return out + out[:5] + [(None, None, langs[0], None, None), (None, None, langs[0], None, "T")]


@pytest.mark.parametrize("n,langs,levels,top", [(700, ["en", None, "de", "fr"], 4, 1 << 16), (700, ["en"] * 9 + ["de", None], 1, 3), (300, [f"l{i}" for i in range(150)], 1, 4), (80, ["x"], 2, 1), (1, ["q"], 4, 10)])
def test_manifest_is_brute_force(spark, n, langs, levels, top):
    rows = tree_rows(n, langs, n + levels)
    df = spark.createDataFrame([(*r, "c", 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, path string, n int").repartition(5)
    third = lambda i: zlib.crc32(str(i).encode()) % 3 == 0 if i is not None else False
    other = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.translate("text", merkle.CAPITALS, merkle.SMALL)).otherwise(F.col("text"))
    got = merkle.manifest(df, other={"text": other}, levels=levels, top=top, proofs=True).collect()
    want = brute_merkle(rows, lambda r: r[4].translate(LOW) if r[4] is not None and third(r[0]) else r[4])
    assert sorted((tuple(r)[:7] for r in got), key=str) == want
    for r in got:
        proof = [(p["before"], p["after"]) for p in r["proof"]]
        assert merkle.fold(r["leaf"], proof) == r["root"] and H("".join(a + b for a, b in proof)) == r["proof_sha256"]


def test_manifest_of_little(spark):
    df = spark.createDataFrame([(7, None, None, None, "only")], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(df.limit(0)).count() == 0 and merkle.manifest(df.limit(0), proofs=True).columns[-1] == "proof"
    r = merkle.manifest(df).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == H("") and r["verified"]
    long = spark.createDataFrame([(1, "s", "en", 1, "ab" * 2_000_000)], df.schema)
    assert merkle.manifest(long).first()["leaf"] == H("1:11:s2:en1:1" + field("ab" * 2_000_000))
