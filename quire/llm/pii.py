"""Personal data: regular expressions propose spans, validators confirm them, nearby context words adjust their score.

DataFrame functions only. A pattern's matches come from regexp_extract_all and the gaps between them from split, whose
lengths add up to the spans' places in code points. The patterns use possessive repeats and look-behinds so that one scan
takes linear time on any text and matches the same spans as the plain patterns in the comments. Sums along a text's matches
go by blocks, and context and replacement cut the text's blocks, so the time is nearly linear in the spans of a text too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import text_or_empty

#: kind, pattern, cheap test of the whole text, score, context words
KINDS = [
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; a run of local characters is tried once, or from where the last match ended
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "e-?mail|mailto|contact|correo|courriel"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|host|server|address|addr"),
    # [0-9]([\x20-]?[0-9])+ ; of its matches, which are whole runs, those of 13 to 19 digits
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", "", 0.7, "card|visa|master|credit|karte|carte|tarjeta"),
    # \+[0-9][\x20().0-9-]+[0-9]
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobil|fax|llame"),
    # added by the method: IBAN with its mod-97 checksum
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.7, "iban|account|bank|konto|compte|cuenta"),
    # added by the method: no checksum, so that it counts only beside its context words
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, r"\bssn\b|social security"),
]
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS, CONTEXT_SCORE, LEAST_SCORE = 40, 0.2, 0.6


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    back = F.reverse(digits)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN (capitals and digits only) leaves 1 by ISO 7064."""
    turned = F.concat(code.substr(F.lit(5), F.length(code)), code.substr(1, 4))

    def add(rest, i):
        v = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(v >= 65, (rest * 100 + v - 55) % 97).otherwise((rest * 10 + v - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        bare = F.replace(v, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["value"])


SCAN, DEPTH = 64, 3  # elements that are folded at a time, and levels of such blocks; a fold copies what it has so far
BLOCK = 256  # code points of a block of a text


def _let(value: str, name: str, body: str) -> str:
    """body, where name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scan(values: str, op: str, depth: int = DEPTH) -> str:
    """Of an array of ints from 0 up: for each place, `op` over all values before it, 0 for the first; by blocks of SCAN. SQL."""
    v, w, s = f"v{depth}", f"w{depth}", f"s{depth}"

    def folded(x):
        return f"aggregate({x}, named_struct('a', 0, 'out', cast(array() as array<int>)), (acc, x) -> named_struct('a', {op.format(a='acc.a')}, 'out', concat(acc.out, array(acc.a))))"

    if not depth:
        return folded(values) + ".out"
    starts = scan(f"transform({w}, b -> b.a)", op, depth - 1)
    whole = f"flatten(zip_with({w}, {starts}, (b, {s}) -> transform(b.out, x -> {op.format(a=s)})))"
    blocks = f"transform(sequence(1, size({v}), {SCAN}), i -> {folded(f'slice({v}, i, {SCAN})')})"
    return _let(values, v, f"case when size({v}) <= {SCAN} then {folded(v)}.out else {_let(blocks, w, whole)} end")


SUM, MAXIMUM = "{a} + x", "greatest({a}, x)"


def text_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: str, a: str, b: str) -> str:
    """The code points [a, b) of a text in blocks; what is read is no more than that and a block on each side. SQL."""
    first = f"cast(({a}) div {BLOCK} as int)"
    held = f"array_join(slice({blocks}, {first} + 1, greatest(cast((({b}) + {BLOCK - 1}) div {BLOCK} as int) - {first}, 0)), '')"
    return f"case when ({b}) > ({a}) then substring({held}, cast(({a}) % {BLOCK} as int) + 1, ({b}) - ({a})) else '' end"


def _placed(found: str, gaps: str) -> str:
    """Matches and the pieces between them to structs (start, end, value). SQL."""
    pairs = f"zip_with({found}, slice({gaps}, 1, size({found})), (v, g) -> named_struct('value', v, 'gap', length(g), 'n', length(v)))"
    spans = "transform(p, (x, i) -> named_struct('start', get(before, i) + x.gap, 'end', get(before, i) + x.gap + x.n, 'value', x.value))"
    return _let(pairs, "p", _let(scan("transform(p, x -> x.gap + x.n)", SUM), "before", spans))


def find_spans(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """df with `out`: an array of (kind, start, end, value, score), by kind in the order of KINDS, then by start.

    Places are code points, the end exclusive. A null or empty text has none, repeated rows have equal ones, an empty table
    gives no rows. Very long texts are read whole, in time nearly linear in their length and their spans. Base kinds are kept
    whatever their score; the others need LEAST_SCORE. All other columns stay as they are; the working columns begin with
    __pii and are dropped.
    """
    df = df.withColumn("__pii", text_or_empty(text_col))
    text = F.col("__pii")
    raw = {}
    for kind, pattern, sign, _, _ in KINDS:
        may = F.contains(text, F.lit(sign)) if sign else F.lit(True)
        may = may & text.rlike("[0-9]") if kind in ("card", "iban") else may
        raw[f"__pii_{kind}"] = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = {f"__pii_{kind}_gaps": F.when(F.size(f"__pii_{kind}") > 0, F.split(text, pattern, -1)) for kind, pattern, *_ in KINDS}
    df = df.withColumns(raw).withColumns(gaps)
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    df = df.withColumns({f"__pii_{k}": F.when(F.col(f"__pii_{k}_gaps").isNotNull(), F.filter(F.expr(_placed(f"__pii_{k}", f"__pii_{k}_gaps")), _check(k))).otherwise(empty) for k, *_ in KINDS})
    some = F.lit(False)
    for kind, *_ in KINDS:
        some = some | (F.size(f"__pii_{kind}") > 0)
    df = df.withColumn("__pii_blocks", F.when(some, text_blocks(text)))

    def scored(kind: str, score: float, words: str) -> Column:
        before = piece("__pii_blocks", f"greatest(s.start - {CONTEXT_CHARS}, 0)", "s.start")
        near = f"concat({before}, ' ', {piece('__pii_blocks', 's.end', f's.end + {CONTEXT_CHARS}')})"
        points = f"round({score}D + case when {near} rlike r'(?i){words}' then {CONTEXT_SCORE}D else 0.0D end, 2)"
        return F.expr(f"transform(__pii_{kind}, s -> named_struct('kind', '{kind}', 'start', s.start, 'end', s.end, 'value', s.value, 'score', {points}))")

    parts = []
    for kind, _, _, score, words in KINDS:
        some = scored(kind, score, words)
        parts.append(some if kind in BASE else F.filter(some, lambda s: s["score"] >= LEAST_SCORE))
    return df.withColumn(out, F.concat(*parts)).drop("__pii", "__pii_blocks", *[f"__pii_{k[0]}{x}" for k in KINDS for x in ("", "_gaps")])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each span of its text replaced by its kind, as [EMAIL]; of overlapping spans the first one's kind stands for all.

    Null texts stay null, texts without spans as they are. All other columns stay; repeated rows, an empty table and very long
    texts as in find_spans.
    """
    df = find_spans(df, text_col, "__spans")
    order = F.expr("array_sort(transform(__spans, s -> named_struct('start', s.start, 'back', -s.end, 'kind', s.kind)))")
    text, some = text_or_empty(text_col), F.size("__spans") > 0
    df = df.withColumns({"__order": F.when(some, order), "__blocks": F.when(some, text_blocks(text)), "__length": F.length(text)})
    df = df.withColumn("__covered", F.when(some, F.expr(scan("transform(__order, s -> -s.back)", MAXIMUM))))  # to where the spans before each one reach
    told = f"case when s.start >= get(__covered, i) then concat({piece('__blocks', 'get(__covered, i)', 's.start')}, '[', upper(s.kind), ']') else '' end"
    last = "greatest(element_at(__covered, -1), -element_at(__order, -1).back)"
    done = F.expr(f"concat(array_join(transform(__order, (s, i) -> {told}), ''), {_let(last, 'z', piece('__blocks', 'z', '__length'))})")
    return df.withColumn(text_col, F.when(some, done).otherwise(F.col(text_col))).drop("__spans", "__order", "__blocks", "__length", "__covered")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_spans(docs).drop("text")
    count = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *count, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def _oracle() -> str:
    """The same in SQL whose patterns have no look-around: plain ones, with the neighbours of added kinds tested afterwards."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(generate_series(1, length({digits})), lambda i: case when i % 2 = 1 then cast(reverse({digits})[i] as int) else cast(reverse({digits})[i] as int) * 2 - case when cast(reverse({digits})[i] as int) > 4 then 9 else 0 end end)) % 10 = 0"
    bare = "replace(v, ' ', '')"
    turned = f"(substring({bare}, 5) || substring({bare}, 1, 4))"
    mod97 = f"list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split({turned}, ''), lambda c: cast(case when c between 'A' and 'Z' then ascii(c) - 55 else ascii(c) - 48 end as bigint))), lambda r, x: case when x > 9 then (r * 100 + x) % 97 else (r * 10 + x) % 97 end) = 1"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 or cast('0' || right(x, 3) as int) > 255)) = 0",
        "card": f"length({digits}) between 13 and 19 and {luhn}",
        "phone": f"length({digits}) between 9 and 15",
        "iban": f"length({bare}) between 15 and 34 and {mod97}",
        "ssn": "not regexp_matches(substring(t, cast(a as bigint), case when a > 0 then 1 else 0 end) || 'x' || substring(t, cast(a + length(v) + 1 as bigint), 1), '[0-9-]')",
    }
    found = " union all ".join(f"select doc_id, t, {k} as k, '{kind}' as kind, {score} as score, '{words}' as words, regexp_extract_all(t, '{plain[kind]}') as m, string_split_regex(t, '{plain[kind]}') as g from d" for k, (kind, _, _, score, words) in enumerate(KINDS))
    checked = " ".join(f"when '{kind}' then {rule}" for kind, rule in valid.items())
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)
    one = "kind || ':' || a || ':' || (a + length(v))"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), f as ({found}),
u as (select doc_id, t, k, kind, score, words, unnest(m) as v, unnest(g[1 : len(m)]) as gap, generate_subscripts(m, 1) as i from f where len(m) > 0),
p as (select *, cast(sum(length(gap)) over (partition by doc_id, k order by i) + coalesce(sum(length(v)) over (partition by doc_id, k order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as a from u),
c as (select *, round(score + case when regexp_matches(substring(t, greatest(a - {CONTEXT_CHARS}, 0) + 1, a - greatest(a - {CONTEXT_CHARS}, 0)) || ' ' || substring(t, a + length(v) + 1, {CONTEXT_CHARS}), '(?i)' || words) then {CONTEXT_SCORE} else 0.0 end, 2) as points from p where case kind {checked} end),
s as (select * from c where kind in ({base}) or points >= {LEAST_SCORE}),
j as (select doc_id, {counts}, string_agg({one}, ',' order by k, a) filter (kind in ({base})) as base, string_agg({one}, ',' order by k, a) as spans, string_agg(cast(cast(points as double) as varchar), ',' order by k, a) as scores from s group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores from d left join j on j.doc_id = d.doc_id"""


QUERIES = {"op3_pii": op3_pii}
ORACLES = {"op3_pii": _oracle()}
