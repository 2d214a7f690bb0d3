"""Importance resampling towards a target: hashed word features, log ratios of bucket counts, Gumbel noise, the highest scores.

Equal texts are one row from the start: texts are grouped whole, features are counted and weighed once for each distinct
text, its counts go into the corpus's times its copies, and weights are joined back to the documents before the noise,
which each document has for itself. Counts cover all documents; 10,000 of them, one a bucket, are known to the driver.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import join_groups, materialise, released, text_chunks, text_or_empty
from .sharding import ranked

BUCKETS = 10_000
SEED, LEAST_WORDS, PER_CENT = 7, 20, 25
STEP = 1 << 21  # bytes of a text whose features are hashed at once
LONG_WORD = 64  # bytes; longer words are summed one by one


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ 0xEDB88320, out >> 1).astype(np.uint32)
    return out


def _lower() -> np.ndarray:
    at = np.arange(256)
    return np.where((at >= 65) & (at <= 90), at + 32, at).astype(np.uint8)


CRC, LOWER = _crc_table(), _lower()
#: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text
WORD_BYTE = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in LOWER.tolist()])
ALL_ONES = np.uint32(0xFFFFFFFF)


def crc_runs(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 states (not yet inverted) after runs of data, from the given states."""
    state = state.copy()
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        run = data[starts[i] : starts[i] + lengths[i]].tobytes()
        state[i] = zlib.crc32(run, int(state[i] ^ ALL_ONES)) ^ 0xFFFFFFFF
    at, k = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORD)), 0
    while len(at):
        s = state[at]
        state[at] = CRC[(s ^ data[starts[at] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
        k += 1
        at = at[lengths[at] > k]
    return state


def feature_buckets(data: np.ndarray, ends: np.ndarray, before: int | None = None):
    """Of several texts' bytes: (text of each feature, its bucket, words of each text, state of the last word).

    before: the state of the word before the first one, where data goes on with a text begun earlier.
    """
    data = LOWER[data]
    word = WORD_BYTE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    follows = np.concatenate([[False], word[:-1]])[: len(data)] & ~cut[:-1]
    starts = np.flatnonzero(word & ~follows)
    stops = np.flatnonzero(word & ~(np.concatenate([word[1:], [False]])[: len(data)] & ~cut[1:])) + 1
    text = np.searchsorted(ends, starts, side="right")
    one = crc_runs(np.full(len(starts), ALL_ONES), data, starts, stops - starts)
    last = int(one[-1]) if len(one) else before
    first, second = one[:-1], np.arange(1, len(starts))
    same = text[:-1] == text[1:]
    first, second = first[same], second[same]
    if before is not None and len(starts):
        first, second = np.concatenate([[np.uint32(before)], first]), np.concatenate([[0], second])
    space = CRC[(first ^ np.uint32(32)) & np.uint32(255)] ^ (first >> np.uint32(8))
    two = crc_runs(space, data, starts[second], (stops - starts)[second])
    buckets = (np.concatenate([one, two]) ^ ALL_ONES) % np.uint32(BUCKETS)
    return np.concatenate([text, text[second]]), buckets.astype(np.int64), np.bincount(text, minlength=len(ends)), last


def _long_text(data: np.ndarray) -> tuple[np.ndarray, int]:
    """(count of each bucket, words) of one long text, by steps that end between words."""
    total, words, a, before, n = np.zeros(BUCKETS, np.int64), 0, 0, None, len(data)
    while a < n:
        size = STEP
        while True:
            b = min(n, a + size)
            gaps = np.flatnonzero(~WORD_BYTE[data[a:b]]) if b < n else [b - a - 1]
            if len(gaps):
                break
            size *= 2
        b = a + int(gaps[-1]) + 1
        _, buckets, own, before = feature_buckets(data[a:b], np.array([b - a]), before)
        total += np.bincount(buckets, minlength=BUCKETS)
        words, a = words + int(own[0]), b
    return total, words


def counted(column):
    """Of an Arrow column of whole texts: (words, distinct buckets of each text, the buckets, their counts)."""
    words, sizes, buckets, counts = [], [], [], []
    for _, _, data, ends in text_chunks(column):
        if len(data) > STEP and len(ends) == 1:
            total, n = _long_text(data)
            at = np.flatnonzero(total)
            words.append([n]), sizes.append([len(at)]), buckets.append(at), counts.append(total[at])
            continue
        text, bucket, own, _ = feature_buckets(data, ends)
        keys, often = np.unique(text * BUCKETS + bucket, return_counts=True)
        words.append(own), sizes.append(np.bincount(keys // BUCKETS, minlength=len(ends))), buckets.append(keys % BUCKETS), counts.append(often)
    return [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (words, sizes, buckets, counts)]


def _lists(values: np.ndarray, sizes: np.ndarray, kind):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def text_features(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of texts with n_words, n_features, and the counts of the text's buckets as two arrays.

    Features are all words and pairs of neighbouring words of the whole text, repeats counted; a null text has none. At most
    10,000 buckets are held of a text; a long one is hashed in steps of 2 MB.
    """
    rest = [c for c in texts.columns if c not in (text_col, "n_words", "n_features", "buckets", "counts")]
    rows = texts.select(F.col(text_col).cast("string").alias("__text"), *rest)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words, sizes, buckets, counts = counted(batch.column(0))
            features = np.where(words > 0, 2 * words - 1, 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(words), pa.array(features), _lists(buckets, sizes, pa.int16()), _lists(counts, sizes, pa.int32())],
                names=[*rest, "n_words", "n_features", "buckets", "counts"],
            )

    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(released(run), f"{fields}n_words bigint, n_features bigint, buckets array<smallint>, counts array<int>")


def bucket_totals(features: DataFrame, copies: Column) -> np.ndarray:
    """How often each bucket's features occur in all texts: counts times copies, summed before they are dealt."""
    each = features.select(copies.alias("c"), F.explode(F.arrays_zip("buckets", "counts")).alias("f"))
    out = np.zeros(BUCKETS, object)
    for r in each.groupBy(F.col("f.buckets").alias("b")).agg(F.sum(F.col("c") * F.col("f.counts")).alias("n")).collect():  # a row a bucket
        out[r["b"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of a bucket's shares in target and corpus)."""
    S, T = float(sum(corpus)), float(sum(target))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (S + BUCKETS) / ((float(s) + 1) * (T + BUCKETS)))) for s, t in zip(corpus, target)], np.int64)


def with_weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """features without its arrays and with `weight`, the floored mean gain of a text's features (without any: 0)."""
    rest = [c for c in features.columns if c not in ("buckets", "counts", "weight")]
    rows = features.select("n_features", "buckets", "counts", *[F.col(c).alias(f"__{i}") for i, c in enumerate(rest)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, buckets, counts = (batch.column(i) for i in range(3))
            sums = np.concatenate([[0], np.cumsum(gain[np.asarray(buckets.flatten())] * np.asarray(counts.flatten(), dtype=np.int64))])
            ends = np.concatenate([[0], np.cumsum(np.asarray(buckets.value_lengths(), dtype=np.int64))])
            n = np.asarray(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(np.diff(sums[ends]) // np.maximum(n, 1))], names=[*rest, "weight"])

    fields = "".join(f"`{c.replace('`', '``')}` {features.schema[c].dataType.simpleString()}, " for c in rest)
    return rows.mapInArrow(released(run), f"{fields}weight bigint")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document, times 1000 and floored, from the first 32 bits of a hash of seed and id (a null id: an empty one)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = SEED, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """One row for each row of docs: (doc_id, n_words, n_features, weight, score, rank); rank is null for those not drawn.

    Of the rows with least_words words, per_cent in a hundred are drawn, the highest scores first, ties to the smaller id
    (null first). A null text has no words. Rows with equal id and text are drawn on their own, at neighbouring ranks. An
    empty docs gives no rows; with an empty target, weights come from the corpus alone. Other columns are ignored.
    """
    key = F.sha2(F.col("text"), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    texts = rows.groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", key)
    features = materialise(text_features(texts), "features")
    gain = gains(bucket_totals(features, F.col("copies")), bucket_totals(text_features(target.select(F.col(target_col).alias("text"))), F.lit(1)))
    weights = materialise(with_weights(features, gain), "weights")
    able = weights.where(F.col("n_words") >= least_words).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    scored = join_groups(rows.select("doc_id", key.alias("key")), weights, "key", "copies").drop("key")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumn("__out", F.col("n_words") < least_words).withColumn("__back", -F.col("score"))
    order = ranked(scored, ["__out", "__back", "doc_id"])
    drawn = ~F.col("__out") & (F.col("rank") < able * per_cent // 100)
    return order.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("rank") + 1).cast("long").alias("rank"))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The drawn rows of docs with all their columns; ids must be unique, or an error is raised before anything is drawn."""
    seen = docs.agg(F.count("*").alias("rows"), F.count_distinct(id_col).alias("ids")).first()
    if seen["rows"] != seen["ids"]:
        raise ValueError(f"{id_col} holds nulls or repeated values")
    chosen = resample(docs, target, id_col, **how).where("rank is not null").select(F.col("doc_id").alias("__drawn"))
    return docs.join(chosen, docs[id_col] == F.col("__drawn"), "left_semi")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def _oracle() -> str:
    table = ", ".join(map(str, CRC.tolist()))
    crc = f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: cast('0x' || x as bigint))), lambda c, b: xor(c >> 8, tab[cast(xor(c & 255, b) as int) + 1])), 4294967295)"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
with k as (select cast([{table}] as bigint[]) as tab),
x as (select true as own, doc_id, {words} as w from documents union all select false, item_id, {words} from benchmark),
d as (select *, row_number() over () as r, greatest(2 * len(w) - 1, 0) as n from x),
e as (select own, r, unnest(list_concat(w, {pairs})) as f from d where n > 0),
c as materialized (select own, r, f, count(*) as n from e group by all),
b as materialized (select f, {crc} % 10000 as b from (select distinct f from c) cross join k),
t as materialized (select b, coalesce(sum(n) filter (own), 0) as s, coalesce(sum(n) filter (not own), 0) as t from c join b using (f) group by b),
a as (select sum(s) as ss, sum(t) as tt from t),
g as materialized (select b, cast(floor(1000 * ln((t + 1.0::double) * (ss + 10000.0::double) / ((s + 1.0::double) * (tt + 10000.0::double)))) as bigint) as gain from t cross join a),
m as (select r, sum(n * gain) as total from c join b using (f) join g using (b) where own group by r),
p as (select doc_id, len(w) as n_words, cast(d.n as bigint) as n_features, cast(case when d.n = 0 then 0 else floor(total / d.n) end as bigint) as weight,
  cast('0x' || substring(sha256('{SEED}:' || doc_id), 1, 8) as bigint) as h from d left join m using (r) where own),
q as (select doc_id, n_words, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))) as bigint) as score from p),
z as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as able from q where n_words >= {LEAST_WORDS})
select doc_id, n_features, weight, score, cast(case when rank <= {PER_CENT} * able // 100 then rank end as double) as rank from q left join z using (doc_id)"""


QUERIES = {"op12_importance": op12_importance}
ORACLES = {"op12_importance": _oracle()}
