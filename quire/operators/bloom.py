"""A filter in front of a cache of many keys: most keys that it doesn't hold are told without a shuffle, and no answer changes.

The filter is a Bloom filter kept as a table of words of bits, so that it is built by partial aggregates, merged with what
new keys add, and written beside an append-only cache. To be asked it is broadcast, which its size bounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..views import duck, table

QUERIES, ORACLES = {}, {}
PER_KEY, HASHES = 10, 7  # bits a key, and of these how many are set: one in a hundred keys that aren't there passes
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 31  # the greatest filter takes 256 MB; with more keys than it suits, more keys pass


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, duck(sql)
        return f

    return add


def bits_for(n: int) -> int:
    """The power of two that suits n keys."""
    return min(max(LEAST_BITS, 1 << max(PER_KEY * n - 1, 1).bit_length()), MOST_BITS)


def _hashes(key: Column) -> list[Column]:
    """Two 64-bit hashes of a key, of which all its places follow."""
    return [F.xxhash64(key), F.xxhash64(key, F.lit(1))]


def words(keys: DataFrame, bits: int, key: str = "key") -> DataFrame:
    """(word, bits): the words of the filter of keys that aren't zero; null keys are none."""
    h = keys.where(F.col(key).isNotNull()).select(*[x.alias(f"h{i}") for i, x in enumerate(_hashes(F.col(key)))])
    places = F.array(*[F.pmod(F.col("h0").bitwiseXOR(F.shiftrightunsigned("h0", 32)) % bits + F.lit(i) * (F.col("h1") % bits), F.lit(bits)) for i in range(HASHES)])
    at = h.select(F.explode(places).alias("at"))
    return at.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """The filter of the keys of two filters of the same size."""
    return one.unionByName(other).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def marked(rows: DataFrame, filter_: DataFrame, bits: int, key: str = "key", name: str = "maybe") -> DataFrame:
    """rows with `name`: whether the filter may hold their key. A null key is nowhere."""
    table_ = np.zeros(bits // 64, np.int64)
    for r in filter_.toLocalIterator():  # MOST_BITS at most
        table_[r["word"]] = r["bits"]
    held = rows.sparkSession.sparkContext.broadcast(table_)
    names = [c for c in rows.columns if c != name]
    hashed = rows.select(*names, *[x.alias(f"__h{i}") for i, x in enumerate(_hashes(F.col(key)))], F.col(key).isNotNull().alias("__known"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            h0, h1 = (np.asarray(batch.column(len(names) + i)) for i in range(2))
            known = batch.column(len(names) + 2).to_numpy(zero_copy_only=False)
            # as in `words`: remainders have the sign of what is divided
            first = np.fmod(h0 ^ (h0.view(np.uint64) >> np.uint64(32)).view(np.int64), bits)
            step, maybe = np.fmod(h1, bits), known.astype(bool)
            for i in range(HASHES):
                at = np.mod(first + i * step, bits)
                maybe &= (held.value[at >> 6] >> (at & 63) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(maybe)], names=[*names, name])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in hashed.schema.fields[: len(names)])
    return hashed.mapInArrow(run, f"{fields}, {name} boolean")


def looked_up(jobs: DataFrame, cache: DataFrame, filter_: DataFrame, bits: int, key: str = "key") -> DataFrame:
    """jobs with the columns of cache, which has one row a key; only jobs whose key the filter may hold meet the cache."""
    asked = marked(jobs, filter_, bits, key, "__maybe")
    found = asked.where("__maybe").drop("__maybe").join(cache, key, "left")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in cache.schema.fields if f.name != key]
    return found.unionByName(asked.where("not __maybe").select(*[F.col(c) for c in jobs.columns], *none))


@query("""
with k as (select doc_id, sha1(text || 'page') as key from documents), c as (select key, min(doc_id) as first_doc from k where doc_id % 3 = 0 group by key)
select k.doc_id, cast(c.first_doc as double) as first_doc from k left join c on c.key = k.key""")
def filtered_cache(spark: SparkSession, d: str) -> DataFrame:
    """Jobs met with a cache behind its filter; here the cache holds the answers of every third document."""
    jobs = table(spark, d, "documents").select("doc_id", X.content_key(F.col("text"), F.lit("page")).alias("key"))
    cache = jobs.where("doc_id % 3 = 0").groupBy("key").agg(F.min("doc_id").alias("first_doc"))
    bits = bits_for(cache.count())
    return looked_up(jobs, cache, words(cache, bits), bits).select("doc_id", "first_doc")
