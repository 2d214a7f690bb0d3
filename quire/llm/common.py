"""What the operators of this package share: the shared folder, word hashing, Hilbert keys, tokenizer files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import clear, materialise, shared_dir, shared_path  # noqa: F401

def partitions(df: DataFrame) -> int:
    """How many partitions a keyed exchange of rows as heavy as df's should have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def count_below(bounds: list[int], x: Column) -> Column:
    """How many of the sorted whole numbers lie below x, by binary search over one array literal."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to a literal by the optimizer
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.try_element_at(table, at + step) < x), at + step).otherwise(at))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the columns of groups, which has one row a key (a null key meets a null one); rows whose key has none get nulls.

    groups.count is the number of rows of a key. A key with more than an even share of them is dealt over several tasks: it is
    marked by a broadcast of such keys, fewer than four a partition, and its group is repeated for each share. groups is
    read three times, so it should be a written table; of its columns all but key and count are added.
    """
    parts = 4 * partitions(rows)
    total = groups.agg(F.sum(count)).first()[0] or 0
    shares = F.ceil(F.col(count) / max(total // parts, 1)).cast("int")
    often = groups.select(F.col(key).alias("__often"), shares.alias("__of")).where("__of > 1")
    dealt = rows.join(F.broadcast(often), F.col(key).eqNullSafe(F.col("__often")), "left").drop("__often")
    dealt = dealt.withColumn("__share", F.pmod(F.monotonically_increasing_id(), F.coalesce("__of", F.lit(1)).cast("long"))).drop("__of")
    each = groups.withColumn("__share_of", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(shares.cast("long"), F.lit(1)) - 1))).withColumnRenamed(key, "__key")
    met = dealt.join(each, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__share") == F.col("__share_of")), "left")
    return met.drop("__share", "__share_of", "__key", count)


def by_ranges(df: DataFrame, column: Column, parts: int, name: str = "range", tie: Column | None = None) -> DataFrame:
    """df with the number of each row's range of a whole-number column, from 0; the ranges are cut at its quantiles. Nulls lie in the first.

    One aggregate over the column alone finds the cuts, so wide rows aren't read twice. A value that fills whole ranges by
    itself (null, say) is dealt over them by the hash of `tie`, if given, in the order of the ranges.
    """
    at = F.coalesce(column, F.lit(-(1 << 63)))
    shares = [i / parts for i in range(1, parts)]
    cuts = df.agg(F.percentile_approx(at, shares, max(10_000, 20 * parts)).alias("c")).first()["c"] if shares else None
    cuts = sorted(map(int, cuts or ()))
    df = df.withColumn("__at", at)
    place = count_below(cuts, F.col("__at"))
    often = {c: cuts.count(c) for c in set(cuts)} if len(set(cuts)) < len(cuts) else {}
    if tie is not None and (often := {c: k for c, k in often.items() if k > 1}):  # parts of them at most
        wide = F.map_from_arrays(F.array(*[F.lit(c).cast("long") for c in often]), F.array(*[F.lit(k) for k in often.values()]))
        place = place + F.coalesce(F.pmod(F.xxhash64(tie), F.try_element_at(wide, F.col("__at"))).cast("int"), F.lit(0))
    return df.withColumn(name, place).drop("__at")


def released(run):
    """run over a task's batches, after which the worker, which lives on, gives back what its allocators hold beyond their use."""

    def go(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return go


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# ---------------------------------------------------------------- words and their hashes (numpy)

M64 = (1 << 64) - 1
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(fold: bool) -> np.ndarray:
    at = np.arange(256)
    if fold:
        at = np.where((at >= 65) & (at <= 90), at + 32, at)
    out = mix(at.astype(np.uint64) + np.uint64(0x5157)) | np.uint64(1)
    out[[32, 9, 10, 11, 12, 13]] = 0
    return out


VALUES, VALUES_FOLDED = _byte_values(False), _byte_values(True)
IS_WORD = VALUES != 0
_powers: list[np.ndarray] = []


STEP = 1 << 18  # positions that are hashed at once


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n, which is STEP at most in what follows."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, p, np.uint64)]), dtype=np.uint64) for p in (_PRIME, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def segment_hashes(n: int, values, starts: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each segment of n positions; values(a, b): those of positions a to b; zeros count for nothing.

    Segments begin at `starts` and end where the next begins. STEP positions are held at a time, however long a segment is.
    """
    out = np.zeros(len(starts), np.uint64)
    up, down = powers(min(n, STEP))
    for a in range(0, n, STEP):
        b = min(n, a + STEP)
        k = max(int(np.searchsorted(starts, a, side="right")) - 1, 0)
        own = starts[k : int(np.searchsorted(starts, b))]
        if not len(own):
            continue
        at = np.maximum(own - a, 0)
        sums = np.add.reduceat(values(a, b) * up[: b - a], at) * down[at]
        if own[0] < a:
            sums[:1] *= np.uint64(pow(int(_PRIME), a - int(own[0]), 1 << 64))
        out[k : k + len(own)] += sums
    return mix(out)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of several texts: `hashes` of all words, `first[d]:first[d + 1]` those of text d."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, fold: bool):
        """data: the texts' bytes, one after the other; ends: where each text ends."""
        word = IS_WORD[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        begins = np.concatenate([[0], ends[:-1]])
        begins = begins[begins < len(data)]
        begin[begins] = word[begins]
        self.starts = np.flatnonzero(begin)
        self.is_word = word
        table = VALUES_FOLDED if fold else VALUES
        self.hashes = segment_hashes(len(data), lambda a, b: table[data[a:b]], self.starts)
        self.first = np.concatenate([[0], np.searchsorted(self.starts, ends, side="left")])


def text_chunks(column, most: int = 1 << 18):
    """Of an Arrow string column: (row range, bytes, ends of its texts), about `most` bytes at a time; nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]
        a = b


def list_column(values: np.ndarray, lengths, kind):
    """An Arrow list column of consecutive runs of values."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# ---------------------------------------------------------------- Hilbert keys

def hilbert_column(cells: list[Column], bits: int) -> Column:
    """The Hilbert curve index of integer cells below 2**bits, as a long; higher-order SQL functions only (Skilling's transform)."""
    n = len(cells)
    if n * bits > 62:
        raise ValueError("dimensions times bits must be at most 62")
    x = F.array(*[F.coalesce(c, F.lit(0)).cast("long") for c in cells])
    steps = F.array(*[F.struct(F.lit(1 << q).cast("long").alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def undo(a, s):
        p, xi, x0 = s["q"] - 1, F.element_at(a, s["i"] + 1), F.element_at(a, 1)
        swap = x0.bitwiseXOR(xi).bitwiseAND(p)
        return F.when(
            xi.bitwiseAND(s["q"]) != 0, F.transform(a, lambda v, k: F.when(k == 0, v.bitwiseXOR(p)).otherwise(v))
        ).otherwise(F.transform(a, lambda v, k: F.when((k == 0) & (s["i"] != 0), v.bitwiseXOR(swap)).when((k == s["i"]) & (k != 0), v.bitwiseXOR(swap)).otherwise(v)))

    x = F.aggregate(steps, x, undo) if bits > 1 else x
    # Gray code: each coordinate takes the exclusive or of all before it
    gray = F.aggregate(x, F.array().cast("array<bigint>"), lambda a, v: F.concat(a, F.array(F.when(F.size(a) == 0, v).otherwise(F.element_at(a, -1).bitwiseXOR(v)))))
    flips = F.array(*[F.lit(1 << q).cast("long") for q in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")

    def flip(a):
        t = F.aggregate(flips, F.lit(0).cast("long"), lambda t, q: F.when(F.element_at(a, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(a, lambda v: v.bitwiseXOR(t))

    places = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, -1, -1) for i in range(n)])
    done = F.transform(F.array(gray), flip)[0]
    return F.transform(F.array(done), lambda a: F.aggregate(places, F.lit(0).cast("long"), lambda t, s: t * 2 + F.call_function("shiftright", F.element_at(a, s["i"] + 1), s["q"]).bitwiseAND(F.lit(1).cast("long"))))[0]


def hilbert_numpy(cells: np.ndarray, bits: int) -> np.ndarray:
    """The same index for rows of an integer array."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(n):
            on, p = (x[i] & q) != 0, q - 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where(x[n - 1] & (1 << b), t ^ ((1 << b) - 1), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key * 2 + ((x[i] >> b) & 1)
    return key


# ---------------------------------------------------------------- tokenizer files

def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
