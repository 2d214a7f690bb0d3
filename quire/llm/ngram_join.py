"""N-gram Jaccard self-join of documents, and the classes of near copies that follow from it.

A document's set holds the distinct n-word shingles of its lower-cased words, as 64-bit hashes. Documents with equal sets
form a class; one document of each class takes part in the join:

1. Each shingle gets a place in one global order, rarest first: by the document frequency of its hash bucket (a table of
   fixed size, counted over all documents), then by hash. Any order gives right results; this one keeps prefixes rare.
2. Prefix filter: two sets within the threshold share a shingle among the first n - ceil(t*n) + 1 of each.
3. Rows are dealt by prefix shingle. The row whose shingle comes earliest in its set leads; every other row is paired with
   its leader if the length and positional filters allow. That is linear in the rows of a shingle, and the pairs that
   hold join up nearly all members of a group of near copies.
4. What is left is exhaustive: of shingles whose rows now lie in several components, all pairs across components that
   pass the length, positional and suffix filters are verified, so no link that joins two components is lost. The rows of
   a frequent shingle are dealt into blocks, each two of which meet in a task of their own.
5. All links lie within components, so they are counted there: a component's classes are dealt into blocks, each two
   blocks meet in a task of their own, and the overlaps of all their pairs come from one product of incidence matrices.
   Only sums for each class leave the task, so a group of k near copies makes no k*k rows.

Verification intersects the whole sets, once per pair. A very frequent shingle is salted in step 3, from the same table.
A class is told by 128 bits of hashes of its set. Tables that are joined by a key which a third of all rows may share are
written before, so that both sides of the join are plain exchanges and the adaptive planner can split the key's rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Words, list_column, materialise, mix, partitions, released, text_chunks
from .components import connected_components

BUCKET_BITS = 18  # the frequency table: 2**18 counts, 1 MB whatever the input
SALT_ROWS = 200_000  # a shingle bucket with more documents than this, beyond the mean of all, is dealt over several tasks
CROSS_ROWS = 4096  # rows of a shingle that are dealt together when pairs across components are sought
SEEN = 1_000_000  # classes that a task remembers, so as not to give one out twice
BITMAP_BITS = (16, 28)  # of the table of asked documents: 8 kB to 32 MB, by their number
BLOCK = 128  # classes of a component that are dealt together when links are counted
RANGES = 256  # suffix filter: parts of the hash space whose counts bound the overlap
SEED, SEED2 = np.uint64(0x5EED5EED), np.uint64(0xC1A55E5)


def needed(n1, n2, percent: int):
    """The least overlap that two sets of these sizes must have: ceil(percent * (n1 + n2) / (100 + percent))."""
    return -((-percent * (n1 + n2)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def shingle_sets(column, words: int = 5):
    """For each text of an Arrow column, in order: its sorted distinct shingle hashes. Fewer words than asked for make one shingle."""
    factors = mix(np.arange(words, dtype=np.uint64) + SEED) | np.uint64(1)
    for _, _, data, ends in text_chunks(column):
        w = Words(data, ends, fold=True)
        m = len(w.hashes) - words + 1
        windows = np.zeros(max(m, 0), np.uint64)
        for j in range(words if m > 0 else 0):
            windows += w.hashes[j : j + m] * factors[j]
        windows = mix(windows)
        for d in range(len(ends)):
            a, b = int(w.first[d]), int(w.first[d + 1])
            if b - a >= words:
                yield np.unique(windows[a : b - words + 1])
            elif b > a:
                yield mix(np.array([(w.hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)]))
            else:
                yield np.empty(0, np.uint64)


def class_keys(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit keys of a set. Equal sets share both; the first stands for the class unless `clashes` tells otherwise."""
    keys = mix(np.array([mix(s ^ SEED).sum(dtype=np.uint64) + np.uint64(len(s)), mix(s + SEED2).sum(dtype=np.uint64) ^ np.uint64(len(s))]))
    return tuple(int(k) for k in keys.astype(np.int64))


def class_key(s: np.ndarray, clashes: frozenset[int]) -> int:
    one, two = class_keys(s)
    return two if one in clashes else one


def _sketch(s: np.ndarray) -> bytes | None:
    """How many hashes lie in each of RANGES equal parts of their space, as bytes; None if a count doesn't fit."""
    counts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=RANGES)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def _scan(words: int):
    """Documents to rows (kind 0: id, both class keys, set size, sketch, hash of the text) and (kind 1: bucket, its documents in this task)."""

    def run(batches):
        import pyarrow as pa

        names = ["kind", "id", "c", "c2", "n", "sketch", "h"]
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            keys, sizes, sketches = [], [], []
            for s in shingle_sets(batch.column(1), words):
                keys.append(class_keys(s) if len(s) else (0, 0))
                sizes.append(len(s))
                sketches.append(_sketch(s) if len(s) else None)
                np.add.at(counts, (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
            one, two = np.array(keys, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), np.int32)), batch.column(0).cast(pa.int64()), pa.array(one), pa.array(two), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), batch.column(2)], names=names)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int32)), pa.array(some), pa.array(some), pa.array(some), pa.array(counts[some]), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.int64())], names=names)

    return run


def _prefixes(words: int, percent: int, table, clashes: frozenset[int]):
    """Documents to rows (shingle, salt, class, size, place in the set's order) of their prefixes, once per class and task. Salt 0: not dealt."""

    def run(batches):
        import pyarrow as pa

        counts = table.value
        beyond = np.maximum(counts - int(counts.mean()), 0)
        seen: set[int] = set()
        for batch in batches:
            out, size = [], 0
            for s in shingle_sets(batch.column(0), words):
                n = len(s)
                if not n or (c := class_key(s, clashes)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()  # a class that comes again is the same rows again
                seen.add(c)
                bucket = (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                p = prefix_length(n, percent)
                first = np.lexsort((s, counts[bucket]))[:p]
                hot = beyond[bucket[first]]
                salt = np.where(hot > SALT_ROWS, np.uint64(1) + np.uint64(c & 0xFFFFFFFF) % (hot // SALT_ROWS + 1).astype(np.uint64), np.uint64(0))
                out.append((s[first].view(np.int64), salt.astype(np.int32), np.full(p, c, np.int64), np.full(p, n, np.int32), np.arange(p, dtype=np.int32)))
                size += p
                if size > 200_000:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    def _batch(out):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["t", "salt", "c", "n", "pos"])

    return run


def _lead(percent: int):
    """Sorted prefix rows to kind 0: (leader, other) pairs, and kind 1: the rows of shingles with several classes."""

    def run(batches):
        import pyarrow as pa

        carried, sent = None, False  # the last run's leader and latest row; whether they have been given out
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(5)]
            if not len(cols[0]):
                continue
            old = len(carried[0]) if carried else 0
            t, salt, c, n, pos = cols = [np.concatenate(x) for x in zip(carried, cols)] if carried else cols
            fresh = np.ones(len(t), bool)
            fresh[:old] = not sent
            same = np.zeros(len(t), bool)
            same[1:] = (t[1:] == t[:-1]) & (salt[1:] == salt[:-1])
            again = np.zeros(len(t), bool)  # a copy of the row before, from another task
            again[1:] = same[1:] & (c[1:] == c[:-1])
            heads = np.flatnonzero(~same)
            sizes = np.diff(np.append(heads, len(t)))
            several = (np.add.reduceat((~again).astype(np.int64), heads) > 1) | (salt[heads] > 0)
            rows = np.flatnonzero(np.repeat(several, sizes) & ~again & fresh)
            lead = np.repeat(heads, sizes)[rows]
            n1, n2 = n[lead].astype(np.int64), n[rows].astype(np.int64)
            near = (c[rows] != c[lead]) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
            near &= np.minimum(n1 - pos[lead], n2 - pos[rows]) >= needed(n1, n2, percent)
            x, y = c[lead[near]], c[rows[near]]
            x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            k, m = len(x), len(rows)
            zero = np.zeros(k, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([0, 1], np.int32), [k, m])), pa.array(np.concatenate([x, t[rows]])), pa.array(np.concatenate([y, c[rows]])), pa.array(np.concatenate([zero, n[rows]])), pa.array(np.concatenate([zero, pos[rows]]))],
                names=["kind", "a", "b", "n", "pos"],
            )
            sent = bool(several[-1])
            ends = [heads[-1], len(t) - 1] if sent else [heads[-1]]
            carried = [v[ends] for v in cols]

    return run


def _bitmap(spark: SparkSession, asked: DataFrame):
    """A bitmap that holds the asked classes' own documents (c, least), and by chance some others; BITMAP_BITS bound its size."""
    least, most = BITMAP_BITS
    size = 1 << min(max((16 * asked.count()).bit_length(), least), most)
    at = F.pmod(F.col("c").bitwiseXOR(F.coalesce("least", F.lit(-1))), F.lit(size)) + 1  # bitmap functions count from 1
    rows = asked.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = bytearray(size // 8)
    for bucket, bits in rows:  # 32,768 bits each
        out[(bucket - 1) * 4096 : bucket * 4096] = bits
    return spark.sparkContext.broadcast(bytes(out))


def _sets(words: int, wanted, clashes: frozenset[int]):
    """Documents to (class, sorted set) of those that the bitmap may hold, mostly once per class and task."""

    def run(batches):
        import pyarrow as pa

        bits = wanted.value
        seen: set[int] = set()
        for batch in batches:
            keys, sets = [], []
            for i, s in zip(batch.column(0).fill_null(-1).to_pylist(), shingle_sets(batch.column(1), words)):
                if len(s) and (c := class_key(s, clashes)) not in seen and bits[(at := (c ^ i) % (8 * len(bits))) >> 3] >> (at & 7) & 1:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    keys.append(c)
                    sets.append(s.view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), list_column(np.concatenate(sets), [len(s) for s in sets], pa.int64())], names=["c", "s"])

    return run


def _within(percent: int):
    """Suffix filter. Rows (a, b, sizes, sketches) to the pairs whose sets may overlap enough in each part of the hash space."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n1, n2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            good = np.minimum(n1, n2) >= needed(n1, n2, percent)
            both = [x.is_valid().to_numpy(zero_copy_only=False) for x in (batch.column(4), batch.column(5))]
            at = np.flatnonzero(good & both[0] & both[1])
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                one, two = (np.frombuffer(b"".join(x.take(pa.array(part)).to_pylist()), np.uint8).reshape(-1, RANGES) for x in (batch.column(4), batch.column(5)))
                good[part] = np.minimum(one, two).sum(1, dtype=np.int64) >= needed(n1[part], n2[part], percent)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _verify(percent: int):
    """Rows (a, b, set of a, set of b) to the pairs within the threshold, by the intersection."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sides = [(x.values.to_numpy(zero_copy_only=False).view(np.uint64), x.offsets.to_numpy()) for x in (batch.column(2), batch.column(3))]
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = (v[o[i] : o[i + 1]] for v, o in sides)
                need = needed(len(x), len(y), percent)
                good[i] = min(len(x), len(y)) >= need and len(np.intersect1d(x, y, assume_unique=True)) >= need
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return run


def _across(percent: int):
    """Rows of mixed shingles (t, x, y, right, root, class, size, place), sorted by the first three, to pairs of different components that pass the filters.

    Of a cell with x = y, all pairs; of another, those of a right row and one that isn't.
    """

    def run(batches):
        import pyarrow as pa

        def passing(g, i, j):
            cell, right, root, c, n, pos = g
            n1, n2 = n[i], n[j]
            ok = (root[i] != root[j]) & (c[i] != c[j]) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
            return ok & ((right[i] != right[j]) | ~cell[i]) & (np.minimum(n1 - pos[i], n2 - pos[j]) >= needed(n1, n2, percent))

        def given(c, i, j):
            x, y = np.unique(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        def pairs(key, g):
            """Of whole runs of rows. Short runs all at once, by the distance between two rows; long ones by blocks."""
            heads = np.flatnonzero(np.append(True, np.any(key[:, 1:] != key[:, :-1], axis=0)))
            sizes = np.diff(np.append(heads, key.shape[1]))
            run = np.repeat(np.arange(len(heads)), sizes)
            short = np.repeat(sizes <= 64, sizes)
            for d in range(1, 64):
                i = np.flatnonzero((run[d:] == run[:-d]) & short[d:])
                if not len(i):
                    break
                i = i[passing(g, i, i + d)]
                if len(i):
                    yield given(g[3], i, i + d)
            for h, m in zip(heads[sizes > 64], sizes[sizes > 64]):
                step = max(1, 2_000_000 // int(m))
                for k in range(h, h + m, step):
                    i, j = np.arange(k, min(k + step, h + m))[:, None], np.arange(h, h + m)[None, :]
                    x, y = np.nonzero(passing(g, i, j) & (i < j))
                    if len(x):
                        yield given(g[3], i[x, 0], j[0, y])

        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for i in range(8)]
            if not len(now[0]):
                continue
            now = [np.concatenate(x) for x in zip(held, now)] if held else now
            key = np.stack(now[:3])
            last = int(np.flatnonzero(np.append(True, np.any(key[:, 1:] != key[:, :-1], axis=0)))[-1])
            if last:
                yield from pairs(key[:, :last], [(now[1] != now[2])[:last], *[x[:last] for x in now[3:]]])
            held = [x[last:] for x in now]
        if held:
            yield from pairs(np.stack(held[:3]), [held[1] != held[2], *held[3:]])

    return run


def _cells(rows: DataFrame, block: int, of: str) -> DataFrame:
    """Rows with `m` rows of their key dealt into blocks by class: one row for each other block that they meet, (x, y, right, of...)."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("x"), F.greatest("b", o).alias("y")))
    rows = rows.withColumn("cell", F.explode(cells))
    right = (F.col("cell.x") != F.col("cell.y")) & (F.col("b") == F.col("cell.y"))
    first, *rest = of.split()
    return rows.select(first, "cell.x", "cell.y", right.alias("right"), *rest)


def overlaps(values: np.ndarray, sizes: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many hashes two sets share, for the sets that aren't `right` (rows) by those that are (columns); by all sets if none is."""
    m = len(sizes)
    one, two = (~right, right) if right.any() else (np.ones(m, bool),) * 2
    _, column, often = np.unique(values, return_inverse=True, return_counts=True)
    shared = often > 1
    at = np.flatnonzero(shared[column])
    rows, columns = np.repeat(np.arange(m), sizes)[at], (np.cumsum(shared) - 1)[column[at]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((int(one.sum()), int(two.sum())), np.int64)
    for k in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(columns, [k, k + 4096])
        held = np.zeros((m, 4096), np.float32)
        held[rows[a:b], columns[a:b] - k] = 1
        out += (held[one] @ held[two].T).astype(np.int64)
    if one is two:
        np.fill_diagonal(out, sizes)
    return out


def _degrees(percent: int):
    """Rows (root, x, y, right, class, its documents, its set), sorted by the first three and class, to (class, documents linked with it here)."""

    def run(batches):
        import pyarrow as pa

        def counted(batch):
            """Of whole cells (root, x, y)."""
            root, x, y, right, c, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            values, offsets = batch.column(6).values.to_numpy(zero_copy_only=False), batch.column(6).offsets.to_numpy()
            heads = np.flatnonzero(np.append(True, (root[1:] != root[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            keys, sums = [], []
            for a, b in zip(heads, np.append(heads[1:], len(c))):
                at = a + np.flatnonzero(np.append(True, c[a + 1 : b] != c[a : b - 1]))  # a class may come from several documents
                side = right[at]
                if len(at) < 2 or x[a] != y[a] and (side.all() or not side.any()):
                    continue
                sizes = (offsets[at + 1] - offsets[at]).astype(np.int64)
                sets = values[offsets[a] : offsets[b]] if len(at) == b - a else np.concatenate([values[offsets[i] : offsets[i + 1]] for i in at])
                one, two = (at[~side], at[side]) if side.any() else (at, at)
                n1, n2 = (offsets[i + 1].astype(np.int64) - offsets[i] for i in (one, two))
                near = overlaps(sets, sizes, side) >= needed(n1[:, None], n2[None, :], percent)
                if side.any():
                    keys.append(c[two])
                    sums.append(near.T @ w[one])
                else:
                    np.fill_diagonal(near, False)
                keys.append(c[one])
                sums.append(near @ w[two])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sums).astype(np.int64))], names=["c", "k"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            cell = [batch.column(i).to_numpy() for i in range(3)]
            last = int(np.flatnonzero(np.append(True, np.any([v[1:] != v[:-1] for v in cell], axis=0)))[-1])
            if last:
                # a new batch, not a slice: the offsets of lists begin at 0
                yield from counted(batch.take(pa.array(np.arange(last))))
            held = batch.take(pa.array(np.arange(last, batch.num_rows)))
        if held is not None:
            yield from counted(held)

    return run


def _linked(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(class, documents of other classes within the threshold), of all pairs within components; classes(c, root, m, w), w: its documents, m: classes of its root."""
    rows = _cells(sets.join(classes.where("m > 1"), "c"), BLOCK, "root c w s")
    rows = rows.repartition(partitions(classes), "root", "x", "y").sortWithinPartitions("root", "x", "y", "c")
    return rows.mapInArrow(released(_degrees(percent)), "c long, k long").groupBy("c").agg(F.sum("k").alias("k"))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int, clashes: frozenset[int]) -> tuple[DataFrame, DataFrame]:
    """The pairs of classes within the threshold: suffix filter on the classes' sketches, then the whole sets. And the sets (c, s) that were asked for."""
    side = lambda x, i: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"s{i}"))
    near = pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "n1", "n2", "s1", "s2")
    near = materialise(near.mapInArrow(released(_within(percent)), "a long, b long"), "pairs")
    asked = near.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(classes.select("c", "least"), "c")
    sets = materialise(docs.select("id", "text").mapInArrow(released(_sets(words, _bitmap(docs.sparkSession, asked), clashes)), "c long, s array<long>"), "sets")
    rows = near.join(sets.select(F.col("c").alias("a"), F.col("s").alias("s1")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("s2")), "b")
    return materialise(rows.select("a", "b", "s1", "s2").mapInArrow(released(_verify(percent)), "a long, b long").distinct(), "links"), sets


def _joined(found: DataFrame, late: DataFrame) -> DataFrame:
    """The components (node, root) after more links: only the roots that these touch are joined up anew."""
    root = lambda x: found.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    ends = late.join(root("a"), "a", "left").join(root("b"), "b", "left")
    ends = materialise(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), "ends")
    above = connected_components(ends).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = found.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = above.join(found, above.root == found.node, "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return moved.union(alone)


def _grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs(id, text): rows (id, class, set size, hash of the text), classes (class, root, component_id, documents), and the sets of all classes that have links."""
    spark = docs.sparkSession
    scan = materialise(docs.select("id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).mapInArrow(released(_scan(words)), "kind int, id long, c long, c2 long, n long, sketch binary, h long"), "scan")
    rows, classes, clashes = _classes(scan.where("kind = 0"))
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for bucket, n in scan.where("kind = 1").groupBy("c").agg(F.sum("n").alias("n")).collect():  # 2**18 rows at most
        counts[bucket] = n
    table = spark.sparkContext.broadcast(counts)

    prefixes = docs.select("text").mapInArrow(released(_prefixes(words, percent, table, clashes)), "t long, salt int, c long, n int, pos int")
    dealt = prefixes.repartition(partitions(docs), "t", "salt").sortWithinPartitions("t", "salt", "pos", "n", "c")
    led = materialise(dealt.mapInArrow(released(_lead(percent)), "kind int, a long, b long, n int, pos int"), "led")
    pairs = materialise(led.where("kind = 0").select("a", "b").distinct(), "pairs")
    links, sets = _verified(docs, classes, pairs, words, percent, clashes)
    found = connected_components(links)

    # what is left: shingles whose rows lie in several components
    held = led.where("kind = 1").select(F.col("a").alias("t"), F.col("b").alias("c"), "n", "pos")
    held = held.join(found, held.c == found.node, "left").select("t", F.coalesce("root", "c").alias("root"), "c", "n", "pos")
    held = materialise(held, "held")
    mixed = held.groupBy("t").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where("x <> y").select("t", "m")
    rest = _cells(held.join(materialise(mixed, "mixed"), "t").distinct(), CROSS_ROWS, "t root c n pos")
    rest = rest.repartition(partitions(docs), "t", "x", "y").sortWithinPartitions("t", "x", "y")
    more = rest.mapInArrow(released(_across(percent)), "a long, b long").distinct()
    more = materialise(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    groups = found
    if more.take(1):
        late, others = _verified(docs, classes, more, words, percent, clashes)
        sets = sets.union(others)
        groups = materialise(_joined(found, late), "groups")

    classes = classes.select("c", "least", "w").join(groups, F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root"), "least", "w")
    classes = materialise(classes, "rooted")
    roots = materialise(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "roots")
    return rows, materialise(classes.join(roots, "root").select("c", "root", "component_id", "m", "w"), "grouped"), sets


def _classes(scan: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """Rows (id, c, n, h), classes (c, least, n, sketch, w), and the first keys that different sets share.

    Of n sets, n * n / 2**65 pairs share a first key by chance (about 3 of 10**10 sets); those classes go by their second key.
    """

    def grouped(rows):
        of = rows.where("n > 0").groupBy("c").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("w"), F.min("c2").alias("low"), F.max("c2").alias("high"))
        return materialise(of, "classes")

    classes = grouped(scan)
    clashes = frozenset(r["c"] for r in classes.where("low <> high").select("c").collect())
    if clashes:
        scan = scan.withColumn("c", F.when(F.col("c").isin(*clashes), F.col("c2")).otherwise(F.col("c")))
        classes = grouped(scan)
    return scan.select("id", "c", "n", "h"), classes.drop("low", "high"), clashes


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of docs.

    component_id is the smallest id reachable by links of at least percent/100 Jaccard similarity, n_links the number of
    other rows that link with this one directly, rows of an equal set included. Null and empty texts,
    and texts without words, have no shingles and link with nothing: they are their own component. Rows with a null id
    come back with it; they take part in links, and a component of null ids alone has a null component_id. Rows that
    repeat an id are rows of their own. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, classes, sets = _grouped(docs, words, percent)
    classes = classes.join(_linked(classes, sets, percent), "c", "left").select("c", "component_id", (F.coalesce("k", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    classes = materialise(classes, "linked")
    out = rows.where("n > 0").join(classes, "c").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_links")
    return out.union(rows.where("n = 0").select("id", "n", "id", F.lit(0).cast("long")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the near copies: of each component the row with the smallest id stays, whole and unchanged.

    Components are told apart by row, not by id: of rows that share an id, those that lie in different components are judged
    each for itself. Of rows that share the smallest id of one component one stays; rows without words that are equal in id
    and text count as copies. Rows with a null id link with nothing here and stay.
    """
    options = {"words": 5, "percent": 80} | options
    known = docs.where(F.col(id_col).isNotNull())
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows, classes, _ = _grouped(known.select(own.alias("id"), F.col(text_col).cast("string").alias("text")), **options)
    least = rows.where("n > 0").join(classes.where("component_id is not null"), "c").where("id = component_id").groupBy("root").agg(F.min(F.struct("id", "h")).alias("r"))
    keep = least.select("r.id", "r.h").union(rows.where("n = 0").select("id", "h")).distinct().select(F.col("id").alias("__id"), F.col("h").alias("__h"))
    marked = known.withColumn("__own", own).withColumn("__text", F.xxhash64(text))
    kept = marked.join(keep, (F.col("__own") == F.col("__id")) & (F.col("__text") == F.col("__h")), "left_semi").dropDuplicates(["__own", "__text"])
    return kept.drop("__own", "__text").unionByName(docs.where(F.col(id_col).isNull()))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_ngram_join": op2_ngram_join}
#: all pairs that share a shingle are counted, and links followed to their ends; for small tables
ORACLES = {
    "op2_ngram_join": """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) + any_value(b.n) as n from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 80 * (n - c)), both_ as (select a, b from l union all select b, a from l),
r(id, root) as (select doc_id, doc_id from documents union select both_.b, r.root from r join both_ on r.id = both_.a)
select s.doc_id, cast(len(s) as bigint) as n_shingles, (select min(root) from r where r.id = s.doc_id) as component_id, (select count(*) from both_ where both_.a = s.doc_id) as n_links from s"""
}
