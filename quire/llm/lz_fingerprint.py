"""Lempel-Ziv fingerprints: the hashed phrase set of an LZ78 parse, cut to its smallest hashes.

Texts that a compressor would shrink against each other share phrases, so the overlap of the smallest hashes of two
documents estimates their compression-like similarity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import by_ranges, mix, partitions, released, segment_hashes

SIZE = 128  # hashes kept, of 32 bits each


def parse(text: str, seen: dict[str, None], phrase: str) -> str:
    """Go on with an LZ78 parse: adds new phrases to seen, in their order; gives the unfinished phrase."""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen[phrase] = None
            phrase = ""
    return phrase


def phrase_hashes(text: str, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the phrases, which follow each other from the start of the text."""
    n = int(lengths.sum())

    def values(a, b):
        return mix(np.frombuffer(text[a:b].encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(0x11))

    return segment_hashes(n, values, np.cumsum(lengths) - lengths)


def signature(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    top = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
    return top[:size]


def _signed(text: str, seen: dict[str, None], size: int = SIZE) -> np.ndarray:
    """The signature of the phrases of a parsed text."""
    return signature(phrase_hashes(text, np.fromiter(map(len, seen), np.int64, len(seen))), size)


def fingerprint(text: str, size: int = SIZE) -> np.ndarray:
    seen: dict[str, None] = {}
    parse(text, seen, "")
    return _signed(text, seen, size)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The share, of the smallest hashes of both sets together, of those in both; two empty sets are alike."""
    both = np.sort(np.concatenate([a, b]))
    again = both[1:] == both[:-1]
    n = len(both) - int(again.sum())
    if not n:
        return 1.0
    if n <= size:
        return float(again.sum() / n)
    kept = np.concatenate([[True], ~again])
    bound = both[kept][size - 1]
    return float((again & (both[1:] <= bound)).sum() / size)


def shown(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def read(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


# ---------------------------------------------------------------- each document beside the next one

def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows (range, lent, id, text), sorted within partitions so that each row's next document in descending order of ids follows it.

    Ranges of ids are cut at quantiles. The last row of a range is followed by the first of the next, lent to it; the
    lowest range gets the first row of all. One row for each range is known to the driver, and texts are dealt once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    place = by_ranges(rows, F.col("id"), parts, tie=F.col("text")).withColumn("at", F.coalesce("id", F.lit(-(1 << 63))))
    place = place.withColumn("range", parts - 1 - F.col("range"))  # descending
    heads = sorted((r["range"], r["head"]) for r in place.groupBy("range").agg(F.max("at").alias("head")).collect())
    if not heads:
        return place.select("range", F.lit(0).alias("lent"), "id", "text")
    after = [(*heads[(k + 1) % len(heads)], r) for k, (r, _) in enumerate(heads)]
    after = docs.sparkSession.createDataFrame(after, "range int, at long, to int")
    first = place.join(F.broadcast(after), ["range", "at"]).groupBy("to").agg(F.min_by(F.struct("id", "text", "at"), F.coalesce("text", F.lit(""))).alias("r"))
    lent = first.select(F.col("to").alias("range"), F.lit(1).alias("lent"), "r.id", "r.text", "r.at")
    both = place.select("range", F.lit(0).alias("lent"), "id", "text", "at").union(lent)
    return both.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "lent", F.desc("at"), "text").select("range", "lent", "id", "text")


def _compare(batches):
    import hashlib

    import pyarrow as pa

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held, done, first = None, [], None  # held: the row that waits for its next; its text is parsed once

    def mark(text):
        """(half, phrases of the first half, the unfinished one, fingerprint). The phrases of the second half are taken back, so no dictionary is copied."""
        half = len(text) - len(text) // 2
        seen: dict[str, None] = {}
        rest = parse(text[:half], seen, "")
        n = len(seen)
        parse(text[half:], seen, rest)
        own = _signed(text, seen)
        for _ in range(len(seen) - n):
            seen.popitem()
        return half, seen, rest, own

    def compare(row, text2, marked2):
        doc, text, (half, seen, rest, own) = row
        tail = text2[: len(text) // 2]
        edited = text[:half] + tail
        parse(tail, seen, rest)
        other = _signed(edited, seen)
        done.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(other), likeness(own, other), likeness(own, marked2[3])))

    def out():
        cols = list(zip(*done)) or [[]] * len(names)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    at = None
    for batch in batches:
        for r, lent, doc, text in zip(*(batch.column(i) for i in range(4))):
            r, lent, doc, text = r.as_py(), lent.as_py(), doc.as_py(), text.as_py() or ""
            if r != at:
                held, at = None, r
            if lent and held is None:
                continue  # a second row of the lent id
            marked = mark(text)
            if held is not None:
                compare(held, text, marked)
            held = None if lent else (doc, text, marked)
            if len(done) >= 500:
                yield out()
    yield out()


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to that and to the next document's.

    Descending order of ids, nulls last, ties by text; a lone document is its own next. Null texts are empty and have an
    empty fingerprint, alike to another empty one. Repeated rows are rows of their own, an empty table gives no rows, other
    columns are ignored. Of a very long text the phrases of one and a half parses are held, about 12 bytes a character each.
    """
    rows = with_next(docs, id_col, text_col, partitions(docs))
    return rows.mapInArrow(released(_compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_lz_fingerprint": op7_lz_fingerprint}
ORACLES: dict[str, str] = {}
