"""Packing documents into fixed sequences in the order of a space-filling curve.

Each document's hashed vector of token counts is projected to a few dimensions by fixed pseudo-random weights; the cell of
its mean has a Hilbert key. Documents in the order of the keys form one stream of ids that is cut every `length` ids, so
neighbours on the curve share sequences and only the last sequence needs padding.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .codec import PIECES as TABLE, codec, texts_of
from .common import hilbert_numpy, materialise, mix, partitions, released
from .token_files import ids_crc32

TOKENIZER, END_ID, LENGTH = "word_bpe_49k.json", 1, 2048
DIMENSIONS, BITS, SCALE = 3, 10, 10.0


def _weights() -> np.ndarray:
    """Weights near the normal law for the 2**16 hashed token ids, the same on every machine."""
    raw = mix(np.arange((1 << 16) * DIMENSIONS, dtype=np.uint64))
    parts = (raw[:, None] >> np.array([0, 16, 32, 48], np.uint64)) & np.uint64(0xFFFF)
    return ((parts.astype(np.float64).sum(1) / 65536 - 2) * np.sqrt(3)).astype(np.float32).reshape(-1, DIMENSIONS)


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The Hilbert key of each document; counts must be above 0."""
    sums = np.add.reduceat(_weights_once()[ids & 0xFFFF], np.cumsum(counts) - counts, axis=0)
    mean = sums / counts[:, None]
    cells = ((0.5 + np.arctan(SCALE * mean) / np.pi) * (1 << BITS)).astype(np.int64)
    return hilbert_numpy(np.clip(cells, 0, (1 << BITS) - 1), BITS)


_kept: list[np.ndarray] = []


def _weights_once() -> np.ndarray:
    if not _kept:
        _kept.append(_weights())
    return _kept[0]


def _encode(tokenizer: str, end_id: int, table: int):
    def run(batches):
        import pyarrow as pa

        coder = codec(tokenizer, drops_space=True, most=table)
        for batch in batches:
            for a, texts in texts_of(batch.column(1)):
                ids, counts = coder.encode(texts)
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                ends = np.cumsum(counts)
                raw = ids.astype("<u2" if ids.max() < 65536 else "<u4")
                flat = [raw[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(curve_keys(ids, counts)), pa.array(counts), pa.array(flat, pa.binary())], names=["doc_id", "curve_key", "n", "ids"])

    return run


def _cut(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            docs, n, raw, at = batch.column(0), batch.column(1).to_numpy(), batch.column(2), batch.column(3).to_numpy()
            first, last = at // length, (at + n - 1) // length
            many = last - first + 1
            row = np.repeat(np.arange(len(n)), many)
            seq = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(row))
            a = np.maximum(seq * length, at[row])
            b = np.minimum((seq + 1) * length, (at + n)[row])
            crc, k = [], -1
            for r, x, y in zip(row.tolist(), (a - at[row]).tolist(), (b - at[row]).tolist()):
                if r != k:
                    k, whole = r, raw[r].as_buffer()
                    ids = np.frombuffer(whole, "<u2" if len(whole) == 2 * n[r] else "<u4")
                crc.append(ids_crc32(ids[x:y]))
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(row)), pa.array(a - at[row]), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(a - seq * length)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in one piece; all sequences but the last have exactly `length` ids. Null and empty
    texts give end_id alone. Rows that repeat an id, or have none, are documents of their own. An empty table gives no
    rows; other columns are ignored. table: pieces of words that a worker keeps.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = rows.mapInArrow(released(_encode(tokenizer, end_id, table)), "doc_id long, curve_key long, n long, ids binary")
    coded = materialise(coded.withColumn("row", F.monotonically_increasing_id()), "packing")
    keys = ["curve_key", "doc_id", "row"]
    order = coded.select(*keys, "n").repartitionByRange(partitions(docs), *keys).sortWithinPartitions(*keys)
    order = materialise(order.withColumn("at", F.monotonically_increasing_id()), "packing").withColumn("part", F.shiftright("at", 33))
    sums = order.groupBy("part").agg(F.sum("n").alias("part_n")).selectExpr("part", "sum(part_n) over (order by part) - part_n as before")
    placed = order.join(F.broadcast(sums), "part")  # as many rows as partitions
    placed = placed.selectExpr("row", "before + sum(n) over (partition by part order by at) - n as at")
    return coded.join(placed, "row").select("doc_id", "n", "ids", "at").mapInArrow(released(_cut(length)), PIECES)


def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), table=1_200_000)


QUERIES = {"op9_curve_packing": op9_curve_packing}
ORACLES: dict[str, str] = {}
