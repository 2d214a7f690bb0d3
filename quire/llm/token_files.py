"""Token ids in Parquet: a list column with delta encoding, controlled row groups, pages with indexes.

A file holds a run of documents in ascending order of their ids: doc_id, part, the ids before the document in its part,
its number of ids, its ids. Row groups and pages are small enough for a reader to take only the pages of the documents
that it asks for (the page index holds each page's least and greatest doc_id), and metadata is read without the ids.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .codec import PIECES, codec, texts_of
from .common import by_ranges, list_column, partitions, released, shared_path

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: version 2 pages without dictionaries: integers are stored as deltas in 128-value blocks of their own bit width
LAYOUT = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.block.size": str(32 << 20), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "2000", "compression": "zstd"}
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"


def _encode(tokenizer: str, end_id: int, table: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, before, coder = TaskContext.get().partitionId(), 0, codec(tokenizer, most=table)
        for batch in batches:
            for a, texts in texts_of(batch.column(1)):
                ids, counts = coder.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                n = len(texts)
                starts = before + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(np.full(n, part, np.int32)), pa.array(starts), pa.array(counts), list_column(ids, counts, pa.int32())], names=["doc_id", "part", "part_start", "n_tokens", "tokens"])
                before += int(counts.sum())

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", table: int = PIECES) -> None:
    """Encode every whole text, append end_id, and write the files in ascending order of the ids, nulls first.

    Rows of one id lie side by side, by text; where they fill whole parts, by a hash of the text before. Null and empty texts
    give end_id alone, long ones are encoded whole. Other columns are ignored. An empty table leaves a folder with the schema.
    table: pieces of words that a worker keeps.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = partitions(docs)
    dealt = by_ranges(rows, F.col("doc_id"), parts, tie=F.col("text")).repartitionById(parts, F.col("range")).drop("range")
    ordered = dealt.sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(released(_encode(tokenizer, end_id, table)), SCHEMA).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens): start counts the ids of all documents before. Only the columns asked for are read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.selectExpr("part", "sum(n) over (order by part) - n as before")
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "tokens")  # before: one row for each part


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def _digest(batches):
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(3)
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        crc = [ids_crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, table=800_000)
    return read_tokens(spark, path).mapInArrow(released(_digest), "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
