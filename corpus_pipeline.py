"""A corpus pipeline of four stages: quality rules, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; the first three return the columns of documents, the
last one the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm.common import materialise
from quire.llm.ngram_join import keep_one
from quire.llm.packing import pack
from quire.llm.pii import redact
from quire.llm.quality_rules import fit, keep_good


TABLE = 100_000  # pieces of words that a worker keeps: less than on its own, since it holds memory of the stages before


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits or a learned rule reject go."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kinds; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens in the order of a space-filling curve."""
    return pack(docs, table=TABLE)


STAGES = [("quality", quality), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", packing)]

#: learned rules and tokenizers are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
