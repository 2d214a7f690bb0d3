"""Incremental work: what has to be done again follows from fingerprints of what it was made of.

A node is something that was made (a unit's answer, a book's synthesis, its files). Its own fingerprint covers what it
takes from outside: text, prompt, model. A node is stale if its own fingerprint isn't the stored one, or if a node that it
needs is stale. Only stale nodes are made again, and only their partitions are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..staging import materialise
from ..views import duck, table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, duck(sql)
        return f

    return add


def fingerprint(*parts: Column) -> Column:
    """A hash of texts with their lengths, so that no two lists of parts look alike; null differs from empty."""
    one = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[one(p) for p in parts]), 256)


def book_nodes(units: DataFrame, versions: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """nodes(book_id, node, own) and edges(book_id, node, needs) of books of units(book_id, unit_id, text).

    Each unit has an extraction, of its text, and a verification of that; a book has a synthesis of all verifications, and
    files of these and the synthesis. versions: of prompt and model by kind: extract, verify, synthesis, files.
    """
    name = lambda kind: F.concat(F.lit(f"{kind}/"), F.col("unit_id").cast("string"))
    version = lambda kind: F.lit(versions.get(kind, ""))
    u = units.select("book_id", "unit_id", fingerprint(F.col("text"), version("extract")).alias("e"), fingerprint(F.col("text"), version("verify")).alias("v"))
    books = units.select("book_id").distinct()
    nodes = u.select("book_id", F.inline(F.array(F.struct(name("extract").alias("node"), F.col("e").alias("own")), F.struct(name("verify").alias("node"), F.col("v").alias("own")))))
    whole = F.array(*[F.struct(F.lit(k).alias("node"), fingerprint(version(k)).alias("own")) for k in ("synthesis", "files")])
    nodes = nodes.unionByName(books.select("book_id", F.inline(whole)))
    edge = lambda a, b: F.struct(a.alias("node"), b.alias("needs"))
    edges = u.select("book_id", F.inline(F.array(edge(name("verify"), name("extract")), edge(F.lit("synthesis"), name("verify")), edge(F.lit("files"), name("verify")))))
    return nodes, edges.unionByName(books.select("book_id", F.lit("files").alias("node"), F.lit("synthesis").alias("needs")))


def stale(nodes: DataFrame, edges: DataFrame, stored: DataFrame, most: int = 100) -> DataFrame:
    """(book_id, node) of the nodes to make again; stored(book_id, node, own): of what was made. Nodes no longer wanted are none.

    One step for each level of needs; a step writes what is newly stale, and none is asked about twice. A cycle ends, too.
    """
    key = ["book_id", "node"]
    same = nodes.join(stored.select(*key, F.col("own").alias("was")), key, "left").where("was is null or was <> own")
    found = new = materialise(same.select(*key).distinct(), "stale")
    wanted = nodes.select(*key)
    for _ in range(most):
        above = edges.join(new.select("book_id", F.col("node").alias("needs")), ["book_id", "needs"], "left_semi").select(*key).distinct()
        new = materialise(above.join(found, key, "left_anti").join(wanted, key, "left_semi"), "stale")
        if not new.take(1):
            return found
        found = found.unionByName(new)
    raise ValueError(f"needs go deeper than {most} levels")


def write_changed(rows: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """Write rows by keys, in place of what those keys had; other keys' files aren't touched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def remember(nodes: DataFrame, done: DataFrame, stored: DataFrame) -> DataFrame:
    """What to store after the nodes of done(book_id, node) were made: their own fingerprints, and the others' as they were."""
    key = ["book_id", "node"]
    made = nodes.join(done, key, "left_semi").select(*key, "own")
    kept = stored.join(done, key, "left_anti").join(nodes, key, "left_semi").select(*key, "own")
    return made.unionByName(kept)


@query("""
with u as (select cast(floor(conv_id / 20.0) as bigint) as book_id, conv_id as unit_id, conv_id % 33 = 5 as changed, conv_id % 47 = 11 as fresh from (select distinct conv_id from conversations)),
s as (select book_id, unit_id from u where changed or fresh), v as (select book_id, unit_id from s union select book_id, unit_id from u where book_id % 6 = 4)
select book_id, 'extract/' || unit_id as node from s union all select book_id, 'verify/' || unit_id from v
union all select distinct book_id, 'synthesis' from v union all select distinct book_id, 'files' from (select book_id from v union all select book_id from u where book_id % 5 = 2)""")
def stale_nodes(spark: SparkSession, d: str) -> DataFrame:
    """What has to be made again: here some units' texts changed, some are new, some books' verifications and files had other versions."""
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("unit_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\\n").alias("text"))
    units = c.select(F.floor(F.col("unit_id") / 20).cast("long").alias("book_id"), "unit_id", "text")
    nodes, edges = book_nodes(units, {"extract": "p1", "verify": "p2", "files": "f2"})
    before = units.where("unit_id % 47 <> 11").withColumn("text", F.when(F.col("unit_id") % 33 == 5, F.concat(F.lit("old "), "text")).otherwise(F.col("text")))
    stored = book_nodes(before, {"extract": "p1", "verify": "p2", "files": "f2"})[0]
    other = (F.col("node").startswith("verify/") & (F.col("book_id") % 6 == 4)) | ((F.col("node") == "files") & (F.col("book_id") % 5 == 2))
    return stale(nodes, edges, stored.withColumn("own", F.when(other, "other").otherwise(F.col("own"))))
