"""Tables that readers see whole: files in a folder of their own for each transaction, and a manifest that names the folders.

A transaction writes its files first and then adds the next version of the manifest by a rename that fails if that version
exists; a writer that lost the race reads the new version and tries again. Readers take the latest version, so they see
all files of a transaction or none. A transaction has a name, and one that is in the manifest already isn't written again:
a batch that a stream replays adds nothing.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

PART = "_part"  # of a row that was read: its transaction's folder, which sorts as the transactions do


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    out = _fs(spark, path).create(_path(spark, path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def manifest(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """(version, folder of each transaction in their order) of the latest manifest; version 0 of an empty table."""
    fs, home = _fs(spark, root), _path(spark, f"{root}/_manifest")
    names = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
    versions = [int(m.group(1)) for n in names if (m := re.fullmatch(r"(\d+)\.json", n))]
    if not versions:
        return 0, {}
    return max(versions), json.loads(read_text(spark, f"{root}/_manifest/{max(versions)}.json"))


def _publish(spark: SparkSession, root: str, version: int, parts: dict[str, str]) -> bool:
    """Add a version of the manifest, unless there is one of that number."""
    aside, target = f"{root}/_manifest/.{uuid.uuid4().hex}.tmp", f"{root}/_manifest/{version}.json"
    write_text(spark, aside, json.dumps(parts))
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, aside).toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(_path(spark, aside), _path(spark, target), options)
        return True
    except Exception as e:  # a Java error
        _fs(spark, aside).delete(_path(spark, aside), False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


def commit(df: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = (), tries: int = 20) -> int:
    """Add df's rows as transaction `name`; the version that holds them. One that is there already changes nothing."""
    spark = df.sparkSession
    version, parts = manifest(spark, root)
    if name in parts:
        return version
    written = None
    for _ in range(tries):
        folder = f"{version + 1:012d}-{uuid.uuid4().hex}"
        if written is None:
            df.write.partitionBy(*partition_by).parquet(f"{root}/{folder}")
        else:  # another writer was first: the folder takes the name of the version it now gets
            _fs(spark, root).rename(_path(spark, f"{root}/{written}"), _path(spark, f"{root}/{folder}"))
        written = folder
        if _publish(spark, root, version + 1, parts | {name: folder}):
            return version + 1
        version, parts = manifest(spark, root)
        if name in parts:
            break
    _fs(spark, root).delete(_path(spark, f"{root}/{written}"), True)
    if name in parts:
        return version
    raise OSError(f"cannot commit {name} to {root}")


def read(spark: SparkSession, root: str, schema: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of all transactions of the latest manifest, with PART; schema: of the rows, with the columns of partition_by."""
    _, parts = manifest(spark, root)
    if not parts:
        return spark.createDataFrame([], schema).withColumn(PART, F.lit(None).cast("string"))
    part = F.regexp_extract("_metadata.file_path", r"/(\d{12}-[0-9a-f]{32})/", 1)
    if not partition_by:
        return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in dict.fromkeys(parts.values())]).withColumn(PART, part)
    out = None
    for p in dict.fromkeys(parts.values()):
        one = spark.read.schema(schema).option("basePath", f"{root}/{p}").parquet(f"{root}/{p}").withColumn(PART, part)
        out = one if out is None else out.unionByName(one)
    return out


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with PART: for each key those of the last transaction that has any; a book that was written anew is whole."""
    last = rows.groupBy(*keys).agg(F.max(PART).alias("__last"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    met = rows.alias("r").join(last.alias("l"), [*same, F.col(f"r.{PART}") == F.col("l.__last")], "left_semi")
    return met.drop(PART)


def once(root: str, name: str):
    """A function for foreachBatch that adds each batch of a stream once, whether or not it is replayed."""
    return lambda df, batch_id: commit(df, root, f"{name}-{batch_id}") and None


def compact(spark: SparkSession, root: str, schema: str, keys: list[str] | None = None) -> int:
    """Write all transactions as one, of each key the last if keys are given, and publish it in their place; the version."""
    version, parts = manifest(spark, root)
    rows = read(spark, root, schema)
    rows = latest(rows, keys) if keys else rows.drop(PART)
    folder = f"{version + 1:012d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{folder}")
    first, *others = parts  # the names stay, so that no batch of theirs is added again
    if not _publish(spark, root, version + 1, {first: folder} | {n: folder for n in others}):
        _fs(spark, root).delete(_path(spark, f"{root}/{folder}"), True)
        raise OSError(f"{root} was written meanwhile")
    return version + 1


def vacuum(spark: SparkSession, root: str, keep_versions: int = 10) -> list[str]:
    """Delete folders and manifests that no version among the last keep_versions names; readers of older ones lose them."""
    fs, (version, _) = _fs(spark, root), manifest(spark, root)
    held: set[str] = set()
    for v in range(max(1, version - keep_versions + 1), version + 1):
        if fs.exists(_path(spark, f"{root}/_manifest/{v}.json")):
            held |= set(json.loads(read_text(spark, f"{root}/_manifest/{v}.json")).values())
    gone = []
    for s in fs.listStatus(_path(spark, root)):
        name = s.getPath().getName()
        if re.fullmatch(r"\d{12}-[0-9a-f]{32}", name) and name not in held and int(name[:12]) <= version:
            fs.delete(s.getPath(), True)
            gone.append(name)
    for v in range(1, version - keep_versions + 1):
        fs.delete(_path(spark, f"{root}/_manifest/{v}.json"), False)
    return sorted(gone)
