"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder in the one named by spark.checkpoint.dir; in local mode, where that is unset, a temporary one, which goes at exit."""
    run = spark.sparkContext.applicationId
    if told := spark.conf.get("spark.checkpoint.dir", None):
        return f"{told}/quire-{run}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if run not in _own:
        _own[run] = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, _own[run], ignore_errors=True)
    return _own[run]


def clear(spark: SparkSession, path: str | None = None) -> None:
    """Delete a folder of the application's intermediate tables, by default all of them: once the results that read them are written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path or shared_dir(spark))
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, over: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    over: a list of folders that df was the last to read; they are deleted, and df's takes their place.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    for old in over or ():
        clear(df.sparkSession, old)
    if over is not None:
        over[:] = [path]
    return df.sparkSession.read.schema(df.schema).parquet(path)
