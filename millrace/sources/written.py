"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only in local mode where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return f"file://{_own_dirs[app]}"


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours, if the session still runs; else it is the cluster's to clear."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        return


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for tables of our own, deleted when the session's driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, safe when executors go."""
    spark, schema = df.sparkSession, df.schema
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.spooled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``spool`` gave and nothing reads any more."""
    forget(df.sparkSession, df.spooled_at)
