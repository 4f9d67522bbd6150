"""Tables of a session in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A session on one machine without that
    setting gets a temporary one; a cluster without it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java.get().rsplit("/", 1)[0] if java.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def at(spark: SparkSession, path: str):
    """A path's file system and the path itself, as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, label: str) -> str:
    """A path below a folder that is deleted when the application ends."""
    root = f"{shared_dir(spark)}/quillstream-{spark.sparkContext.applicationId}"
    fs, where = at(spark, root)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written down and read again, so that what reads it more than once works it out
    once, and a lost executor costs no more than the tasks it was running."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
