"""Shared storage for intermediate tables: the lineage cut of every loop."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where that is unset and the master is
    local, one of our own."""
    uri = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fluxmere.shared.dir", None)
    if not uri:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        uri = "file://" + tempfile.mkdtemp(prefix="fluxmere-shared-")
        spark.conf.set("fluxmere.shared.dir", uri)
    return uri if ":" in uri else "file://" + os.path.abspath(uri)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: short lineage, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/fluxmere-cut-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path or URI."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote, once nothing reads it any more."""
    if path := getattr(df, "_cut_at", None):
        fs, where = file_system(df.sparkSession, path)
        fs.delete(where, True)
