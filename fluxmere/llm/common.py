"""Helpers that the corpus operators share: projection, shared storage and digests."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master
    is local (tests, a laptop) a temporary folder is made and remembered in the session.
    """
    uri = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not uri:
        uri = spark.conf.get("fluxmere.shared.dir", None)
    if not uri:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        uri = "file://" + tempfile.mkdtemp(prefix="fluxmere-shared-")
        spark.conf.set("fluxmere.shared.dir", uri)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(uri)
    return uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, one per call."""
    return f"{shared_dir(spark).rstrip('/')}/fluxmere-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None) if df is not None else None
    if path:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``docs`` has not, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        k = 0
        while (free := f"fm_{name}" + f"_{k}" * bool(k)).lower() in taken:
            k += 1
        taken.add(free.lower())
        out.append(free)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and whole ``text`` (null: empty), whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def chunks(sizes, limit: int):
    """(start, end) ranges of consecutive items whose sizes add up to about ``limit``."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: What this Python worker keeps between tasks, by key.
_held: dict = {}


def held(key: str, make):
    """A worker's cache: it lives until an operator that works by ``byte_chunks`` comes along."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def byte_chunks(column, limit: int):
    """(start, end, texts as bytes) of a string column, about ``limit`` bytes at a time; nulls are
    empty. Only one chunk at a time is made into Python objects."""
    _held.clear()
    column = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, j in chunks(sizes, limit):
        yield i, j, [t or b"" for t in column.slice(i, j - i).to_pylist()]
