"""Sources and sinks: local data, text, binary records, per-epoch and size-bounded files."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.epochs import EPOCH, with_epoch
from ..storage import cut, file_system


def from_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Finite local data, all in epoch 0."""
    return with_epoch(spark.createDataFrame(list(rows), schema))


def from_batches(spark: SparkSession, batches: Iterable[Iterable[tuple]], schema: str) -> DataFrame:
    """One epoch per batch, in order; an empty batch is an epoch without rows."""
    out = spark.createDataFrame([], f"{schema}, {EPOCH} int")
    for e, rows in enumerate(batches):
        if rows := list(rows):
            out = out.unionByName(spark.createDataFrame(rows, schema).withColumn(EPOCH, F.lit(e)))
    return out


def constant(spark: SparkSession, *values, schema: str) -> DataFrame:
    return from_rows(spark, [v if isinstance(v, tuple) else (v,) for v in values], schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return from_rows(spark, [], schema)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files of any Hadoop file system, every one of them, in no given order."""
    return with_epoch(spark.read.text(paths).withColumnRenamed("value", "line"))


def read_lines_of(spark: SparkSession, names: DataFrame, column: str = "path") -> DataFrame:
    """Lines of the distinct files that a table names. The list of names comes to the driver,
    which plans the splits; a name repeated is read once."""
    return read_lines(spark, sorted(r[0] for r in names.select(column).distinct().collect()))


def read_edges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, target) of lines ``source target``; lines that begin with # are comments."""
    lines = spark.read.text(paths).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(parts[0].cast("long").alias("source"), parts[1].cast("long").alias("target"))


def read_custom(spark: SparkSession, paths: str | list[str], decode: Callable[[bytes], Iterable[dict]], schema: str) -> DataFrame:
    """Files of a format of one's own: ``decode`` turns a file's bytes into records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(",")]
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame(list(decode(bytes(content))), columns=[n.strip() for n in names])

    return with_epoch(spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, schema))


def write_custom(df: DataFrame, path: str, encode: Callable[[pd.DataFrame], bytes]) -> None:
    """Each partition's rows encoded by ``encode`` into binary rows of Parquet files."""
    columns = [c for c in df.columns if c != EPOCH]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"content": [encode(b[columns])]})

    df.mapInPandas(run, "content binary").write.mode("overwrite").parquet(path)


def write_custom_files(df: DataFrame, path: str, encode: Callable[[pd.DataFrame], bytes]) -> None:
    """Files of a format of one's own, which ``read_custom`` reads: one a partition with rows, the
    batches' bytes one after another, moved into place whole. What is at ``path`` goes."""
    columns = [c for c in df.columns if c != EPOCH]
    where, folder = file_system(df.sparkSession, path)
    where.delete(folder, True)
    where.mkdirs(folder)
    uri = str(where.makeQualified(folder))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        files, base = fs.FileSystem.from_uri(uri)
        name, held = f"part-{ctx.partitionId():06d}.bin", None
        for b in batches:
            if len(b):
                held = held or files.open_output_stream(f"{base}/_{name}.{ctx.taskAttemptId()}")
                held.write(encode(b[columns]))
        if held:
            held.close()
            files.move(f"{base}/_{name}.{ctx.taskAttemptId()}", f"{base}/{name}")
        yield pd.DataFrame({"done": [held is not None]})

    df.mapInPandas(run, "done boolean").write.format("noop").mode("overwrite").save()


def pack_longs(rows: pd.DataFrame) -> bytes:
    """Fixed-width little-endian records of integer columns."""
    flat = rows.astype("int64").to_numpy().reshape(-1)
    return struct.pack(f"<{len(flat)}q", *flat)


def unpack_longs(content: bytes, columns: list[str]) -> list[dict]:
    n = len(columns)
    flat = struct.unpack(f"<{len(content) // 8}q", content)
    return [dict(zip(columns, flat[i : i + n])) for i in range(0, len(flat), n)]


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Typed binary records: Parquet."""
    df = spark.read.parquet(path)
    return df if EPOCH in df.columns else with_epoch(df)


def work(spark: SparkSession, splits: list[tuple], schema: str, worker: Callable, out: str) -> DataFrame:
    """A list of splits, each worked off by a task of its own; idle executors take the next."""
    return spark.createDataFrame(splits, schema).repartition(max(1, len(splits))).mapInPandas(worker, out)


class StreamingInput:
    """Batches for explicit epochs in any order, with a low watermark that only rises.

    ``on_notify(e)`` says that nothing at or below e comes any more; rows for such epochs are
    dropped and counted in ``late``, a watermark that doesn't rise is ignored."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.low, self.late, self.done = spark, schema, 0, 0, False
        self.batches: list[tuple[int, list[tuple]]] = []

    def on_recv(self, rows: Iterable[tuple], epoch: int) -> None:
        rows = list(rows)
        if self.done or epoch < self.low:
            self.late += len(rows)
        else:
            self.batches.append((epoch, rows))

    def on_notify(self, epoch: int) -> None:
        self.low = max(self.low, epoch + 1)

    def on_completed(self) -> None:
        self.done = True

    def frame(self) -> DataFrame:
        out = self.spark.createDataFrame([], f"{self.schema}, {EPOCH} int")
        for e, rows in self.batches:
            out = out.unionByName(self.spark.createDataFrame(rows, self.schema).withColumn(EPOCH, F.lit(e)))
        return out

    def closed(self) -> DataFrame:
        """Rows of epochs that the watermark has passed: those whose output is final."""
        df = self.frame()
        return df if self.done else df.filter(F.col(EPOCH) < self.low)


# --- sinks -------------------------------------------------------------------------------------


def write_by_epoch(df: DataFrame, path: str, text: str | None = None, max_records: int = 0) -> DataFrame:
    """Files under ``epoch=<n>`` folders; returns the (epoch, uri) of those that this call wrote.

    Epochs that ``df`` has are written over, those written before stay, so that epochs can be
    written as they close. ``text`` names a column to write as lines; otherwise Parquet.
    Files are cut at ``max_records``. The list of files comes to the driver."""
    spark = df.sparkSession
    fs, folder = file_system(spark, path)

    def files() -> set[str]:
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{EPOCH}=*/part-*")) if fs.exists(folder) else None
        return {str(f.getPath()) for f in found or ()}

    before = files()
    w = (df.select(text, EPOCH) if text else df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(EPOCH)
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    (w.text if text else w.parquet)(path)
    own = sorted(files() - before)
    return spark.createDataFrame([(int(f.split(f"/{EPOCH}=")[-1].split("/")[0]), f) for f in own], f"{EPOCH} int, uri string")


def write_parts(df: DataFrame, path: str, max_records: int, text: str | None = None) -> None:
    """Part files over all epochs, rolled at a number of records."""
    w = (df.select(text) if text else df).write.mode("overwrite").option("maxRecordsPerFile", max_records)
    (w.text if text else w.parquet)(path)


def subscribe(df: DataFrame, action: Callable[[int, list], None]) -> None:
    """``action(epoch, rows)`` on the driver for each epoch in order: a client-side sink that
    holds one epoch at a time."""
    df = cut(df)
    for (e,) in df.select(EPOCH).distinct().orderBy(EPOCH).collect():
        action(e, df.filter(F.col(EPOCH) == e).collect())


def subscribe_partitions(df: DataFrame, action: Callable[[Iterator], None]) -> None:
    """``action`` on the executors, once per partition."""
    df.foreachPartition(action)


def subscribe_by_partition(df: DataFrame, action: Callable[[int, int, list], None]) -> None:
    """``action(partition, epoch, rows)`` on the executors, epochs in order within a partition."""

    def run(rows: Iterator) -> None:
        from itertools import groupby

        from pyspark import TaskContext

        for e, own in groupby(rows, key=lambda r: r[EPOCH]):
            action(TaskContext.get().partitionId(), e, list(own))

    df.sortWithinPartitions(EPOCH).foreachPartition(run)


class Shared:
    """A table that one query hands to others: written once when sealed, read by any number."""

    def __init__(self, df: DataFrame):
        self.table = cut(df)

    def read(self) -> DataFrame:
        return self.table
