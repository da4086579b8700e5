"""Structured Streaming forms: epochs from files, watermarks, windows, state, change sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.zset import EPOCH, WEIGHT
from ..storage import file_system


def file_epochs(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_epoch: int = 1) -> DataFrame:
    """A stream whose micro-batches, the epochs, are ``per_epoch`` files each."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_epoch).format(fmt).load(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines typed into a socket, for interactive use: nothing is replayed after a failure."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def synced(query: StreamingQuery) -> None:
    """Wait until all that has arrived is processed and out."""
    query.processAllAvailable()


class Frontier:
    """Calls ``action(epoch, rows, watermark)`` after every epoch of any query of the session."""

    def __init__(self, spark: SparkSession, action: Callable[[int, int, str | None], None]):
        from pyspark.sql.streaming import StreamingQueryListener

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):  # noqa: N802
                pass

            def onQueryProgress(self, event):  # noqa: N802
                p = event.progress
                action(p.batchId, p.numInputRows, p.eventTime.get("watermark"))

            def onQueryIdle(self, event):  # noqa: N802
                pass

            def onQueryTerminated(self, event):  # noqa: N802
                pass

        self.spark, self.listener = spark, Listener()
        spark.streams.addListener(self.listener)

    def close(self) -> None:
        self.spark.streams.removeListener(self.listener)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Rows later than the watermark are dropped by what follows; a column without time zone is
    taken as session time."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling(df: DataFrame, column: str, length: str, *aggs: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(F.window(column, length), *keys).agg(*aggs)


def sliding(df: DataFrame, column: str, length: str, slide: str, *aggs: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(F.window(column, length, slide), *keys).agg(*aggs)


def sessions(df: DataFrame, column: str, gap: str, *aggs: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(F.session_window(column, gap), *keys).agg(*aggs)


def streaming_count(df: DataFrame, *keys: str) -> DataFrame:
    """Cumulative counts; in update mode an epoch gives the keys it changed."""
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def to_table(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Run all that is available into a memory table: for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def join_within(a: DataFrame, b: DataFrame, keys: list[str], column: str, delay: str, length: str) -> DataFrame:
    """Stream-stream join of rows that share ``keys`` and a tumbling window: state is dropped once
    the watermark has passed the window. ``b``'s other columns must not clash with ``a``'s."""
    w = lambda df: event_time(df, column, delay).withColumn("window", F.window(column, length))
    right = w(b).select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("window").alias("r_window"), *[c for c in b.columns if c not in (*keys, column)])
    same = F.col("window") == F.col("r_window")
    for k in keys:
        same &= F.col(k) == F.col(f"r_{k}")
    return w(a).join(right, same).drop("r_window", *[f"r_{k}" for k in keys])


def for_each_epoch(df: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """``action(rows, epoch)`` per micro-batch; with the checkpoint and an idempotent action each
    epoch takes effect once."""
    q = df.writeStream.outputMode(mode).foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def to_files(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run all that is available into files below ``out``, and read these: no row passes the driver.

    A folder an epoch, written over, so a repeated one is harmless; in complete mode an epoch
    holds all rows, so that the ones before it are deleted."""
    fs, base = file_system(df.sparkSession, out)
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{EPOCH}={epoch}")
        if mode == "complete":
            for f in fs.listStatus(base):
                if int(f.getPath().getName().split("=")[1]) < epoch:
                    fs.delete(f.getPath(), True)

    fs.mkdirs(path(out))
    for_each_epoch(df, write, checkpoint, mode)
    return df.sparkSession.read.schema(df.schema).parquet(*[f.getPath().toString() for f in fs.listStatus(base)] or [out])


def changes_of(counts: DataFrame, keys: list[str], value: str, out: str, checkpoint: str) -> StreamingQuery:
    """Weighted changes of an update-mode aggregate, written per epoch below ``out``: the old row
    with weight -1, the new one with +1; rows that stay as they were are no change.

    Next to the checkpoint stand the rows as of the last epochs, so that an epoch reads these
    and not all changes before it. Written over by epoch, so a repeated one is harmless."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fs, base = file_system(spark, f"{checkpoint}-rows")
        known = sorted(int(f.getPath().getName()) for f in (fs.listStatus(base) if fs.exists(base) else ()))
        last = [e for e in known if e < epoch][-1:]
        batch = batch.select(*keys, value).persist()
        plus = batch.select(*keys, value, F.lit(1).cast("long").alias(WEIGHT))
        now = batch
        if last:
            held = spark.read.schema(batch.schema).parquet(f"{checkpoint}-rows/{last[0]}")
            old = held.join(batch.select(*keys), keys, "left_semi")
            plus = plus.unionByName(old.select(*keys, value, F.lit(-1).cast("long").alias(WEIGHT)))
            now = held.join(batch.select(*keys), keys, "left_anti").unionByName(batch)
        changes = plus.groupBy(*keys, value).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(F.col(WEIGHT) != 0)
        changes.withColumn(EPOCH, F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/{EPOCH}={epoch}")
        now.write.mode("overwrite").parquet(f"{checkpoint}-rows/{epoch}")
        for e in known:
            if e < epoch - 1:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(base, str(e)), True)
        batch.unpersist()

    return for_each_epoch(counts, write, checkpoint, "update")


def machine(df: DataFrame, key: str, step: Callable[[pd.DataFrame, tuple | None], tuple[tuple, list[tuple]]], out_schema: str, state_schema: str, mode: str = "update") -> DataFrame:
    """A state machine per key that lives across epochs: ``step(rows, state)`` gives the new state
    and output rows. State is never reset."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [f.strip().split()[0] for f in out_schema.split(",")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        for b in batches:
            now, rows = step(b, now)
            yield pd.DataFrame(rows, columns=names)
        state.update(now)

    return df.groupBy(key).applyInPandasWithState(run, out_schema, state_schema, mode, GroupStateTimeout.NoTimeout)


def late_rows(df: DataFrame, column: str, low: Column) -> DataFrame:
    """Rows below a low watermark: what an epoch-holding input would drop, to be counted."""
    return df.filter(F.col(column) < low)
