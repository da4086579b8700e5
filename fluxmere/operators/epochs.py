"""Relational operators over epochs: every epoch of a frame is a batch of its own.

A frame is a DataFrame with an ``epoch`` column; other columns are the record. Identity of
records (distinct, set operations) is null-safe, join keys compare by plain equality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "epoch"


def with_epoch(df: DataFrame, epoch: Column | int = 0) -> DataFrame:
    """A finite table as a frame: all in epoch 0, or where ``epoch`` says."""
    return df.withColumn(EPOCH, (F.lit(epoch) if isinstance(epoch, int) else epoch).cast("int"))


def record(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (EPOCH, "weight")]


def select(df: DataFrame, *exprs: Column | str) -> DataFrame:
    return df.select(*exprs, EPOCH)


def where(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.filter(predicate)


def select_many(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """Flat-map: a row per element of ``array``; null and empty arrays give none."""
    return df.select(*keep, F.explode(array).alias(name), EPOCH)


def select_by_vertex(df: DataFrame, f: Callable[[Column], Column], name: str) -> DataFrame:
    """Map that also sees which partition holds the row."""
    return df.withColumn(name, f(F.spark_partition_id()))


def concat(*frames: DataFrame) -> DataFrame:
    """Bag union."""
    return reduce(DataFrame.unionByName, frames)


def distinct(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set union within each epoch."""
    return a.unionByName(b).dropDuplicates()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set intersection within each epoch."""
    return a.intersect(b.select(*a.columns))


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a``, with their repeats, of which ``b`` has no copy in the same epoch."""
    right = b.select(*[F.col(c).alias(f"r_{c}") for c in a.columns]).dropDuplicates()
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in a.columns])
    return a.join(right, same, "left_anti")


def join(a: DataFrame, b: DataFrame, keys: Sequence[str], *result: Column | str) -> DataFrame:
    """Inner equi-join within each epoch."""
    out = a.join(b, [EPOCH, *keys])
    return out.select(*result, EPOCH) if result else out


def node_table_join(a: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table that holds for every epoch."""
    return a.join(table, list(keys), how)


def aggregate(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Commutative fold per key and epoch; map-side combination is the planner's."""
    return df.groupBy(EPOCH, *keys).agg(*aggs)


def count(df: DataFrame) -> DataFrame:
    """Number of copies of each distinct record."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("count"))


def minimum(df: DataFrame, keys: Sequence[str], value: Column, name: str = "value") -> DataFrame:
    return aggregate(df, keys, F.min(value).alias(name))


def maximum(df: DataFrame, keys: Sequence[str], value: Column, name: str = "value") -> DataFrame:
    return aggregate(df, keys, F.max(value).alias(name))


def fold(df: DataFrame, keys: Sequence[str], state: Column, zero: Column, combine: Callable[[Column, Column], Column], result: Callable[[Column], Column] | None = None, name: str = "value") -> DataFrame:
    """Fold with a combiner given as a Column function, where no built-in aggregate fits.

    A group's states are collected in one row; use ``aggregate`` for groups without bound."""
    folded = F.aggregate(F.collect_list(state), zero, combine, result)
    return df.groupBy(EPOCH, *keys).agg(folded.alias(name))


def group_by(df: DataFrame, keys: Sequence[str], reducer: Callable, schema: str) -> DataFrame:
    """Opaque reducer: pandas rows of one key and epoch in, any number of rows out."""
    return df.groupBy(EPOCH, *keys).applyInPandas(reducer, schema)


def group_lists(df: DataFrame, keys: Sequence[str], value: Column, name: str = "values") -> DataFrame:
    """Sorted list of a key's values per epoch, for reducers that Column functions can express."""
    return df.groupBy(EPOCH, *keys).agg(F.sort_array(F.collect_list(value)).alias(name))


def co_group(a: DataFrame, b: DataFrame, keys: Sequence[str], left: Column, right: Column) -> DataFrame:
    """Aggregates of both sides for keys of either side (null where a side has none)."""
    return a.groupBy(EPOCH, *keys).agg(left.alias("left")).join(b.groupBy(EPOCH, *keys).agg(right.alias("right")), [EPOCH, *keys], "full")


#: Types whose values look the same in pandas whatever rows are beside them, but for nulls.
FLAT = {"byte", "short", "integer", "long", "boolean", "float", "double", "string", "date", "timestamp", "timestamp_ntz", "decimal", "binary"}


def _frame(rows: pd.DataFrame | list[tuple], names: Sequence[str]) -> pd.DataFrame:
    return rows if isinstance(rows, pd.DataFrame) else pd.DataFrame(rows, columns=names, dtype=object)


def co_group_by(a: DataFrame, b: DataFrame, keys: Sequence[str], reducer: Callable, schema: str) -> DataFrame:
    """Opaque reducer over both sides' pandas rows of one key and epoch: gives a pandas frame, or a
    list of tuples in the order of ``schema``.

    Rows of many groups go to Python in one batch, sorted by key, and are cut there; one
    group is held at a time. Only nested columns, whose pandas form depends on the other rows
    of a batch, take a round trip a group."""
    by, names = [EPOCH, *keys], a.sparkSession.createDataFrame([], schema).columns
    if {f.dataType.typeName() for df in (a, b) for f in df.schema} - FLAT:
        return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(lambda x, y: _frame(reducer(x, y), names), schema)
    # other types have the same pandas type with nulls and without
    plain = {c: {f.name: f.dataType.typeName() for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "boolean")} for c, df in (("a", a), ("b", b))}

    def side(df: DataFrame, own: str) -> DataFrame:
        cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)] + [F.lit(own == "b").alias("right")]
        for tag, of in (("a", a), ("b", b)):
            for i, f in enumerate(of.schema):
                c = F.col(f"`{f.name}`") if tag == own else F.lit(None).cast(f.dataType)
                if f.name in plain[tag]:
                    cols.append((c.isNull() if tag == own else F.lit(False)).alias(f"{tag}{i}_null"))
                    c = F.coalesce(c, F.lit(0).cast(f.dataType))
                cols.append(c.alias(f"{tag}{i}"))
        return df.select(*cols)

    k = [f"k{i}" for i in range(len(by))]
    rows = side(a, "a").unionByName(side(b, "b"))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy(*k).orderBy("right")) == 1).drop(*k)
    columns = {"a": a.columns, "b": b.columns}
    def part(pdf: pd.DataFrame, tag: str) -> Callable[[int, int], pd.DataFrame]:
        """(from, to) -> these rows, as they would be without the others."""
        frame = pdf[[f"{tag}{i}" for i in range(len(columns[tag]))]].set_axis(columns[tag], axis=1)
        flags = {c: pdf[f"{tag}{i}_null"].to_numpy(bool) for i, c in enumerate(columns[tag]) if c in plain[tag]}
        flags = {c: f for c, f in flags.items() if f.any()}

        def get(i: int, j: int) -> pd.DataFrame:
            out = frame.iloc[i:j]
            out.index = pd.RangeIndex(j - i)
            for c, f in flags.items():
                if f[i:j].any():
                    kind, none = (object, None) if plain[tag][c] == "boolean" else ("float64", float("nan"))
                    values = out[c].to_numpy().astype(kind)
                    values[f[i:j]] = none
                    out = out.assign(**{c: values})
            return out

        return get

    def reduced(pdf: pd.DataFrame, starts: list[int]) -> Iterator[pd.DataFrame]:
        """Results of whole groups; frames of one kind come as one, so that none changes its types."""
        right = pdf["right"].to_numpy(bool)
        left, other = part(pdf[~right], "a"), part(pdf[right], "b")
        at = [0, *(~right).cumsum().tolist()]
        tuples, frames = [], []
        for i, j in zip(starts, [*starts[1:], len(pdf)]):
            out = reducer(left(at[i], at[j]), other(i - at[i], j - at[j]))
            if not isinstance(out, pd.DataFrame):
                tuples += out
                continue
            if frames and not out.dtypes.equals(frames[-1].dtypes):
                yield pd.concat(frames, ignore_index=True)
                frames = []
            frames.append(out)
        if frames:
            yield pd.concat(frames, ignore_index=True)
        if tuples:
            yield _frame(tuples, names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            starts = pdf["first"].to_numpy(bool).nonzero()[0].tolist()
            if not starts:
                held.append(pdf)
                continue
            if held:
                yield from reduced(pd.concat([*held, pdf.iloc[: starts[0]]], ignore_index=True), [0])
            yield from reduced(pdf.iloc[starts[0] : starts[-1]], [i - starts[0] for i in starts[:-1]])
            held = [pdf.iloc[starts[-1] :]]
        if held:
            yield from reduced(pd.concat(held, ignore_index=True), [0])

    return rows.mapInPandas(run, schema)


def semi_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(EPOCH, *keys), [EPOCH, *keys], "left_semi")


def unary_expression(df: DataFrame, f: Callable, schema: str, *keys: str) -> DataFrame:
    """Arbitrary function over the batches of a partition, rows of a key together."""
    return (df.repartition(*keys) if keys else df).mapInPandas(f, schema)


def binary_expression(a: DataFrame, b: DataFrame, keys: Sequence[str], f: Callable, schema: str, buckets: int = 64) -> DataFrame:
    """Arbitrary function over two inputs: co-grouped buckets of hashed keys."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    return a.withColumn("bucket", bucket).groupBy("bucket").cogroup(b.withColumn("bucket", bucket).groupBy("bucket")).applyInPandas(f, schema)


def partition_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys)


def assume_partitioned_by(df: DataFrame, *keys: str) -> DataFrame:
    """Nothing to do: the planner knows what it has partitioned."""
    return df


def misplaced(df: DataFrame, *keys: str) -> DataFrame:
    """Keys whose rows lie in more than one partition (none after ``partition_by``)."""
    return df.select(*keys, F.spark_partition_id().alias("part")).distinct().groupBy(*keys).agg(F.count("*").alias("parts")).filter("parts > 1")


def synchronize(df: DataFrame) -> DataFrame:
    """Nothing to do: stages are barriers."""
    return df


def running_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cumulative count over epochs; a key appears in the epochs in which it changes."""
    n = df.groupBy(EPOCH, *keys).agg(F.count("*").alias("n"))
    return n.withColumn("count", F.sum("n").over(Window.partitionBy(*keys).orderBy(EPOCH))).drop("n")


def running_extreme(df: DataFrame, keys: Sequence[str], value: Column, greatest: bool = True) -> DataFrame:
    """Best value so far; a key appears at first sight and whenever its value changes."""
    f, worst = (F.max, F.min) if greatest else (F.min, F.max)
    best = df.groupBy(EPOCH, *keys).agg(f(value).alias("v"))
    w = Window.partitionBy(*keys).orderBy(EPOCH)
    now = best.withColumn("value", f("v").over(w))
    return now.withColumn("before", F.lag("value").over(w)).filter(~F.col("value").eqNullSafe(F.col("before"))).drop("v", "before")


def lookup(puts: DataFrame, gets: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """Last-write-wins table probed by keys: gets see the latest put of their epoch or before.

    Within an epoch the greatest ``order`` wins and puts come first. Missing keys give nothing.
    """
    last = puts.groupBy(EPOCH, key).agg(F.max_by(value, order).alias(value))
    rows = last.select(EPOCH, key, value, F.lit(0).alias("get")).unionByName(gets.select(EPOCH, key, F.lit(1).alias("get")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(EPOCH, "get").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn(value, F.last(value, ignorenulls=True).over(w))
    return seen.filter((F.col("get") == 1) & F.col(value).isNotNull()).drop("get")


def local_reduce(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Fold within each partition only: a key may give several rows. ``aggregate`` over the
    result finishes it; the planner does both by itself for built-in aggregates."""
    return df.withColumn("part", F.spark_partition_id()).groupBy(EPOCH, "part", *keys).agg(*aggs)


def broadcast_reduce(df: DataFrame, *aggs: Column) -> DataFrame:
    """Every row with its epoch's aggregates: an all-reduce. One row per epoch is joined back."""
    return df.join(df.groupBy(EPOCH).agg(*aggs), EPOCH)


def report(df: DataFrame, name: str, value: Column) -> DataFrame:
    """(name, epoch, n, total, least, greatest, mean) of reported values."""
    return df.groupBy(F.col(name).alias("name"), EPOCH).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"))


def select_many_segments(df: DataFrame, segments: Column, name: str, *keep: str) -> DataFrame:
    """Flat-map whose function gives a list of segments: all their elements, in one go."""
    return select_many(df, F.flatten(segments), name, *keep)


def cross(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join by a constant key within each epoch. For small sides: every row meets every other."""
    return a.join(b, EPOCH)
