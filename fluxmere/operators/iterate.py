"""Loops over frames: bounded iteration and accumulation, with lineage cut each round."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage


def iterate(start: DataFrame, body: Callable[[DataFrame], DataFrame], iterations: int) -> DataFrame:
    """The body's last result; the body runs ``iterations`` + 1 times."""
    x = start
    for _ in range(iterations + 1):
        x = storage.cut(body(x))
    return x


def iterate_and_accumulate(start: DataFrame, body: Callable[[DataFrame], DataFrame], iterations: int) -> DataFrame:
    """All results of the body, which runs ``iterations`` + 1 times or until it gives nothing.
    The start is not among them."""
    x, out = start, None
    for _ in range(iterations + 1):
        x = storage.cut(body(x))
        if x.isEmpty():
            break
        out = x if out is None else out.unionByName(x)
    return x if out is None else out


def entering(rows: DataFrame, iteration: Column) -> Callable[[int], DataFrame]:
    """Rows by the iteration at which they enter a loop."""
    tagged = rows.withColumn("iteration", iteration.cast("int"))
    return lambda i: tagged.filter(F.col("iteration") == i).drop("iteration")


def leaving(results: list[DataFrame], first: int = 0) -> DataFrame:
    """Results of iterations from ``first`` on leave the loop."""
    out = results[first]
    for r in results[first + 1 :]:
        out = out.unionByName(r)
    return out


def until_quiet(state: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], value: str, keep: Callable = F.least, hops: int = 1) -> DataFrame:
    """Semi-naive evaluation of a monotone query over (keys, value): ``step(delta, state)``
    proposes values; only rows that improve their key's value go into the next round.

    A round takes ``hops`` steps, each from what the one before it proposed, and compares all
    proposals with the state at once: the state is written once for that many steps."""
    f = F.min if keep is F.least else F.max
    state = storage.cut(state.groupBy(*keys).agg(f(value).alias(value)))
    delta, before = state, None
    while True:
        parts = [step(delta, state).groupBy(*keys).agg(f(value).alias(value))]
        for _ in range(hops - 1):
            parts.append(step(parts[-1], state).groupBy(*keys).agg(f(value).alias(value)))
        proposed = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(f(value).alias("new"))
        joined = state.join(proposed, keys, "full")
        better = F.col("new").isNotNull() & (F.col(value).isNull() | (keep(F.col(value), F.col("new")) != F.col(value)))
        joined = storage.cut(joined.select(*keys, F.when(better, F.col("new")).otherwise(F.col(value)).alias(value), better.alias("better")))
        if before is not None:
            storage.drop(before)
        before, state, delta = joined, joined.drop("better"), joined.filter("better").drop("better")
        if delta.isEmpty():
            return state
