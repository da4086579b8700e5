"""Node and edge operators: nodes are ``(node, value)`` rows, edges ``(source, target)`` rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transmit_along(values: DataFrame, edges: DataFrame, selector: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(target, value) for each value and each edge out of its node; repeated edges count."""
    out = values.withColumnRenamed("node", "source").join(edges.select("source", "target"), "source")
    value = F.col("value") if selector is None else selector(F.col("value"), F.col("target"))
    return out.select(F.col("target").alias("node"), value.alias("value"))


def node_aggregate(values: DataFrame, combiner: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Fold of each node's values; nodes without a value give no row."""
    return values.groupBy("node").agg(combiner("value").alias("value"))


def graph_reduce(values: DataFrame, edges: DataFrame, combiner: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Transmit along edges and fold at the targets; partial folds before the shuffle are the planner's."""
    return node_aggregate(transmit_along(values, edges), combiner)


def node_join(values: DataFrame, states: DataFrame, result: Callable[[Column, Column], Column], default) -> DataFrame:
    """Each value with its node's state, ``default`` where it has none."""
    s = states.select("node", F.col("value").alias("state"))
    return values.join(s, "node", "left").select("node", result(F.col("value"), F.coalesce("state", F.lit(default))).alias("value"))


def filter_by(values: DataFrame, restriction: DataFrame) -> DataFrame:
    """Values of nodes in ``restriction``, whatever their multiplicity there."""
    return values.join(restriction.select("node"), "node", "left_semi")


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("node").distinct()


def count_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(F.count("*").alias("value"))


def filter_options(values: DataFrame) -> DataFrame:
    return values.filter(F.col("value").isNotNull())


def symmetrise(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))


# --- naming ----------------------------------------------------------------------------------


def dense_names(identifiers: DataFrame, column: str = "name", buckets: int = 256) -> DataFrame:
    """(name, node): distinct identifiers to 0..n-1, the same on every run.

    Two-level: hash buckets get offsets from their sizes, names are ranked within a bucket,
    so no task sees all of them."""
    names = identifiers.select(F.col(column).alias("name")).distinct().withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)))
    sizes = names.groupBy("bucket").agg(F.count("*").alias("n"))
    base = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))
    ranked = names.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("name")) - 1)
    return ranked.join(base, "bucket").select("name", (F.col("base") + F.col("rank")).alias("node"))


def rename_nodes(values: DataFrame, mapping: DataFrame, column: str = "name") -> DataFrame:
    """Replace identifier ``column`` by its node; unmatched rows leave."""
    return values.join(mapping.withColumnRenamed("name", column), column).drop(column)


def rename_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between identifiers to edges between nodes; kept if both ends are mapped."""
    s = mapping.select(F.col("name").alias("source"), F.col("node").alias("s"))
    t = mapping.select(F.col("name").alias("target"), F.col("node").alias("t"))
    return edges.join(s, "source").join(t, "target").select(F.col("s").alias("source"), F.col("t").alias("target"))


def duplicate_names(mapping: DataFrame) -> DataFrame:
    """Identifiers that a mapping holds more than once: renaming by it would be ambiguous."""
    return mapping.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


class AutoRenamer:
    """One mapping for identifiers that come from several inputs."""

    def __init__(self):
        self.inputs: list[DataFrame] = []

    def add(self, df: DataFrame, *columns: str) -> AutoRenamer:
        self.inputs += [df.select(F.col(c).alias("name")) for c in columns]
        return self

    def finish(self) -> DataFrame:
        names = self.inputs[0]
        for x in self.inputs[1:]:
            names = names.unionByName(x)
        return dense_names(names)


# --- state machines ----------------------------------------------------------------------------


def state_machine(values: DataFrame, order: str, default: Column, transition: Callable[[Column, Column], Column], initial: DataFrame | None = None) -> DataFrame:
    """(node, value): final state of each node after its values in ``order``, by a Column fold.

    For transitions that depend on order. Where they don't, a grouped aggregate compared with
    the state before is the same and needs no list of a node's values."""
    lists = values.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").alias("v")))).alias("vs"))
    start = default
    if initial is not None:
        lists = lists.join(initial.select("node", F.col("value").alias("s0")), "node", "left")
        start = F.coalesce("s0", default)
    return lists.select("node", F.aggregate("vs", start, lambda s, x: transition(x["v"], s)).alias("value"))


def state_machine_stream(values: DataFrame, order: str, default, transition: Callable, changes: bool = False, value_type: str = "long") -> DataFrame:
    """(node, order, value): as ``state_machine``, with a plain Python ``transition(value, state)``.

    Rows stream by sorted by node and order, and only one state is held, so a node's history
    has no bound. Gives each node's last state, or with ``changes`` every state that differs
    from the one before it."""
    kind = values.schema[order].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, at, state, begun = None, None, default, False
        for b in batches:
            out = []
            for n, o, v in zip(b["node"].tolist(), b["o"].tolist(), b["v"].tolist()):
                if not begun or n != node:
                    if begun and not changes:
                        out.append((node, at, state))
                    node, state, begun = n, default, True
                new = transition(v, state)
                if changes and new != state:
                    out.append((n, o, new))
                at, state = o, new
            yield pd.DataFrame(out, columns=["node", order, "value"])
        if begun and not changes:
            yield pd.DataFrame([(node, at, state)], columns=["node", order, "value"])

    rows = values.select("node", F.col(order).alias("o"), F.col("value").alias("v")).repartition("node").sortWithinPartitions("node", "o")
    return rows.mapInPandas(run, f"node {values.schema['node'].dataType.simpleString()}, {order} {kind}, value {value_type}")


def state_machine_outputs(values: DataFrame, order: str, default, transition: Callable, out_type: str = "long") -> DataFrame:
    """(node, order, out): an output for every input, of a plain Python ``transition(value, state)``
    that gives the new state and the output. Rows stream by as in ``state_machine_stream``."""
    kind = values.schema[order].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state, begun = None, default, False
        for b in batches:
            out = []
            for n, o, v in zip(b["node"].tolist(), b["o"].tolist(), b["v"].tolist()):
                if not begun or n != node:
                    node, state, begun = n, default, True
                state, x = transition(v, state)
                out.append((n, o, x))
            yield pd.DataFrame(out, columns=["node", order, "out"])

    rows = values.select("node", F.col(order).alias("o"), F.col("value").alias("v")).repartition("node").sortWithinPartitions("node", "o")
    return rows.mapInPandas(run, f"node {values.schema['node'].dataType.simpleString()}, {order} {kind}, out {out_type}")


def state_changes(values: DataFrame, order: str, default: Column, transition: Callable[[Column, Column], Column]) -> DataFrame:
    """(node, order, value): each state that differs from the one before it."""
    lists = values.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").alias("v")))).alias("vs"))
    state = F.struct(default.alias("s"), F.lit(0).cast("long").alias("o"), F.lit(False).alias("c"))

    def step(acc: Column, x: Column) -> Column:
        s = transition(x["v"], F.element_at(acc, -1)["s"])
        return F.concat(acc, F.array(F.struct(s.alias("s"), x["o"].cast("long").alias("o"), (~s.eqNullSafe(F.element_at(acc, -1)["s"])).alias("c"))))

    seen = lists.select("node", F.explode(F.aggregate("vs", F.array(state), step)).alias("x"))
    return seen.filter("x.c").select("node", F.col("x.o").alias(order), F.col("x.s").alias("value"))
