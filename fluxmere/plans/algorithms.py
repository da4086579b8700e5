"""Ready-made queries over the operators: counting, lookup, search, and graph algorithms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import graph, iterate
from ..operators.zset import EPOCH, WEIGHT, Collection


def words(df: DataFrame, column: str = "text", *keep: str) -> DataFrame:
    """A row per word of ``column``, words being what white space parts."""
    return df.select(*keep, F.explode(F.split(column, r"[ \t\n\x0b\f\r]+")).alias("word")).filter("word <> ''")


def word_count(df: DataFrame, column: str = "text") -> DataFrame:
    return words(df, column).groupBy("word").agg(F.count("*").alias("count"))


def word_count_changes(lines: Collection, column: str = "text") -> Collection:
    """Changes of word counts over the epochs of a collection of lines."""
    return lines.select_many(F.split(column, " "), "word").count("word")


def terms(df: DataFrame, column: str = "text", *keep: str) -> DataFrame:
    """A row per distinct word of ``column`` in each row: as ``words``, without repeats."""
    return df.select(*keep, F.explode(F.array_distinct(F.split(column, r"[ \t\n\x0b\f\r]+"))).alias("word")).filter("word <> ''")


def search(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(document, query): documents (id, text) with at least ``threshold`` distinct terms of a
    query (id, text, threshold). A document's terms are made distinct in its row and stay
    together, so that its counts combine before they are exchanged; only documents of several
    rows have theirs exchanged. Which ids are repeated is found first."""
    repeated = storage.cut(documents.groupBy(F.col("id").alias("again")).agg(F.count("*").alias("n")).filter("n > 1").select("again"))
    name = F.col("id").alias("document")
    if repeated.isEmpty():
        d = terms(documents, "text", name)
    else:
        same = F.col("id").eqNullSafe(F.col("again"))
        d = terms(documents.join(repeated, same, "left_anti"), "text", name).unionByName(terms(documents.join(repeated, same, "left_semi"), "text", name).distinct())
    q = words(queries, "text", F.col("id").alias("query"), "threshold").distinct()
    hits = d.join(q, "word").groupBy("document", "query", "threshold").agg(F.count("*").alias("n"))
    return hits.filter(F.col("n") >= F.col("threshold")).select("document", "query", "threshold")


def connected_components(edges: DataFrame, greatest: bool = False) -> DataFrame:
    """(node, label) of an undirected graph: the least (or greatest) node of its component.

    Alternates large-star and small-star rounds, O(log n) of them, each a grouped minimum and
    a join; hot nodes are split by adaptive execution, since rows stay two numbers wide."""
    sign = -1 if greatest else 1
    e = edges.select((F.col("source") * sign).alias("u"), (F.col("target") * sign).alias("v"))
    alone = e.select(F.col("u").alias("node")).distinct().unionByName(e.select(F.col("v").alias("node"))).distinct()
    e = storage.cut(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = storage.cut(small.filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == state:
            break
        state = now
    labels = alone.join(e.withColumnRenamed("u", "node"), "node", "left")
    return labels.select((F.col("node") * sign).alias("node"), (F.coalesce("v", "node") * sign).alias("label"))


def component_changes(edges: Collection) -> Collection:
    """(node, label) of the components of a collection of edges (source, target), as they change:
    label the least node of the component, at every epoch at which an edge changes.

    The graphs of all epochs are labelled together, as one graph whose nodes are told apart
    by epoch: as many rounds as one graph takes, and work in proportion to the edges of all
    epochs. Nodes are numbers from 0 on; the epochs are listed on the driver."""
    spans = storage.cut(edges.spans())
    epochs = [r[0] for r in edges.df.select(EPOCH).distinct().orderBy(EPOCH).collect()]
    if not epochs:
        return Collection(edges.df.select(F.col("source").alias("node"), F.col("target").alias("label"), WEIGHT, EPOCH))
    span = (spans.agg(F.max(F.greatest("source", "target"))).first()[0] or 0) + 1
    at = F.explode(F.filter(F.array(*map(F.lit, epochs)), lambda e: (e >= F.col(EPOCH)) & (F.col("until").isNull() | (e < F.col("until")))))
    place = F.array_position(F.array(*map(F.lit, epochs)), F.col("at")) - 1
    tagged = spans.select("source", "target", at.alias("at")).select((place * span + F.col("source")).alias("source"), (place * span + F.col("target")).alias("target"))
    labels = storage.cut(connected_components(tagged))
    no = F.floor(F.col("node") / span).cast("int")
    now = labels.select(F.pmod("node", F.lit(span)).alias("node"), F.pmod("label", F.lit(span)).alias("label"), no.alias("no"))
    known = F.array(*map(F.lit, epochs))
    plus = now.select("node", "label", F.lit(1).cast("long").alias(WEIGHT), F.get(known, F.col("no")).alias(EPOCH))
    minus = now.filter(F.col("no") < len(epochs) - 1).select("node", "label", F.lit(-1).cast("long").alias(WEIGHT), F.get(known, F.col("no") + 1).alias(EPOCH))
    return Collection(plus.unionByName(minus)).consolidate()


def label_propagation(edges: DataFrame, greatest: bool = True) -> DataFrame:
    """(node, label): the greatest (or least) node that reaches each node along edges."""
    start = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct().withColumn("value", F.col("node"))
    keep = F.greatest if greatest else F.least
    out = iterate.until_quiet(start, lambda delta, _: graph.transmit_along(delta, edges), ["node"], "value", keep, hops=3)
    return out.withColumnRenamed("value", "label")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reached from ``roots`` (node) along edges, roots included: breadth-first rounds."""
    seen = storage.cut(roots.select("node").distinct())
    front = seen
    while True:
        step = front.withColumnRenamed("node", "source").join(edges, "source").select(F.col("target").alias("node")).distinct()
        front = storage.cut(step.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = storage.cut(seen.unionByName(front))


def reachability(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """As ``reachable`` for identifiers of any type: names are made dense first and turned back."""
    mapping = storage.cut(graph.AutoRenamer().add(edges, "source", "target").add(roots, "node").finish())
    start = roots.select(F.col("node").alias("name")).join(mapping, "name").select("node")
    return reachable(storage.cut(graph.rename_edges(edges, mapping)), start).join(mapping, "node").select(F.col("name").alias("node"))


def pagerank(edges: DataFrame, iterations: int = 10, reset: float = 0.15, damping: float = 0.85) -> DataFrame:
    """(node, rank) by accumulated deltas: every node with an edge out starts at ``reset``; the
    step runs ``iterations`` + 1 times and passes on damped shares along edges."""
    edges = storage.cut(edges.select("source", "target").repartition("source"))
    degrees = storage.cut(graph.count_nodes(edges.select(F.col("source").alias("node"))))
    start = degrees.select("node", F.lit(reset).alias("value"))

    def step(deltas: DataFrame) -> DataFrame:
        share = graph.node_join(deltas, degrees, lambda v, d: F.when(d > 0, v * (F.lit(damping) / d)).otherwise(0.0), 0)
        return graph.graph_reduce(share, edges).filter("value > 0")

    ranks = iterate.iterate_and_accumulate(start, step, iterations).unionByName(start)
    return graph.node_aggregate(ranks).filter("value > 0").withColumnRenamed("value", "rank")


def trim_leaves(edges: DataFrame) -> DataFrame:
    """Edges that remain when those into nodes without an edge out are taken away, over and over,
    three times between one count and the next."""
    e, n = storage.cut(edges.select("source", "target").distinct()), -1
    while (m := e.count()) != n:
        n, last = m, e
        for _ in range(3):
            e = e.join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        e = storage.cut(e.select("source", "target"))
        storage.drop(last)
    return e


def flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def _trim_both(edges: DataFrame) -> DataFrame:
    """Edges that remain when those from nodes without an edge in and into nodes without an edge out
    are taken away, over and over, four times between one count and the next."""
    e, n = storage.cut(edges.select("source", "target").distinct()), -1
    while (m := e.count()) != n:
        n, last = m, e
        for _ in range(4):
            e = e.join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        e = storage.cut(e.select("source", "target"))
        storage.drop(last)
    return e


def _ends(edges: DataFrame) -> DataFrame:
    """(node, first, last): the least node that reaches each node, and the least that it reaches,
    itself included. Both directions take their rounds together."""
    both = edges.select(F.lit(0).alias("way"), "source", "target").unionByName(flip(edges).withColumn("way", F.lit(1)))
    both = storage.cut(both.select("way", F.col("source").alias("node"), "target"))
    start = both.select("way", "node").unionByName(both.select("way", F.col("target").alias("node"))).distinct().withColumn("value", F.col("node"))
    step = lambda delta, _: delta.join(both, ["way", "node"]).select("way", F.col("target").alias("node"), "value")
    out = iterate.until_quiet(start, step, ["way", "node"], "value", F.least, hops=4)
    return storage.cut(out.groupBy("node").agg(F.min(F.when(F.col("way") == 0, F.col("value"))).alias("first"), F.min(F.when(F.col("way") == 1, F.col("value"))).alias("last")))


def strong_labels(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes on cycles: the least node of the strong component.

    Trims what leads into or out of cycles only. Then a node whose least reaching and least
    reached nodes are one has that node's component, and leaves; edges between nodes that
    differ in either lie between components, and leave; the rest goes round again."""
    e, settled = _trim_both(edges), edges.select(F.col("source").alias("node"), F.col("source").alias("label")).limit(0)
    while not e.isEmpty():
        ends = _ends(e)
        settled = settled.unionByName(ends.filter(F.col("first") == F.col("last")).select("node", F.col("first").alias("label")))
        rest = ends.filter(F.col("first") != F.col("last"))
        a = rest.select(F.col("node").alias("source"), "first", "last")
        b = rest.select(F.col("node").alias("target"), "first", "last")
        e = storage.cut(e.join(a, "source").join(b, ["target", "first", "last"]).select("source", "target"))
    return settled


def scc_edges(edges: DataFrame) -> DataFrame:
    """Edges inside strongly connected components."""
    labels = storage.cut(strong_labels(edges))
    a = labels.select(F.col("node").alias("source"), "label")
    b = labels.select(F.col("node").alias("target"), "label")
    return edges.select("source", "target").distinct().join(a, "source").join(b, ["target", "label"]).select("source", "target")


def strongly_connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes: the least node of its strong component; lone nodes are their own."""
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    return nodes.join(strong_labels(edges), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


UNSET = 2**31 - 1


def colour(edges: DataFrame) -> DataFrame:
    """(node, colour): each node takes the least colour that no lower-numbered neighbour has.

    A node is settled once all its lower neighbours are. A round looks at the pairs of open
    nodes only, and at the colours that the round before it has set."""
    pairs = edges.filter("source <> target").select(F.greatest("source", "target").alias("node"), F.least("source", "target").alias("lower")).distinct()
    open_pairs = storage.cut(pairs.withColumn("colour", F.lit(None).cast("int")))
    fresh = open_pairs.select(F.col("lower").alias("node")).distinct().join(open_pairs.select("node").distinct(), "node", "left_anti").withColumn("colour", F.lit(0))
    settled = [storage.cut(fresh)]
    # the first place where the sorted used colours leave a gap
    free = F.aggregate("used", F.lit(0), lambda a, c: F.when(c == a, a + 1).otherwise(a)).cast("int")
    while not settled[-1].isEmpty():
        known = settled[-1].select(F.col("node").alias("lower"), F.col("colour").alias("new"))
        filled = storage.cut(open_pairs.join(known, "lower", "left").select("node", "lower", F.coalesce("colour", "new").alias("colour")))
        storage.drop(open_pairs)
        # a set of colours has as many as the graph at most, however many neighbours a node has
        of_node = filled.groupBy("node").agg(F.count(F.when(F.col("colour").isNull(), 1)).alias("open"), F.sort_array(F.collect_set("colour")).alias("used"))
        settled.append(storage.cut(of_node.filter("open = 0").select("node", free.alias("colour"))))
        open_pairs = filled.join(settled[-1].select("node"), "node", "left_anti")
    return reduce(DataFrame.unionByName, settled)


def colour_conflicts(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """Edges whose ends have one colour: none in a proper colouring."""
    a = colours.select(F.col("node").alias("source"), F.col("colour").alias("ca"))
    b = colours.select(F.col("node").alias("target"), F.col("colour").alias("cb"))
    return edges.filter("source <> target").join(a, "source").join(b, "target").filter("ca = cb").select("source", "target")


def component_sizes(labels: DataFrame) -> DataFrame:
    """How many components there are of each size."""
    return labels.groupBy("label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


def random_graph(spark: SparkSession, nodes: int, edges: int, seed: int = 0) -> DataFrame:
    """Uniform random edges; self-loops and repeats are possible."""
    pick = lambda s: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(s)), F.lit(nodes))
    return spark.range(edges).select(pick(1).alias("source"), pick(2).alias("target"))


def exchange(pairs: DataFrame, key: Column, partitions: int) -> DataFrame:
    """Send every row to its key's partition: a shuffle and nothing else."""
    return pairs.withColumn("key", key).repartition(partitions, "key")
