"""Epoch, loop, graph, source, sink and streaming operators against plain Python."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxmere import storage
from fluxmere.operators import epochs as l1
from fluxmere.operators import graph, iterate
from fluxmere.plans import algorithms
from fluxmere.sources import io
from fluxmere.streaming import streams


def frame(spark, rows, schema="x string, epoch int"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_set_operations_differ_by_kind(spark):
    a = frame(spark, [("r", 0)] * 3 + [("s", 0)] * 2 + [(None, 0)])
    b = frame(spark, [("r", 0), ("s", 1), (None, 0)])
    assert l1.concat(a, b).count() == 9
    assert rows(l1.union(a, b)) == sorted([("r", 0), ("s", 0), ("s", 1), (None, 0)], key=str)
    assert rows(l1.intersect(a, b)) == sorted([("r", 0), (None, 0)], key=str)
    assert rows(l1.except_(a, b)) == [("s", 0), ("s", 0)]


def test_epochs_do_not_mix(spark):
    a = frame(spark, [("k", 0), ("k", 1)])
    assert rows(l1.count(a)) == [("k", 0, 1), ("k", 1, 1)]
    assert l1.join(a, frame(spark, [("k", 1)]), ["x"]).count() == 1


def test_running_and_lookup(spark):
    e = frame(spark, [("a", 1, 0), ("a", 1, 2), ("a", 5, 2), ("a", 2, 3)], "k string, v int, epoch int")
    assert rows(l1.running_extreme(e, ["k"], F.col("v")).select("epoch", "value")) == [(0, 1), (2, 5)]
    assert rows(l1.running_count(e, ["k"]).select("epoch", "count")) == [(0, 1), (2, 3), (3, 4)]
    gets = frame(spark, [("a", 1), ("b", 1), ("a", 2)], "k string, epoch int")
    assert rows(l1.lookup(e, gets, "k", "v", F.col("v")).select("epoch", "k", "v")) == [(1, "a", 1), (2, "a", 5)]


def test_batches_keep_empty_epochs_apart(spark):
    b = io.from_batches(spark, [[("a",)], [], [("b",), ("a",)]], "x string")
    assert rows(b) == [("a", 0), ("a", 2), ("b", 2)]
    assert io.empty(spark, "x string").count() == 0
    assert rows(io.constant(spark, "p", "q", schema="x string")) == [("p", 0), ("q", 0)]


def test_iterate_runs_once_more_than_its_bound(spark):
    s = frame(spark, [(0, 0)], "x int, epoch int")
    up = lambda d: d.withColumn("x", F.col("x") + 1)
    assert rows(iterate.iterate(s, up, 3).select("x")) == [(4,)]
    assert rows(iterate.iterate_and_accumulate(s, up, 3).select("x")) == [(1,), (2,), (3,), (4,)]
    assert rows(iterate.iterate_and_accumulate(s, lambda d: up(d).filter("x < 3"), 9).select("x")) == [(1,), (2,)]
    enter = iterate.entering(s, F.col("x"))
    assert enter(0).count() == 1 and enter(1).count() == 0


def _random_edges(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def _reach(edges, start):
    seen, todo = set(start), list(start)
    out = {}
    for s, t in edges:
        out.setdefault(s, []).append(t)
    while todo:
        for t in out.get(todo.pop(), []):
            if t not in seen:
                seen.add(t)
                todo.append(t)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_algorithms(spark, seed):
    pairs = _random_edges(40, 48, seed) + [(100, 100)]
    nodes = {x for p in pairs for x in p}
    e = storage.cut(spark.createDataFrame(pairs, "source long, target long"))
    both = pairs + [(t, s) for s, t in pairs]
    comp = {n: _reach(both, [n]) for n in nodes}
    down = {n: _reach(pairs, [n]) for n in nodes}
    assert dict(rows(algorithms.connected_components(e))) == {n: min(c) for n, c in comp.items()}
    assert dict(rows(algorithms.connected_components(e, True))) == {n: max(c) for n, c in comp.items()}
    scc = {n: min(m for m in down[n] if n in down[m]) for n in nodes}
    assert dict(rows(algorithms.strongly_connected_components(e))) == scc
    roots = [pairs[0][0], 999]
    got = algorithms.reachable(e, spark.createDataFrame([(r,) for r in roots], "node long"))
    assert {r[0] for r in rows(got)} == _reach(pairs, roots)
    colour = {}
    for n in sorted({x for p in pairs if p[0] != p[1] for x in p}):
        used = {colour[m] for s, t in both for m in (t,) if s == n and m < n}
        colour[n] = next(c for c in range(99) if c not in used)
    assert dict(rows(algorithms.colour(e))) == colour
    assert algorithms.colour_conflicts(e, algorithms.colour(e)).count() == 0


def test_pagerank_against_plain_python(spark):
    pairs = list(set(_random_edges(15, 40, 5)))
    deg = {}
    for s, _ in pairs:
        deg[s] = deg.get(s, 0) + 1
    x = {n: 0.15 for n in deg}
    total = dict(x)
    for _ in range(11):
        y = {}
        for s, t in pairs:
            if s in x:
                y[t] = y.get(t, 0) + x[s] * 0.85 / deg[s]
        x = y
        for n, v in x.items():
            total[n] = total.get(n, 0) + v
        x = {n: v for n, v in x.items() if n in deg}
    got = dict(rows(algorithms.pagerank(spark.createDataFrame(pairs, "source long, target long"))))
    assert got.keys() == total.keys() and all(abs(got[n] - total[n]) < 1e-9 for n in got)


def test_node_operators(spark):
    v = spark.createDataFrame([(1, 10), (1, 5), (2, 7), (3, None)], "node long, value long")
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 9)], "source long, target long")
    assert rows(graph.transmit_along(v, e)) == [(2, 10), (2, 10), (2, 5), (2, 5), (9, 7)]
    assert rows(graph.graph_reduce(v, e)) == [(2, 30), (9, 7)]
    s = spark.createDataFrame([(2, 100)], "node long, value long")
    assert rows(graph.node_join(v, s, lambda a, b: b, -1)) == [(1, -1), (1, -1), (2, 100), (3, -1)]
    assert rows(graph.filter_by(v, s.union(s))) == [(2, 7)]
    assert graph.filter_options(v).count() == 3
    names = graph.dense_names(spark.createDataFrame([("b",), ("a",), ("a",), ("c",)], "name string"), buckets=2)
    assert sorted(r.node for r in names.collect()) == [0, 1, 2]
    assert graph.duplicate_names(spark.createDataFrame([("a", 1), ("a", 2)], "name string, node int")).count() == 1


def test_state_machines(spark):
    v = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)], "node long, o long, value boolean")
    either = lambda x, s: x | s
    assert rows(graph.state_machine(v, "o", F.lit(False), either)) == [(1, True), (2, False)]
    assert rows(graph.state_changes(v, "o", F.lit(False), either)) == [(1, 1, True)]
    init = spark.createDataFrame([(2, True)], "node long, value boolean")
    assert rows(graph.state_machine(v, "o", F.lit(False), either, init)) == [(1, True), (2, True)]


def test_state_machine_streams_past_batches(spark):
    data = [(n, o, (o * 7 + n) % 5) for n in (1, 2) for o in range(500)]
    v = spark.createDataFrame(data, "node long, o long, value long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    try:
        last = rows(graph.state_machine_stream(v, "o", 0, lambda x, s: s + x))
        steps = graph.state_machine_stream(v, "o", 0, lambda x, s: max(s, x), changes=True).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert last == [(n, 499, sum(x for m, _, x in data if m == n)) for n in (1, 2)]
    want = 0
    for n in (1, 2):
        best = 0
        for _, _, x in (r for r in data if r[0] == n):
            want, best = want + (x > best), max(x, best)
    assert steps == want


def test_trim_and_flip(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4)], "source long, target long")
    assert rows(algorithms.trim_leaves(e).select("source", "target")) == [(1, 2), (2, 1)]


def test_search_threshold(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "a a a"), (3, None)], "id long, text string")
    q = spark.createDataFrame([(7, "a b", 2), (8, "a", 1)], "id long, text string, threshold int")
    assert rows(algorithms.search(d, q).select("document", "query")) == [(1, 7), (1, 8), (2, 8)]


def test_search_exchanges_counts_and_not_terms(spark):
    d = spark.createDataFrame([(1, "a b c a"), (2, "a a a"), (None, "b b"), (4, "")], "id long, text string")
    q = spark.createDataFrame([(7, "a b a", 2), (8, "a", 1), (9, "b", 1)], "id long, text string, threshold int")
    found = algorithms.search(d, q)
    assert rows(found.select("document", "query")) == [(1, 7), (1, 8), (1, 9), (2, 8), (None, 9)]
    # the document's side of the join: no distinct, which moves every term
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2  # the hits, and the distinct terms of queries
    # a document in several rows still has each term once
    more = d.union(spark.createDataFrame([(2, "b a"), (None, "a b"), (2, None)], "id long, text string"))
    assert rows(algorithms.search(more, q).select("document", "query")) == [(1, 7), (1, 8), (1, 9), (2, 7), (2, 8), (2, 9), (None, 7), (None, 8), (None, 9)]
    twice = spark.createDataFrame([(5, "a b"), (5, "a")], "id long, text string")
    assert rows(algorithms.search(twice, q.filter("id = 8").withColumn("threshold", F.lit(2)))) == []


def test_files(spark, tmp_path):
    p = tmp_path / "e.txt"
    p.write_text("# comment\n1 2\n\n3\t4\n")
    assert rows(io.read_edges(spark, str(p))) == [(1, 2), (3, 4)]
    assert io.read_lines(spark, str(p)).count() == 4
    names = spark.createDataFrame([(str(p),), (str(p),)], "path string")
    assert io.read_lines_of(spark, names).count() == 4
    df = frame(spark, [(i, i + 1, 0) for i in range(10)], "a long, b long, epoch int")
    io.write_custom(df, str(tmp_path / "custom"), io.pack_longs)
    blobs = [bytes(r.content) for r in spark.read.parquet(str(tmp_path / "custom")).collect()]
    (tmp_path / "raw").mkdir()
    for i, b in enumerate(blobs):
        (tmp_path / "raw" / f"{i}.bin").write_bytes(b)
    back = io.read_custom(spark, str(tmp_path / "raw"), lambda c: io.unpack_longs(c, ["a", "b"]), "a long, b long")
    assert rows(back.select("a", "b")) == rows(df.select("a", "b"))
    uris = io.write_by_epoch(frame(spark, [("x", 0), ("y", 2)]), str(tmp_path / "by"), text="x")
    assert sorted(r.epoch for r in uris.collect()) == [0, 2]
    io.write_parts(df, str(tmp_path / "parts"), 3)
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 10
    seen = []
    io.subscribe(frame(spark, [("x", 0), ("y", 1)]), lambda e, r: seen.append((e, len(r))))
    assert seen == [(0, 1), (1, 1)]
    done = io.work(spark, [(1,), (2,)], "n int", lambda it: (pd.DataFrame({"m": b.n * 2}) for b in it), "m int")
    assert rows(done) == [(2,), (4,)]


def test_streaming_epochs_changes_and_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, words in enumerate((["a", "b"], ["a"])):
        pd.DataFrame({"w": words}).to_parquet(src / f"{i}.parquet")
    s = streams.file_epochs(spark, str(src), "w string")
    streams.changes_of(streams.streaming_count(s, "w"), ["w"], "count", str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select("epoch", "w", "count", "weight")) == sorted([(0, "a", 1, 1), (0, "b", 1, 1), (1, "a", 2, 1), (1, "a", 1, -1)], key=str)
    late = spark.createDataFrame([(1,), (5,)], "t int")
    assert rows(streams.late_rows(late, "t", F.lit(3))) == [(1,)]


def test_partition_hints(spark):
    df = frame(spark, [(str(i % 5), 0) for i in range(100)])
    assert l1.misplaced(l1.partition_by(df, "x"), "x").count() == 0
    assert l1.assume_partitioned_by(df, "x") is df and l1.synchronize(df) is df


def test_plans_prune_and_push_down(spark, sf):
    """A filter and two columns reach the scan."""
    df = l1.where(spark.read.parquet(f"{sf}/lineitem.parquet"), F.col("l_quantity") > 40).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_streaming_input_drops_late_rows(spark):
    i = io.StreamingInput(spark, "x string")
    i.on_recv([("a",)], 2)
    i.on_recv([("b",)], 0)
    i.on_notify(1)
    i.on_notify(0)
    i.on_recv([("late",), ("late",)], 1)
    assert i.late == 2 and rows(i.frame()) == [("a", 2), ("b", 0)] and rows(i.closed()) == [("b", 0)]
    i.on_completed()
    assert i.closed().count() == 2


def test_partition_subscription(spark, tmp_path):
    df = frame(spark, [("a", 1), ("b", 0), ("c", 0)]).repartition(2, "x")
    out = str(tmp_path)

    def write(part, epoch, own):
        with open(f"{out}/{part}-{epoch}", "a") as f:
            f.write("".join(r.x for r in own))

    io.subscribe_by_partition(df, write)
    assert sorted("".join(sorted(p.read_text())) + p.name[-1] for p in tmp_path.iterdir()) in (["a1", "b0", "c0"], ["a1", "bc0"])


def test_frontier_is_reported(spark, tmp_path):
    import time

    pd.DataFrame({"w": ["a", "b"]}).to_parquet(tmp_path / "0.parquet")
    seen = []
    f = streams.Frontier(spark, lambda epoch, n, low: seen.append((epoch, n)))
    streams.to_table(streams.file_epochs(spark, str(tmp_path), "w string"), "frontier_test")
    for _ in range(50):
        if seen:
            break
        time.sleep(0.1)
    f.close()
    assert (0, 2) in seen


def test_co_grouped_rows_go_to_python_in_batches(spark):
    big = 2**53 + 1
    a = spark.createDataFrame([(i % 2, i % 7 or None, big + i, None if i == 3 else i > 4, f"s{i}", 0.5) for i in range(60)], "epoch int, k int, n long, f boolean, s string, d double")
    b = spark.createDataFrame([(i % 2, i % 9, None if i % 11 == 0 else big + i, 2.0) for i in range(80)], "epoch int, k int, n long, `d x` double")
    b = b.withColumn("t", F.timestamp_seconds(F.col("n") % 1000))

    def seen(x, y):
        some = x if len(x) else y
        kinds = "|".join(",".join(f"{c}:{z[c].dtype}" for c in z.columns) + repr(sorted(map(str, z.to_dict("records")))) + repr(list(z.index)) for z in (x, y))
        return pd.DataFrame({"epoch": [some.epoch.iloc[0]], "kinds": [kinds], "n": [x.n.max() if len(x) else None]})

    schema = "epoch int, kinds string, n long"
    want = a.groupBy("epoch", "k").cogroup(b.groupBy("epoch", "k")).applyInPandas(seen, schema)
    got = l1.co_group_by(a, b, ["k"], seen, schema)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "MapInPandas" in plan and "CoGroups" not in plan  # which takes a round trip a group
    for size in ("10000", "3"):  # groups that lie in several batches, too
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert rows(got) == rows(want)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    nested = b.withColumn("xs", F.array("n"))
    assert rows(l1.co_group_by(a, nested, ["k"], seen, schema)) == rows(a.groupBy("epoch", "k").cogroup(nested.groupBy("epoch", "k")).applyInPandas(seen, schema))
    sizes = l1.co_group_by(a, b, ["k"], lambda x, y: [(len(x), len(y), None)] * (len(x) > 3), "p long, q long, r string")
    assert sum(r.p for r in sizes.collect()) == sum(r[2] for r in rows(a.groupBy("epoch", "k").count()) if r[2] > 3)
    assert l1.co_group_by(a.limit(0), b.limit(0), ["k"], seen, schema).count() == 0


def test_streamed_rows_stay_off_the_driver(spark, tmp_path, monkeypatch):
    from fluxmere.plans import catalogue

    monkeypatch.setattr(streams, "to_table", None)  # rows in a memory table are the driver's
    for i, ws in enumerate((["a", "b"], ["a"], ["c", "c"])):
        pd.DataFrame({"w": ws}).to_parquet(tmp_path / f"{i}.parquet")
    read = lambda: streams.file_epochs(spark, str(tmp_path / "*.parquet"), "w string")
    assert rows(catalogue._collected(read(), "append")) == [("a",), ("a",), ("b",), ("c",), ("c",)]
    assert rows(catalogue._collected(streams.streaming_count(read(), "w"), "complete")) == [("a", 2), ("b", 1), ("c", 2)]
    assert len(rows(catalogue._collected(streams.streaming_count(read(), "w"), "update"))) == 4
    got = streams.to_files(streams.streaming_count(read(), "w"), str(tmp_path / "out"), str(tmp_path / "check"), "complete")
    assert got.count() == 3 and [p.name for p in (tmp_path / "out").glob("epoch=*")] == ["epoch=2"]
    (tmp_path / "none").mkdir()
    none = streams.to_files(streams.file_epochs(spark, str(tmp_path / "none"), "w string"), str(tmp_path / "out2"), str(tmp_path / "check2"))
    assert none.columns == ["w"] and none.count() == 0


def test_text_helpers(spark):
    from fluxmere.functions import text

    df = spark.createDataFrame([("a  b/c", "7", 2.5, 20)], "t string, n string, x double, l int")
    r = df.select(text.split_blank("t"), text.split_space("t"), text.is_comment(F.col("t")), text.parse_int(F.col("n")), text.round_half_even(F.col("x")), text.after_last("t", "/"), text.log1p_bucket(F.col("l"))).first()
    assert tuple(r) == (["a", "", "b/c"], ["a", "", "b/c"], False, 7, 2, "c", 65536 * 13)


def test_shared_table_is_read_by_many(spark):
    s = io.Shared(frame(spark, [("a", 0)]))
    assert s.read().count() == s.read().count() == 1


def test_all_reduce_and_report(spark):
    df = frame(spark, [("a", 1, 0), ("a", 3, 0), ("b", 5, 1)], "k string, v int, epoch int")
    assert rows(l1.broadcast_reduce(df, F.sum("v").alias("s")).select("epoch", "v", "s")) == [(0, 1, 4), (0, 3, 4), (1, 5, 5)]
    assert rows(l1.report(df, "k", F.col("v"))) == [("a", 0, 2, 4, 1, 3, 2.0), ("b", 1, 1, 5, 5, 5, 5.0)]
