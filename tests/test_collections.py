"""Weighted collections on literal frames: weights by hand, retractions, metamorphic laws."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fluxmere.operators.zset import Collection, InputCollection, _Shape, to_weighted
from fluxmere.plans.deltas import epoch_deltas


def coll(spark, rows, schema="x string, weight long, epoch int"):
    return Collection(spark.createDataFrame(rows, schema))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "name, weight",
    [("concat", 4), ("union", 3), ("intersect", 1), ("except_", 2), ("symmetric_difference", 2)],
)
def test_worked_weights(spark, name, weight):
    a, b = coll(spark, [("r", 3, 0)]), coll(spark, [("r", 1, 0)])
    assert rows(getattr(a, name)(b).at(), "x", "weight") == [("r", weight)]
    assert rows(a.distinct().at(), "x", "weight") == [("r", 1)]


def test_negative_weights(spark):
    a, b = coll(spark, [("r", -2, 0), (None, 1, 0)]), coll(spark, [("q", 1, 0)])
    assert rows(a.union(b).at(), "x", "weight") == [("q", 1), (None, 1)] or rows(a.union(b).at(), "x", "weight") == [(None, 1), ("q", 1)]
    assert ("r", 2) in rows(a.abs().at(), "x", "weight")
    assert rows(a.distinct().at(), "x", "weight") == [(None, 1)]
    assert ("q", -1) in rows(a.except_(b).at(), "x", "weight")


def test_histogram_with_retractions(spark):
    """Insert {1,1,2,3,5,8}; insert 13; take 1 away twice."""
    i = InputCollection(spark, "x int")
    i.on_next([1, 1, 2, 3, 5, 8])
    i.on_next([13])
    i.on_completed([1], -2)
    with pytest.raises(ValueError):
        i.on_next()
    c = i.collection().count("x")
    d = rows(c.deltas(), "epoch", "x", "count", "weight")
    assert d == sorted([(0, 1, 2, 1), (0, 2, 1, 1), (0, 3, 1, 1), (0, 5, 1, 1), (0, 8, 1, 1), (1, 13, 1, 1), (2, 1, 2, -1)], key=str)
    assert rows(c.at(2), "x", "count") == sorted([(2, 1), (3, 1), (5, 1), (8, 1), (13, 1)], key=str)


def test_sum_keeps_groups_by_weight_or_value(spark):
    c = coll(spark, [("a", 5, 1, 0), ("a", 5, -1, 1), ("b", 3, 1, 0), ("b", 7, -1, 0), ("c", 0, 1, 0)], "k string, v long, weight long, epoch int")
    s = c.sum(["k"], F.col("v"))
    assert rows(s.at(0), "k", "sum") == [("a", 5), ("b", -4), ("c", 0)]
    assert rows(s.at(1), "k", "sum") == [("b", -4), ("c", 0)]


def test_min_max_are_records_with_ties_by_record(spark):
    c = coll(spark, [("a", 1, "z", 1, 0), ("a", 1, "y", 1, 0), ("a", 0, "gone", -1, 0), ("a", 1, "y", -1, 1)], "k string, v int, r string, weight long, epoch int")
    m = c.min(["k"], F.col("v"))
    assert rows(m.at(0), "k", "v", "r") == [("a", 1, "y")]
    assert rows(m.at(1), "k", "v", "r") == [("a", 1, "z")]
    assert rows(c.max(["k"], F.col("v")).at(0), "r") == [("z",)]


def test_group_by_repeats_by_weight_and_skips_empty(spark):
    c = coll(spark, [("a", "x", 2, 0), ("a", "y", 1, 1), ("b", "x", -1, 0), ("a", "x", -2, 2), ("a", "y", -1, 2)], "k string, v string, weight long, epoch int")
    g = c.group_by(["k"], F.col("v"), lambda v: F.array(F.array_join(v, "")))
    assert rows(g.at(0), "k", "value") == [("a", "xx")]
    assert rows(g.at(1), "k", "value") == [("a", "xxy")]
    assert rows(g.at(2), "k", "value") == []


def test_co_group_by_sees_either_side(spark):
    a = coll(spark, [("k", 1, 0)], "x string, weight long, epoch int")
    b = coll(spark, [("k", 1, 1), ("o", 1, 1)], "x string, weight long, epoch int")
    g = a.co_group_by(b, ["x"], F.col("x"), F.col("x"), lambda p, q: F.array(F.size(p) * 10 + F.size(q)))
    assert rows(g.at(0), "x", "value") == [("k", 10)]
    assert rows(g.at(1), "x", "value") == [("k", 11), ("o", 1)]


def test_join_time_and_weight(spark):
    a = coll(spark, [("k", 2, 0), ("k", -1, 2)])
    b = coll(spark, [("k", 3, 1)])
    assert rows(a.join(b, ["x"]).deltas(), "epoch", "weight") == [(1, 6), (2, -3)]


def test_adjust_time_only_advances_and_window_expires(spark):
    c = coll(spark, [("a", 1, 3)])
    assert rows(c.adjust_time(F.lit(1)).df, "epoch") == [(3,)]
    w = c.sliding_window(2)
    assert [bool(w.at(e).count()) for e in (2, 3, 4, 5)] == [False, True, True, False]


def test_deltas_add_up_to_contents(spark):
    """Random signed changes: summed deltas are the operator on summed changes, at every epoch."""
    rng = random.Random(3)
    data = [(rng.choice("abc"), rng.choice([1, 1, -1, 2]), rng.randrange(4)) for _ in range(40)]
    c = coll(spark, data)
    for e in range(4):
        want = Counter()
        for x, w, t in data:
            if t <= e:
                want[x] += w
        assert dict(rows(c.distinct().at(e), "x", "weight")) == {x: 1 for x, w in want.items() if w > 0}
        assert dict(rows(c.abs().at(e), "x", "weight")) == {x: abs(w) for x, w in want.items() if w}
        assert dict(rows(c.count("x").at(e), "x", "count")) == {x: w for x, w in want.items() if w > 0}


def test_one_epoch_equals_many(spark):
    many = coll(spark, [("a", 1, 0), ("b", 1, 1), ("a", -1, 2), ("c", 2, 2)])
    one = coll(spark, [("a", 1, 0), ("b", 1, 0), ("a", -1, 0), ("c", 2, 0)])
    for f in (lambda c: c.distinct(), lambda c: c.count("x"), lambda c: c.min(["x"], F.col("x"))):
        assert rows(f(many).at(), *f(one).record) == rows(f(one).at(), *f(one).record)


def test_epoch_deltas_of_any_query(spark):
    c = coll(spark, [("a", 2, 0), ("a", -1, 1), ("b", 1, 1)])
    d = epoch_deltas(lambda r: r.groupBy("x").agg(F.count("*").alias("n")), c)
    assert rows(d.df, "epoch", "x", "n", "weight") == sorted([(0, "a", 2, 1), (1, "a", 2, -1), (1, "a", 1, 1), (1, "b", 1, 1)], key=str)


def test_fixed_points(spark):
    start = to_weighted(spark.createDataFrame([(1,), (5,)], "x int"))
    down = lambda c: c.concat(c.where("x > 0").select((F.col("x") - 1).alias("x"))).distinct()
    assert rows(start.fixed_point(down).at(), "x") == [(i,) for i in range(6)]
    assert rows(start.fixed_point(down, 0).at(), "x") == [(0,), (1,), (4,), (5,)]
    plain, late = start.fixed_point(down), start.general_fixed_point(down, F.col("x") * 1000)
    assert rows(plain.at(), "x") == rows(late.at(), "x")


def test_priorities_enter_at_once_where_their_order_cannot_tell(spark, monkeypatch):
    from fluxmere import storage

    cuts, cut = [], storage.cut
    monkeypatch.setattr(storage, "cut", lambda df: cuts.append(1) or cut(df))
    c = coll(spark, [(str(i), 1, i % 3) for i in range(40)] + [("7", -1, 2)])
    edges = Collection(c.df.select("x", F.concat("x", F.lit("'")).alias("to"), "weight", F.lit(0).alias("epoch")).filter("weight > 0"))
    down = lambda x: x.concat(x.where("x like '1%'").join(edges, ["x"], F.col("to").alias("x"))).distinct()
    got = c.general_fixed_point(down, F.col("x").cast("long") * 10)
    assert len(cuts) < 10  # two rounds and more for each of 40 priorities before
    want = [str(i) for i in range(40) if i != 7] + [f"{i}'" for i in range(40) if str(i)[0] == "1"]
    assert rows(got.at(), "x", "weight") == sorted([(x, 1) for x in want], key=str)
    assert rows(got.df, "x", "weight", "epoch") == rows(c.fixed_point(down).df, "x", "weight", "epoch")


def test_priorities_keep_their_order_where_it_tells(spark):
    c = coll(spark, [("a", 1, 0), ("b", 1, 0)])
    turn = F.when(F.col("x") == "a", 1).otherwise(0)
    # c comes where b is without a, as it is before a enters
    def lone(x):
        b, a = (x.where(f"x = '{k}'").select(F.lit("c").alias("x")) for k in "ba")
        return x.concat(b.except_(b.join(a, ["x"]))).distinct()

    assert rows(c.general_fixed_point(lone, turn).at(), "x") == [("a",), ("b",), ("c",)]
    assert rows(c.fixed_point(lone).at(), "x") == [("a",), ("b",)]
    shape = lambda body: _Shape.constants_of(body, c)
    assert shape(lambda x: x.concat(x.select(F.upper("x").alias("x"))).distinct()) == []
    for body in (
        lambda x: x.select(F.upper("x").alias("x")).distinct(),  # keeps nothing
        lambda x: x.concat(x.where("weight > 1")).distinct(),
        lambda x: x.concat(x.select(F.to_json(F.struct("*")).alias("x"))).distinct(),
        lambda x: x.concat(x.select(F.max("x").over(Window.partitionBy(F.lit(1))).alias("x"))).distinct(),
        lambda x: x.concat(x.select(F.max("x").alias("x"))).distinct(),
        lambda x: x.concat(x.where(F.rand() < 0.5)).distinct(),
        lambda x: x.concat(x.where("x = 'a'").negate()).distinct(),
        lambda x: x.concat(x.join(c, ["x"], F.col("ea").cast("string").alias("x"))).distinct(),
        lambda x: x.concat(Collection(x.df.filter("x = 'a'"))).distinct(),
        lambda x: x.concat(x.min(["x"], F.col("x"))).distinct(),
        lambda x: x.concat(x),  # weights grow
    ):
        assert shape(body) is None
    # a constant that takes away: seen by its weights
    less = coll(spark, [("a", -1, 0)])
    assert rows(c.general_fixed_point(lambda x: x.concat(less).distinct(), turn).at(), "x") == [("b",)]


def test_subscribe_and_empty(spark):
    seen = []
    coll(spark, [("a", 1, 0), ("a", -1, 1), ("b", 1, 1)]).subscribe(lambda e, r: seen.append((e, sorted((x.x, x.weight) for x in r))))
    assert seen == [(0, [("a", 1)]), (1, [("a", -1), ("b", 1)])]
    none = coll(spark, [])
    for c in (none.distinct(), none.count("x"), none.min(["x"], F.col("x")), none.union(none), none.fixed_point(lambda x: x.distinct())):
        assert c.at().count() == 0
