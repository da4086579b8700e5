"""Collections: weighted multisets that change from epoch to epoch.

A ``Collection`` wraps changes: a record's columns, a signed ``weight`` and the ``epoch`` of
the change. Its contents at an epoch are the sums of weights up to it. Every operator maps
changes to changes, so that the output's contents at each epoch are the operator applied to
the inputs' contents at that epoch. Linear operators work on changes as such; weight
functions use one running sum per record; keyed reductions recompute only the groups that
change in an epoch. Changes are always consolidated when read through ``deltas``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage

WEIGHT, EPOCH = "weight", "epoch"


def to_weighted(df: DataFrame, weight: Column | int = 1, epoch: Column | int = 0) -> Collection:
    w = F.lit(weight) if isinstance(weight, int) else weight
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    return Collection(df.withColumn(WEIGHT, w.cast("long")).withColumn(EPOCH, e.cast("int")))


class InputCollection:
    """Collects changes batch by batch; each ``on_next`` closes an epoch, even an empty one."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.epoch, self.done = spark, schema, 0, False
        self.changes: list[DataFrame] = []

    def on_next(self, records: DataFrame | list | None = None, weight: int | Column = 1) -> int:
        if self.done:
            raise ValueError("the input is complete")
        if records is not None:
            df = records if isinstance(records, DataFrame) else self.spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in records], self.schema)
            w = F.lit(weight) if isinstance(weight, int) else weight
            self.changes.append(df.withColumn(WEIGHT, w.cast("long")).withColumn(EPOCH, F.lit(self.epoch)))
        self.epoch += 1
        return self.epoch - 1

    def on_completed(self, records: DataFrame | list | None = None, weight: int | Column = 1) -> None:
        self.on_next(records, weight)
        self.done = True

    def collection(self) -> Collection:
        empty = self.spark.createDataFrame([], f"{self.schema}, weight long, epoch int")
        return Collection(reduce(DataFrame.unionByName, self.changes, empty))


class Collection:
    def __init__(self, changes: DataFrame):
        self.df = changes

    @property
    def record(self) -> list[str]:
        return [c for c in self.df.columns if c not in (WEIGHT, EPOCH)]

    # --- reading -------------------------------------------------------------------------

    def output(self) -> DataFrame:
        """The changes as they are."""
        return self.df

    def deltas(self) -> DataFrame:
        """Consolidated changes: one row per record and epoch, no zero weights."""
        return self.consolidate().df

    def at(self, epoch: int | None = None) -> DataFrame:
        """Contents at ``epoch`` (or at the end): records and weights, no zeros."""
        df = self.df if epoch is None else self.df.filter(F.col(EPOCH) <= epoch)
        return df.groupBy(*self.record).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(F.col(WEIGHT) != 0)

    def subscribe(self, action: Callable[[int, list], None]) -> None:
        """Call ``action(epoch, rows)`` with each epoch's changes, in order: a client-side sink.

        Epochs come to the driver one at a time, as they do to any subscriber."""
        rows = storage.cut(self.deltas())
        for (e,) in rows.select(EPOCH).distinct().orderBy(EPOCH).collect():
            action(e, rows.filter(F.col(EPOCH) == e).drop(EPOCH).collect())

    def monitor(self, name: str | Observation = "monitor") -> Collection:
        """Counts of records and weights are observed as the data pass, by a name for listeners or an
        ``Observation`` to ask."""
        return Collection(self.df.observe(name, F.count("*").alias("records"), F.sum(WEIGHT).alias("weight")))

    # --- linear ---------------------------------------------------------------------------

    def select(self, *exprs: Column | str) -> Collection:
        return Collection(self.df.select(*exprs, WEIGHT, EPOCH))

    def where(self, predicate: Column | str) -> Collection:
        return Collection(self.df.filter(predicate))

    def select_many(self, array: Column, name: str, *keep: str) -> Collection:
        return Collection(self.df.select(*keep, F.explode(array).alias(name), WEIGHT, EPOCH))

    def select_many_segments(self, segments: Column, name: str, *keep: str) -> Collection:
        """As ``select_many`` for a function that gives a list of segments: all their elements."""
        return self.select_many(F.flatten(segments), name, *keep)

    def concat(self, other: Collection) -> Collection:
        return Collection(self.df.unionByName(other.df))

    def negate(self) -> Collection:
        return Collection(self.df.withColumn(WEIGHT, -F.col(WEIGHT)))

    def except_(self, other: Collection) -> Collection:
        """Weights subtract and may turn negative."""
        return self.concat(other.negate())

    def adjust_time(self, epoch: Column) -> Collection:
        """Move changes to a later epoch; earlier ones are raised to the change's own."""
        return Collection(self.df.withColumn(EPOCH, F.greatest(epoch, F.col(EPOCH)).cast("int")))

    def sliding_window(self, size: int) -> Collection:
        """A change made at e is undone at e + size."""
        return self.except_(self.adjust_time(F.col(EPOCH) + size))

    def consolidate(self) -> Collection:
        rows = self.df.groupBy(*self.record, EPOCH).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(F.col(WEIGHT) != 0)
        return Collection(rows.select(*self.record, WEIGHT, EPOCH))

    def compact(self, epoch: int) -> Collection:
        """Changes up to ``epoch`` become one change at it: contents from there on stay the same,
        earlier ones can't be asked for any more."""
        return self.adjust_time(F.lit(epoch)).consolidate()

    def partition_by(self, *keys: str) -> Collection:
        return Collection(self.df.repartition(*keys))

    def assume_partitioned_by(self, *keys: str) -> Collection:
        return self

    def assume_immutable(self) -> Collection:
        return self

    # --- weight functions -----------------------------------------------------------------

    def _reweigh(self, sums: Sequence[str], f: Column) -> Collection:
        """New weights from running sums of the columns ``sums``: f(now) - f(before).

        ``f`` is over columns of those names. One shuffle by record, null-safe."""
        per = self.df.groupBy(*self.record, EPOCH).agg(*[F.sum(s).alias(s) for s in sums])
        w = Window.partitionBy(*self.record).orderBy(EPOCH)
        now = per.select(*self.record, EPOCH, *[F.sum(s).over(w).alias(s) for s in sums]).withColumn("now", f)
        rows = now.withColumn(WEIGHT, (F.col("now") - F.coalesce(F.lag("now").over(w), F.lit(0))).cast("long"))
        return Collection(rows.filter(F.col(WEIGHT) != 0).select(*self.record, WEIGHT, EPOCH))

    def distinct(self) -> Collection:
        return self._reweigh([WEIGHT], F.when(F.col(WEIGHT) > 0, 1).otherwise(0))

    def abs(self) -> Collection:
        return self._reweigh([WEIGHT], F.abs(WEIGHT))

    def _both(self, other: Collection, f: Column) -> Collection:
        cols = self.record
        a = self.df.select(*cols, EPOCH, F.col(WEIGHT).alias("wa"), F.lit(0).cast("long").alias("wb"))
        b = other.df.select(*cols, EPOCH, F.lit(0).cast("long").alias("wa"), F.col(WEIGHT).alias("wb"))
        return _Tagged(a.unionByName(b))._reweigh(["wa", "wb"], f)

    def union(self, other: Collection) -> Collection:
        return self._both(other, F.greatest("wa", "wb"))

    def intersect(self, other: Collection) -> Collection:
        return self._both(other, F.least("wa", "wb"))

    def symmetric_difference(self, other: Collection) -> Collection:
        return self._both(other, F.abs(F.col("wa") - F.col("wb")))

    # --- join ------------------------------------------------------------------------------

    def join(self, other: Collection, keys: Sequence[str], *result: Column | str) -> Collection:
        """Inner join of contents: weights multiply, a pair changes when its later side does.

        Bilinear, so joining the changes once gives the changes of the join."""
        a = self.df.withColumnRenamed(WEIGHT, "wa").withColumnRenamed(EPOCH, "ea")
        b = other.df.withColumnRenamed(WEIGHT, "wb").withColumnRenamed(EPOCH, "eb")
        out = a.join(b, list(keys))
        cols = result or [c for c in out.columns if c not in ("wa", "wb", "ea", "eb")]
        return Collection(out.select(*cols, (F.col("wa") * F.col("wb")).alias(WEIGHT), F.greatest("ea", "eb").alias(EPOCH)))

    # --- keyed reductions --------------------------------------------------------------------

    @staticmethod
    def _valid_until(rows: DataFrame, keys: Sequence[str], changes: DataFrame) -> Collection:
        """Changes from results that hold from their epoch to the key's next change."""
        w = Window.partitionBy(*keys).orderBy(EPOCH)
        spans = changes.select(*keys, EPOCH).distinct().withColumn("until", F.lead(EPOCH).over(w))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in [*keys, EPOCH]])
        spans = spans.select(*[F.col(c).alias(f"k_{c}") for c in [*keys, EPOCH]], "until")
        held = rows.join(spans, same).drop(*[f"k_{c}" for c in [*keys, EPOCH]])
        cols = [c for c in rows.columns if c not in (EPOCH, WEIGHT)]
        w1 = F.col(WEIGHT) if WEIGHT in rows.columns else F.lit(1).cast("long")
        plus = held.select(*cols, w1.alias(WEIGHT), F.col(EPOCH).alias(EPOCH))
        minus = held.filter("until is not null").select(*cols, (-w1).alias(WEIGHT), F.col("until").alias(EPOCH))
        return Collection(plus.unionByName(minus)).consolidate()

    def _running(self, keys: Sequence[str], *sums: Column) -> DataFrame:
        """Running sums per key at the epochs in which the key changes."""
        names = [f"s{i}" for i in range(len(sums))]
        per = self.df.groupBy(*keys, EPOCH).agg(*[F.sum(s).alias(n) for s, n in zip(sums, names)])
        w = Window.partitionBy(*keys).orderBy(EPOCH)
        return per.select(*keys, EPOCH, *[F.sum(n).over(w).alias(n) for n in names])

    def _delta_of(self, now: DataFrame, keys: Sequence[str], value: Column, keep: Column, name: str) -> Collection:
        """Changes of one (key, value) row per key from running values: minus old, plus new."""
        w = Window.partitionBy(*keys).orderBy(EPOCH)
        s = now.withColumn("now", F.when(keep, F.struct(value.alias(name)))).withColumn("old", F.lag("now").over(w))
        s = s.filter(~F.col("now").eqNullSafe(F.col("old")))
        plus = s.filter("now is not null").select(*keys, F.col("now")[name].alias(name), F.lit(1).cast("long").alias(WEIGHT), EPOCH)
        minus = s.filter("old is not null").select(*keys, F.col("old")[name].alias(name), F.lit(-1).cast("long").alias(WEIGHT), EPOCH)
        return Collection(plus.unionByName(minus))

    def count(self, *keys: str, name: str = "count") -> Collection:
        """Sum of weights per key, where positive."""
        return self._delta_of(self._running(keys, F.col(WEIGHT)), keys, F.col("s0"), F.col("s0") > 0, name)

    def sum(self, keys: Sequence[str], value: Column, name: str = "sum") -> Collection:
        """Sum of weight times value; a key leaves only when its weights and its sum are zero."""
        return self.aggregate(keys, value, name)

    def aggregate(self, keys: Sequence[str], value: Column, name: str = "value", result: Callable[[Column], Column] = lambda v: v) -> Collection:
        """Linear aggregate: weighted sum of ``value``, then ``result`` of it."""
        now = self._running(keys, F.col(WEIGHT) * value, F.col(WEIGHT))
        return self._delta_of(now, keys, result(F.col("s0")), (F.col("s0") != 0) | (F.col("s1") != 0), name)

    def _contents(self, keys: Sequence[str]) -> DataFrame:
        """Contents with positive weight of each key at each epoch in which the key changes."""
        when = self.df.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col(EPOCH).alias("now")).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])
        holds = (F.col("now") >= F.col(EPOCH)) & (F.col("until").isNull() | (F.col("now") < F.col("until")))
        return self.spans().join(when, same & holds).select(*self.record, F.col("now").alias(EPOCH), WEIGHT)

    def spans(self) -> DataFrame:
        """Records with a positive weight, from ``epoch`` to before ``until`` (null: for good): one
        shuffle by record, and a row per change, however many epochs there are."""
        per = self.df.groupBy(*self.record, EPOCH).agg(F.sum(WEIGHT).alias(WEIGHT))
        w = Window.partitionBy(*self.record).orderBy(EPOCH)
        rows = per.select(*self.record, EPOCH, F.sum(WEIGHT).over(w).alias(WEIGHT), F.lead(EPOCH).over(w).alias("until"))
        return rows.filter(F.col(WEIGHT) > 0)

    def min(self, keys: Sequence[str], by: Column) -> Collection:
        """The record of least ``by`` per key (ties: the least record), with weight 1."""
        return self._extreme(keys, by, F.min)

    def max(self, keys: Sequence[str], by: Column) -> Collection:
        return self._extreme(keys, by, F.max)

    def _extreme(self, keys: Sequence[str], by: Column, f) -> Collection:
        best = self._contents(keys).groupBy(*[F.col(k).alias(f"k_{k}") for k in keys], EPOCH).agg(f(F.struct(by.alias("by"), F.struct(*self.record).alias("r"))).alias("b"))
        rows = best.select("b.r.*", EPOCH)
        return self._valid_until(rows.select(*self.record, EPOCH), keys, self.df).select(*self.record)

    def group_by(self, keys: Sequence[str], value: Column, reducer: Callable[[Column], Column], name: str = "value") -> Collection:
        """Reducer over the sorted array of a key's values, each as often as its weight says.

        Gives an array of results, each with weight 1; only groups with contents are reduced."""
        c = self._contents(keys)
        lists = c.groupBy(*keys, EPOCH).agg(F.flatten(F.sort_array(F.collect_list(F.array_repeat(value, F.col(WEIGHT).cast("int"))))).alias("values"))
        rows = lists.select(*keys, F.explode(reducer(F.col("values"))).alias(name), EPOCH)
        return self._valid_until(rows, keys, self.df)

    def co_group_by(self, other: Collection, keys: Sequence[str], left: Column, right: Column, reducer: Callable[[Column, Column], Column], name: str = "value", weight: Callable[[Column, Column], Column] | None = None) -> Collection:
        """Reducer over both sides' arrays for keys of either side, at every epoch in which
        either changes; a side without contents is an empty array. ``weight`` gives the results
        a weight of its own (from the same arrays)."""
        changes = self.df.select(*keys, EPOCH).unionByName(other.df.select(*keys, EPOCH)).distinct()

        def lists(side: Collection, value: Column, to: str) -> DataFrame:
            idle = changes.select(*keys, *[F.lit(None).cast(side.df.schema[c].dataType).alias(c) for c in side.record if c not in keys], F.lit(0).cast("long").alias(WEIGHT), EPOCH)
            c = Collection(side.df.select(*keys, *[c for c in side.record if c not in keys], WEIGHT, EPOCH).unionByName(idle))._contents(keys)
            return c.groupBy(*keys, EPOCH).agg(F.flatten(F.sort_array(F.collect_list(F.array_repeat(value, F.col(WEIGHT).cast("int"))))).alias(to))

        a, b = lists(self, left, "left"), lists(other, right, "right")
        both = a.join(b, [*keys, EPOCH], "full")
        none_a, none_b = (F.coalesce(c, F.expr("array()").cast(t)) for c, t in ((F.col("left"), both.schema["left"].dataType), (F.col("right"), both.schema["right"].dataType)))
        both = both.withColumn("left", none_a).withColumn("right", none_b)
        extra = [] if weight is None else [weight(F.col("left"), F.col("right")).cast("long").alias(WEIGHT)]
        rows = both.select(*keys, F.explode(reducer(F.col("left"), F.col("right"))).alias(name), EPOCH, *extra)
        return self._valid_until(rows, keys, changes)

    def _never_negative(self) -> bool:
        """Whether no record has a negative weight at any epoch."""
        per = self.df.groupBy(*self.record, EPOCH).agg(F.sum(WEIGHT).alias(WEIGHT))
        run = F.sum(WEIGHT).over(Window.partitionBy(*self.record).orderBy(EPOCH))
        return per.select(run.alias(WEIGHT)).filter(F.col(WEIGHT) < 0).isEmpty()

    # --- iteration ---------------------------------------------------------------------------

    def fixed_point(self, body: Callable[[Collection], Collection], max_iterations: int | None = None) -> Collection:
        """X0 = this; X(i+1) = body(Xi) until nothing changes, at all epochs at once.

        With ``max_iterations`` n the body is applied n + 1 times at most. It need not be
        monotone and may diverge without a bound."""
        x = Collection(storage.cut(self.consolidate().df))
        i = 0
        while max_iterations is None or i <= max_iterations:
            y = Collection(storage.cut(body(x).consolidate().df.select(*x.df.columns)))
            if y.except_(x).consolidate().df.isEmpty():
                return y
            x, i = y, i + 1
        return x

    def general_fixed_point(self, body: Callable[[Collection], Collection], priority: Column, max_iterations: int | None = None) -> Collection:
        """X(i+1) = body(Xi) + (I(i+1) - I(i)), with I(i) the records of priority at most i.

        Iterations in which nothing happens are skipped: after quiescence the next priority
        enters. ``body`` must be a function of its argument only.

        Where the order of entry can't tell in the result, all records enter at once: without a
        bound, if no contents are negative and ``body`` is seen to be monotone, to keep what it
        is given and to end in a set (``_Shape``). Any other body runs priority by priority, so
        takes at least two rounds for each."""
        start = Collection(storage.cut(self.consolidate().df.select(*self.df.columns)))
        if max_iterations is None and (constants := _Shape.constants_of(body, start)) is not None and all(c._never_negative() for c in [start, *constants]):
            return start.fixed_point(body)
        tagged = storage.cut(start.df.withColumn("p", priority.cast("long")))
        waves = [r.p for r in tagged.select("p").distinct().orderBy("p").collect()]
        none = Collection(self.df.limit(0))
        x, i, k = none, -1, 0
        while max_iterations is None or i <= max_iterations:
            if k < len(waves) and waves[k] <= i + 1:
                entering, k = Collection(tagged.filter(F.col("p") == waves[k]).drop("p")), k + 1
            else:
                entering = None
            grown = body(x) if i >= 0 else none
            y = grown if entering is None else grown.concat(entering)
            y = Collection(storage.cut(y.consolidate().df.select(*self.df.columns)))
            same = entering is None and y.except_(x).consolidate().df.isEmpty()
            x, i = y, i + 1
            if same:
                if k == len(waves):
                    return x
                i = max(i, waves[k] - 1)
        return x


class _Tagged(Collection):
    @property
    def record(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("wa", "wb", EPOCH)]


class _Opaque(Exception):
    """A body does what nothing is known of."""


class _Shape(Collection):
    """Stands in for a body's argument, to learn what the body is made of; has no rows.

    Which records the results of its operators hold grows with which the argument holds, and
    with nothing else (for contents that are never negative). ``keeps``: they hold all of the
    argument's. ``is_set``: with weight 1. A body that gives both has one least fixed point
    over an input, whatever the order in which that enters. All other operators ask for
    ``df``, and that is refused."""

    def __init__(self, rows: DataFrame, constants: list[Collection], keeps: bool = False, is_set: bool = False):
        self.rows, self.constants, self.keeps, self.is_set = rows, constants, keeps, is_set

    @staticmethod
    def constants_of(body: Callable[[Collection], Collection], x: Collection) -> list[Collection] | None:
        """The collections that a monotone ``body`` has besides ``x``; None: it isn't seen to be one."""
        try:
            out = body(_Shape(_Shape._empty(x.df), [], keeps=True))
        except _Opaque:
            return None
        return out.constants if isinstance(out, _Shape) and out.keeps and out.is_set else None

    @property
    def df(self) -> DataFrame:
        raise _Opaque

    @property
    def record(self) -> list[str]:
        return [c for c in self.rows.columns if c not in (WEIGHT, EPOCH)]

    @staticmethod
    def _empty(df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame([], df.schema)

    def _row_by_row(self, rows: DataFrame, f: Callable[[DataFrame], DataFrame], hidden: tuple[str, ...]) -> DataFrame:
        """f of empty rows, if it looks at one row at a time, never at the columns ``hidden``, and
        gives the same each time."""
        try:
            out = f(rows)
        except AnalysisException:
            raise _Opaque from None
        plan = out._jdf.queryExecution().analyzed()
        if not plan.deterministic():
            raise _Opaque
        while plan.children().size():
            seen = plan.references().toSeq()
            if plan.nodeName() not in ("Project", "Filter", "Generate") or any(seen.apply(i).name() in hidden for i in range(seen.size())):
                raise _Opaque
            plan = plan.children().apply(0)
        return out

    def _mapped(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        out = self._row_by_row(self._empty(self.rows), f, (WEIGHT, EPOCH))
        return out.select(*[c for c in out.columns if c not in (WEIGHT, EPOCH)], F.lit(1).cast("long").alias(WEIGHT), F.lit(0).alias(EPOCH))

    def _with(self, other: Collection) -> tuple[DataFrame, list[Collection], bool, bool]:
        if isinstance(other, _Shape):
            return other.rows, self.constants + other.constants, other.keeps, other.is_set
        return other.df, [*self.constants, other], False, False

    def select(self, *exprs: Column | str) -> Collection:
        return _Shape(self._mapped(lambda rows: rows.select(*exprs)), self.constants)

    def where(self, predicate: Column | str) -> Collection:
        return _Shape(self._mapped(lambda rows: rows.filter(predicate)), self.constants, is_set=self.is_set)

    def select_many(self, array: Column, name: str, *keep: str) -> Collection:
        return _Shape(self._mapped(lambda rows: rows.select(*keep, F.explode(array).alias(name))), self.constants)

    def concat(self, other: Collection) -> Collection:
        _, constants, keeps, _ = self._with(other)
        return _Shape(self.rows, constants, self.keeps or keeps)

    def consolidate(self) -> Collection:
        return self

    def partition_by(self, *keys: str) -> Collection:
        return self

    def distinct(self) -> Collection:
        return _Shape(self.rows, self.constants, self.keeps, True)

    def union(self, other: Collection) -> Collection:
        _, constants, keeps, is_set = self._with(other)
        return _Shape(self.rows, constants, self.keeps or keeps, self.is_set and is_set)

    def intersect(self, other: Collection) -> Collection:
        _, constants, keeps, is_set = self._with(other)
        return _Shape(self.rows, constants, self.keeps and keeps, self.is_set and is_set)

    def join(self, other: Collection, keys: Sequence[str], *result: Column | str) -> Collection:
        right, constants, _, _ = self._with(other)
        hidden = ("wa", "ea", "wb", "eb")
        a, b = (self._empty(df).withColumnsRenamed({WEIGHT: f"w{side}", EPOCH: f"e{side}"}) for df, side in ((self.rows, "a"), (right, "b")))
        both = a.join(b, list(keys))
        cols = result or [c for c in both.columns if c not in hidden]
        out = self._row_by_row(self._empty(both), lambda rows: rows.select(*cols), hidden)
        return _Shape(out.withColumns({WEIGHT: F.lit(1).cast("long"), EPOCH: F.lit(0)}), constants)
