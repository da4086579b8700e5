"""Per-epoch deltas of arbitrary batch queries over collections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..operators.zset import EPOCH, WEIGHT, Collection


def epoch_deltas(query: Callable[[DataFrame], DataFrame], changes: Collection) -> Collection:
    """Changes of ``query`` (a function of contents, as plain rows) over the epochs of ``changes``.

    Q(contents up to t) - Q(contents before t) for each epoch: for queries that have no delta
    rule of their own, such as fixed points. One evaluation per epoch."""
    rows = Collection(storage.cut(changes.consolidate().df))
    epochs = [r[0] for r in rows.df.select(EPOCH).distinct().orderBy(EPOCH).collect()]
    out, before = None, None
    for e in epochs:
        contents = rows.at(e).filter(F.col(WEIGHT) > 0)
        plain = contents.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(WEIGHT)))).drop("copy", WEIGHT)
        now = storage.cut(query(plain))
        step = now.withColumn(WEIGHT, F.lit(1).cast("long"))
        if before is not None:
            step = step.unionByName(before.withColumn(WEIGHT, F.lit(-1).cast("long")))
        step = step.withColumn(EPOCH, F.lit(e))
        out = step if out is None else out.unionByName(step)
        before = now
    if out is None:
        empty = query(rows.df.drop(WEIGHT, EPOCH))
        out = empty.withColumn(WEIGHT, F.lit(1).cast("long")).withColumn(EPOCH, F.lit(0)).limit(0)
    return Collection(out).consolidate()
