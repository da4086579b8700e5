"""Mixing sources to target weights over fixed-length blocks of words.

Each source's documents, in a fixed pseudorandom order, form one long line of words that
is cut into blocks of ``block`` words. Every output shard draws its source counts from a
multinomial, given that together the shards meet each source's slots; its slots continue each source's running index, and a
keyed permutation of that source's block indices, a new one for each pass, says which
block a slot takes. Blocks are joined by index. Only one row per source (at most
``MAX_SOURCES``) reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_SOURCES, MAX_SHARDS, MAX_REPEAT = 1_000_000, 4096, 3
SIZED = "doc_id long, source string, size long"


def count_words(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: blanks are the six ASCII ones, just as ``bytes.split`` has them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.split()) if t else 0 for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(count, SIZED)


def fill_targets(sizes: list[int], cap: int = MAX_REPEAT) -> list[float]:
    """Targets for sources in order: weights 1, 2, 3, repeating, share the total of all sizes;
    a target stops at ``cap`` times its source's size and the excess is reshared by weight."""
    target, free, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    weight = [i % 3 + 1 for i in range(len(sizes))]
    while free:
        unit = rest / sum(weight[i] for i in free)
        over = [i for i in free if unit * weight[i] > cap * sizes[i]]
        for i in over or free:
            target[i] = float(cap * sizes[i]) if over else unit * weight[i]
        if not over:
            break
        rest -= sum(cap * sizes[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return target


@dataclass
class Plan:
    """What the driver knows of the mix, all per source: key, size, target, blocks."""

    keys: list[str]
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    documents: int
    block: int
    seed: int

    @property
    def expected(self) -> np.ndarray:
        """Slots by source: its target over the words of its average block."""
        return np.array([t * n / s if s else 0.0 for t, n, s in zip(self.targets, self.blocks, self.sizes)])


def source_key() -> F.Column:
    """Sorts by code point with null last, and joins nulls."""
    return F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))


def make_plan(sized: DataFrame, block: int = 64, seed: int = 20) -> Plan:
    rows = sized.groupBy(source_key().alias("key")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: r.key.encode())
    sizes = [r["size"] for r in rows]
    return Plan([r.key for r in rows], sizes, fill_targets(sizes), [-(-s // block) for s in sizes], sum(r.n for r in rows), block, seed)


def _sources(spark: SparkSession, plan: Plan) -> DataFrame:
    rows = [(k, i, s, t) for i, (k, s, t) in enumerate(zip(plan.keys, plan.sizes, plan.targets))]
    df = spark.createDataFrame(rows, "key string, source_no int, source_size long, target double")
    return F.broadcast(df) if len(rows) <= 10_000 else df  # some 100 bytes a row; beyond that a shuffle


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0..n-1: four Feistel rounds on the next even power of two,
    walked again for values that fall outside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(zlib.crc32(f"{key}/{r}".encode()) * 0x9E3779B1 % 2**64) for r in range(4)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            x = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (x >> np.uint64(33) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def draw_part(rng: np.random.Generator, slots: np.ndarray, left: int) -> np.ndarray:
    """Of each source, how many of ``left`` slots drawn without replacement are its own; for any
    number of slots.

    Each slot is first taken or not by itself; then as many as are too many or too few, some
    root of their number, are drawn among those taken or not. No slot differs from another
    in this, so that all sets of ``left`` slots are equally likely."""
    n = int(slots.sum())
    part = rng.binomial(slots, left / n if n else 0.0)
    over = int(part.sum()) - left
    among, sign = (part, -1) if over > 0 else (slots - part, 1)
    size, k = int(among.sum()), abs(over)
    if size < 4 * k:
        at = rng.permutation(size)[:k]
    else:
        at = np.unique(rng.integers(0, size, k))
        while len(at) < k:
            at = np.unique(np.append(at, rng.integers(0, size, k - len(at))))
    return part + sign * np.bincount(np.searchsorted(np.cumsum(among), at, "right"), minlength=len(slots))


def draw_counts(slots: np.ndarray, shards: int, shard: int, seed: int) -> np.ndarray:
    """Slots of each source in one shard. Shards are halved until one is left; what falls to the
    first half is a draw without replacement, keyed by the split, so that every shard comes to
    the same draws on its way by itself."""
    lo, hi, total = 0, shards, int(slots.sum())
    first = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = total * mid // shards - first
        part = draw_part(np.random.default_rng([seed, lo, hi]), slots, left)
        if shard < mid:
            hi, slots = mid, part
        else:
            lo, first, slots = mid, first + left, slots - part
    return slots


def draw_slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """shard, source_no, block_no: a row per slot. A source has at most ``MAX_REPEAT`` passes."""
    slots = np.rint(plan.expected).astype(np.int64)
    total = int(slots.sum())
    if not total:
        return spark.createDataFrame([], "shard long, source_no int, block_no long")
    shards = min(MAX_SHARDS, max(1, total // 8192))
    seed, blocks = plan.seed, np.array(plan.blocks, dtype=np.int64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in b.column(0).to_pylist():
                own = draw_counts(slots, shards, j, seed)
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["shard", "source_no", "n"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, s, n, first in zip(*(c.to_pylist() for c in b.columns)):
                for a in range(first, first + n, 1 << 18):
                    rank = np.arange(a, min(first + n, a + (1 << 18)))
                    turn = rank // blocks[s]
                    rank, turn = rank[turn < MAX_REPEAT], turn[turn < MAX_REPEAT]
                    for t in np.unique(turn):
                        got = permute(rank[turn == t] % blocks[s], int(blocks[s]), seed * 1_000_003 + s * 16 + int(t))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), shard)), pa.array(np.full(len(got), s, np.int32)), pa.array(got)], ["shard", "source_no", "block_no"])

    counts = spark.range(0, shards, 1, min(shards, 64)).mapInArrow(draw, "shard long, source_no int, n long")
    first = F.sum("n").over(Window.partitionBy("source_no").orderBy("shard")) - F.col("n")
    parts = max(1, min(2000, total // 200_000))
    return counts.select("shard", "source_no", "n", first.alias("first")).repartition(parts, "shard", "source_no").mapInArrow(expand, "shard long, source_no int, block_no long")


def line_up(sized: DataFrame, plan: Plan) -> DataFrame:
    """Each row's place ``begin`` in its source's line of words, by a two-level running sum:
    over hash buckets, then within a bucket, so that a hot source is never in one task."""
    n = int(min(1 << 20, max(16, plan.documents // 20_000)))
    keyed = sized.withColumn("key", source_key()).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    sums = keyed.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    base = sums.select("key", "bucket", (F.sum("n").over(Window.partitionBy("key").orderBy("bucket")) - F.col("n")).alias("base"))
    within = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return keyed.withColumn("within", within).join(base, ["key", "bucket"]).select("doc_id", "key", "size", (F.col("base") + F.col("within")).alias("begin"))


def taken_blocks(sized: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, key, begin, size, block_no, words, times: overlaps of documents with taken blocks."""
    spark = sized.sparkSession
    # slots grow out of a tiny range, whose size the planner would take for theirs and broadcast
    times = draw_slots(spark, plan).groupBy("source_no", "block_no").agg(F.count("*").alias("times"))
    rows = line_up(sized.filter("size > 0"), plan).join(_sources(spark, plan).select("key", "source_no"), "key")
    end = F.col("begin") + F.col("size")
    last = F.floor((end - 1) / plan.block).cast("long")
    over = rows.select("*", F.explode(F.sequence(F.floor(F.col("begin") / plan.block).cast("long"), last)).alias("block_no"))
    words = F.least(end, (F.col("block_no") + 1) * plan.block) - F.greatest(F.col("begin"), F.col("block_no") * plan.block)
    return over.withColumn("words", words).join(times.hint("merge"), ["source_no", "block_no"])


def mix_counts(docs: DataFrame, block: int = 64, seed: int = 20) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``.

    Null sources are a source of their own, the last; null and empty texts have size 0 and
    take nothing; an empty table gives no rows. Rows that repeat a doc_id each have their
    own place in the line. A pass takes a block once and there are at most three.
    """
    sized = common.stored(count_words(docs), "sized")
    plan = make_plan(sized, block, seed)
    got = taken_blocks(sized, plan).groupBy("doc_id", "key", "size", "begin").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    placed = line_up(sized.filter("size > 0"), plan).join(got.select("key", "begin", "taken").hint("merge"), ["key", "begin"], "left")
    rows = placed.select("doc_id", "key", "size", F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(sized.filter("size = 0").select("doc_id", source_key().alias("key"), "size", F.lit(0).cast("long").alias("taken")))
    return rows.join(_sources(sized.sparkSession, plan), "key").select("doc_id", F.when(F.substring("key", 1, 1) == "0", F.expr("substring(key, 2)")).alias("source"), "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, block: int = 64, seed: int = 20) -> DataFrame:
    """The mix as rows with the columns of ``docs``, whatever their names.

    Copy c of a document holds its words that lie in blocks taken at least c times; a whole
    copy keeps the text as it was, others join their words with blanks. Documents of which
    nothing is taken leave, null and empty texts among them; repeated rows each have a place
    of their own; an empty table gives no rows. ``n_chars`` follows the text where there is such a column.
    """
    sized = common.stored(count_words(docs), "sized")
    plan = make_plan(sized, block, seed)
    cuts = taken_blocks(sized, plan).groupBy("doc_id", "key", "size", "begin").agg(F.sort_array(F.collect_list(F.struct("block_no", "words", F.col("times").cast("int").alias("times")))).alias("cuts"))
    twin = Window.partitionBy("doc_id", "key", "size").orderBy("begin")
    cuts = cuts.withColumn("twin", F.row_number().over(twin))
    names, schema = docs.columns, docs.schema
    size, key, nth, c_id, c_key, c_size, c_nth, c_begin, c_cuts = common.free_names(docs, "size", "key", "twin", "id", "k", "s", "t", "begin", "cuts")

    def sizes(batches):
        at = names.index("text")
        for b in batches:
            n = [len(t.split()) if t else 0 for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*names, size])

    sized_rows = docs.mapInArrow(sizes, T.StructType([*schema.fields, T.StructField(size, T.LongType())]))
    sized_rows = sized_rows.filter(F.col(size) > 0).withColumn(key, source_key()).withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", key, size).orderBy("text")))
    c = cuts.select(F.col("doc_id").alias(c_id), F.col("key").alias(c_key), F.col("size").alias(c_size), F.col("twin").alias(c_nth), F.col("begin").alias(c_begin), F.col("cuts").alias(c_cuts)).hint("merge")
    joined = sized_rows.join(c, F.col("doc_id").eqNullSafe(F.col(c_id)) & (F.col(key) == F.col(c_key)) & (F.col(size) == F.col(c_size)) & (F.col(nth) == F.col(c_nth))).select(*names, c_begin, c_cuts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t_at, c_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
        for b in batches:
            owner, texts = [], []
            for i, (text, begin, cut) in enumerate(zip(b.column(t_at).to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist())):
                words = text.encode().split()
                for copy in range(1, MAX_REPEAT + 1):
                    spans = [(max(0, x["block_no"] * block - begin), x["words"]) for x in cut if x["times"] >= copy]
                    got = sum(w for _, w in spans)
                    if got:
                        owner.append(i)
                        texts.append(text if got == len(words) else b" ".join(b" ".join(words[a : a + w]) for a, w in spans).decode())
            out = b.select(names).take(pa.array(owner, pa.int64())).columns
            out[t_at] = pa.array(texts, pa.string())
            if c_at >= 0:
                out[c_at] = pa.array([len(t) for t in texts], pa.int64()).cast(out[c_at].type)
            yield pa.RecordBatch.from_arrays(out, names)

    return joined.mapInArrow(write, schema)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(common.documents(spark, sf_dir))
