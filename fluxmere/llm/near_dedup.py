"""Near-duplicate detection by min-max hashing of five-word shingles, confirmed on full sets.

Each of 32 keyed hash functions gives two signature values, its least and its greatest
over the document's shingles; 64 values make 16 bands of 4. Two documents that share 85 %
of their shingles miss every band with a probability below one in 100,000.

Documents with one and the same shingle set are a class from the start, named by a hash of
the set. The names are random numbers, and their order is fixed: within a bucket a class is
compared with the classes of greater names once it becomes a head, and the heads of a round
are the least names, some ``HEADS`` of a bucket at first, ``MORE`` times as many a round later,
until every class has been a head. Links are contracted to components between rounds, and only
pairs of different components are compared. No bucket is ranked, sorted or capped.

Texts move only for pairs that may be links: a class carries a bitmap of its shingles, and
places set in one bitmap and not in the other bound what two sets share from above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH, FUNCTIONS, BANDS = 5, 32, 16
PERCENT = 85
HEADS, MORE = 4, 16
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
_KEYS = _rng.integers(1, 2**63, FUNCTIONS, dtype=np.uint64) | np.uint64(1)
_UP = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << n.bit_length()
        for i, base in enumerate((_UP, pow(_UP, -1, 2**64))):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle hashes, sorted and distinct within each text; their number by text)."""
    n = np.zeros(len(texts), np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(_BLANK[raw], prepend=True))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), n
    up, down = _power(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)])
    word = _mix((total[end] - total[begin]) * down[begin])
    words = np.diff(np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    n = np.where(words >= WIDTH, words - WIDTH + 1, np.minimum(words, 1))
    at = np.repeat(np.cumsum(words) - words - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    padded = np.append(word, np.zeros(WIDTH, np.uint64))
    flat = np.zeros(len(at), np.uint64)
    for i in range(WIDTH):
        # a text of fewer words is one shingle: places past its end count as nothing
        there = np.repeat(np.where(words > i, 1, 0), n).astype(np.uint64)
        flat += padded[at + i] * _PLACE[i] * there
    flat = _mix(flat)
    stop = np.cumsum(n)
    for a, b in zip((stop - n).tolist(), stop.tolist()):
        flat[a:b].sort()
    keep = np.append(True, flat[1:] != flat[:-1])
    keep[(stop - n)[n > 0]] = True
    return flat[keep], np.diff(np.concatenate([[0], np.cumsum(keep)])[stop], prepend=0)


def set_names(flat: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """16 bytes that name a set: two sums over its shingles. None for an empty one."""
    some = np.flatnonzero(n)
    out: list[bytes | None] = [None] * len(n)
    if len(some):
        first = (np.cumsum(n) - n)[some]
        sums = np.stack([np.add.reduceat(_mix(flat + np.uint64(s)), first) for s in (1, 2)], 1).astype(">u8")
        for i, s in zip(some.tolist(), sums):
            out[i] = s.tobytes()
    return out


def bands_of(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(sets, BANDS) int64 bucket keys of the non-empty sets, the band's number mixed in."""
    first = (np.cumsum(n) - n)[n > 0]
    values = np.empty((len(first), 2 * FUNCTIONS), np.uint64)
    if len(first):
        for i, k in enumerate(_KEYS):
            x = flat * k
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            values[:, 2 * i] = np.minimum.reduceat(x, first)
            values[:, 2 * i + 1] = np.maximum.reduceat(x, first)
    rows = 2 * FUNCTIONS // BANDS
    out = np.zeros((len(first), BANDS), np.uint64)
    for r in range(rows):
        out = _mix(out * np.uint64(_UP) + values[:, r::rows])
    return (out + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def bitmaps(flat: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """For each set a bitmap of 3 to 6 bits a shingle, a power of two and 64 at least; None for an empty one."""
    out: list[bytes | None] = []
    for k, stop in zip(n.tolist(), np.cumsum(n).tolist()):
        if k:
            bits = np.zeros(max(64, 1 << (3 * k).bit_length()), np.uint8)
            bits[flat[stop - k : stop] & np.uint64(len(bits) - 1)] = 1
            out.append(np.packbits(bits).tobytes())
        else:
            out.append(None)
    return out


def may_link(a: pa.BinaryArray, b: pa.BinaryArray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sets, given by bitmaps and sizes, can have 100 * shared >= percent * union.

    A place set in one bitmap only holds a shingle that the other set lacks, so the bound
    never excludes a link."""
    la, lb = (np.diff(np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, x.offset * 4)) for x in (a, b))
    out = np.zeros(len(na), bool)
    for x, y in np.unique(np.stack([la, lb], 1), axis=0).tolist():
        every = np.flatnonzero((la == x) & (lb == y))
        step = max(1, 4_000_000 // (x + y))
        for at in (every[i : i + step] for i in range(0, len(every), step)):
            p, q = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1) for c in (a, b))
            while p.shape[1] > q.shape[1]:
                p = p[:, : p.shape[1] // 2] | p[:, p.shape[1] // 2 :]
            while q.shape[1] > p.shape[1]:
                q = q[:, : q.shape[1] // 2] | q[:, q.shape[1] // 2 :]
            p, q = np.ascontiguousarray(p).view(np.uint64), np.ascontiguousarray(q).view(np.uint64)
            only_p, only_q = (np.bitwise_count(v & ~w).sum(1, dtype=np.int64) for v, w in ((p, q), (q, p)))
            shared = np.minimum(na[at] - only_p, nb[at] - only_q)
            out[at] = 100 * shared >= percent * (na[at] + nb[at] - shared)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, of_text (its 64-bit hash), n_shingles, node (null for empty sets), place (of the node
    among all names, 0 to 1), bands, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in common.byte_chunks(b.column(1), 1_000_000):
                flat, n = shingle_sets(texts)
                keys = bands_of(flat, n)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))
                names = set_names(flat, n)
                place = [x and int.from_bytes(x[:6], "big") / 2.0**48 for x in names]
                own = [b.column(c).slice(i, j - i) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(names, pa.binary()), pa.array(place, pa.float64()), bands, pa.array(bitmaps(flat, n), pa.binary())], SKETCH)

    rows = common.id_text(docs).select("doc_id", "text", F.xxhash64("text").alias("of_text"))
    return rows.mapInArrow(run, "doc_id long, of_text long, n_shingles long, node binary, place double, bands array<long>, bits binary")


SKETCH = ["doc_id", "of_text", "n_shingles", "node", "place", "bands", "bits"]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (u, v) of the components of the edges (u, v) of one partition, v the least node."""
    root: dict = {}

    def find(x: bytes) -> bytes:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    rows = [(x, y) for x in list(root) if (y := find(x)) != x]
    for i in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + 50_000]], pa.binary()) for c in (0, 1)], ["u", "v"])


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): stars of the connected components of ``links`` (a, b), label the least node.

    Each partition of links first becomes a forest of stars; then large-star and small-star
    steps alternate, each a grouped minimum and a join, with the edges written to shared
    storage after each round. Nodes without a link are absent.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())

    edges = common.stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_forest, "u binary, v binary").distinct(), name)
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = common.stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        common.discard(edges)
        edges = common.stored(small, name)
        common.discard(large)
        now = state(edges)
        if now == before:
            # a root is never a left end: every remaining edge leads from a node to its label
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
            labels = common.stored(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), "labels")
            common.discard(edges)
            return labels
        before = now


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union; ``texts`` (node, text)
    has one text of each class.

    A first class meets its partners, at most some 500 per salt, in a sorted stream that holds
    one set at a time.
    """
    salted = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / 500).alias("salts")), "a")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    wanted = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("node")).unionByName(salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("node")))
    rows = texts.join(wanted.hint("shuffle_hash"), "node").select("a", "salt", "role", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for i, j, texts in common.byte_chunks(batch.column(4), 1_000_000):
                a, salt, role, node = (batch.column(c).slice(i, j - i).to_pylist() for c in range(4))
                flat, n = shingle_sets(texts)
                sets, out = np.split(flat, np.cumsum(n)[:-1]), []
                for k in range(j - i):
                    if role[k] == 0:
                        key, own = (a[k], salt[k]), sets[k]
                    elif key == (a[k], salt[k]):
                        x = sets[k]
                        at = np.searchsorted(own, x)
                        at[at == len(own)] = 0
                        shared = int(np.count_nonzero(own[at] == x))
                        if 100 * shared >= percent * (len(own) + len(x) - shared):
                            out.append((a[k], node[k]))
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.binary()) for c in (0, 1)], ["a", "b"])

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, "a binary, b binary")


def class_texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text: one text of each class that has a bucket with another one."""
    wanted = members.groupBy("node").agg(F.first("doc_id").alias("doc_id"), F.first("of_text").alias("of_text"))
    rows = common.id_text(docs).select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("hash"))
    found = rows.join(wanted.hint("shuffle_hash"), (F.col("hash") == F.col("of_text")) & F.col("id").eqNullSafe(F.col("doc_id")))
    return common.stored(found.select("node", "text").dropDuplicates(["node"]), "texts")


def link_classes(sketches: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(node, label) of every class that is linked to another one; None if there are none."""
    pick = F.min(F.struct("doc_id", "of_text"))
    classes = sketches.filter("node is not null").groupBy("node").agg(pick.alias("of"), F.first("n_shingles").alias("n"), F.first("place").alias("place"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = common.stored(classes.select("node", "of.*", "n", "place", "bands", "bits"), "classes")
    bucketed = classes.select("node", F.explode("bands").alias("band"))
    many = bucketed.groupBy("band").agg(F.count("*").alias("many")).filter("many > 1")
    members = common.stored(bucketed.join(many.hint("merge"), "band").join(classes.drop("bands"), "node"), "buckets")
    common.discard(classes)
    texts, labels = class_texts(members, docs), None
    largest = members.agg(F.max("many")).first()[0] or 0
    past, heads = 0, HEADS
    while past < largest:
        now = members.filter(F.col("many") > past)
        if labels is None:
            now = now.withColumn("label", F.col("node")).withColumn("apart", F.lit(True))
        else:
            # two classes that are both with their bucket's least one are linked: of a pair, one is apart
            now = now.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
            main = now.groupBy("band").agg(F.min(F.struct("node", "label")).alias("least"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band", F.col("least.label").alias("main"))
            now = common.stored(now.join(main.hint("merge"), "band").withColumn("apart", F.col("label") != F.col("main")).drop("main"), "live")
        h = now.filter((F.col("place") * F.col("many") >= past) & (F.col("place") * F.col("many") < heads)).select("band", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("bits").alias("xa"), F.col("apart").alias("h_apart"))
        m = now.select("band", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("bits").alias("xb"), "apart")
        both = h.filter("h_apart").join(m.hint("merge"), "band")
        if labels is not None:
            both = both.unionByName(h.filter("not h_apart").join(m.filter("apart").hint("merge"), "band"))
        fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        both = both.filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & fits).select("a", "b", "xa", "xb", "na", "nb")

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for i in range(0, len(x), 2000):
                    y = x.slice(i, 2000)
                    keep = may_link(y.column(2), y.column(3), y.column(4).to_numpy(), y.column(5).to_numpy(), percent)
                    yield y.select(["a", "b"]).filter(pa.array(keep))

        pairs = common.stored(both.mapInArrow(prune, "a binary, b binary").distinct(), "pairs")
        if labels is not None:
            common.discard(now)
        if not pairs.isEmpty():
            found = common.stored(confirm(pairs, texts, percent), "links")
            if not found.isEmpty():
                stars = found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
                old, labels = labels, components(stars)
                common.discard(old)
            common.discard(found)
        common.discard(pairs)
        past, heads = heads, heads * MORE
    common.discard(members)
    common.discard(texts)
    return labels


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, of_text, n_shingles, node, label for every row of ``docs``; the last two null for empty sets."""
    sketches = common.stored(sketch(docs), "sketches")
    labels = link_classes(sketches, docs, percent)
    rows = sketches.select("doc_id", "of_text", "n_shingles", "node")
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Texts without words, null texts among them, have an empty set and stand alone. Every row
    goes by its own text: rows that repeat a doc_id with other texts may be in several
    components, equal rows share one. A row with a null id is linked as any other but lends no
    name: its component has the least id of the others, null if there is none. Columns other
    than doc_id and text are not read. An empty table gives no rows.
    """
    rows = _labelled(docs, percent)
    least = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    named = rows.join(least.hint("merge"), "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: of the least doc_id, and of its
    texts, if it has several in the group, the one whose set has the least name.

    Rows are told apart by id and text: rows that repeat an id with unrelated texts stay each,
    rows equal in both stay once. Rows with null ids stay, and don't stand for others; texts
    without words stay."""
    rows = _labelled(docs, percent).filter("doc_id is not null")
    least = rows.filter("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "node", "of_text")).alias("k")).select("k.doc_id", "k.of_text")
    kept = least.unionByName(rows.filter("label is null").select("doc_id", "of_text").distinct())
    id_name, text_name = common.free_names(docs, "id", "of_text")
    kept = kept.select(F.col("doc_id").alias(id_name), F.col("of_text").alias(text_name))
    keyed = docs.filter("doc_id is not null").withColumn(id_name, F.col("doc_id").cast("long")).withColumn(text_name, F.xxhash64(F.coalesce("text", F.lit(""))))
    one = keyed.join(kept.hint("merge"), [id_name, text_name], "left_semi").dropDuplicates([id_name, text_name])
    return one.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
