"""Packing token sequences by minimum bin slack over a histogram of piece lengths.

Whole windows are cut off long documents first; what remains of each is a piece shorter
than a window. Only the histogram of piece lengths (at most ``capacity`` rows, whatever
the corpus) reaches the driver. There each pattern takes the largest remaining length and
fills the window as closely as possible by a bitset subset-sum over the other remaining
lengths, backtracked to counts; a pattern is repeated as often as the counts allow, so
the number of patterns follows the number of lengths, not of documents. Pieces then find
their window from their rank within their length, on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths whose sum comes closest to ``room`` from below.

    ``reach[i]`` is a bitset of the sums that the first i lengths can make; a length with
    count c enters as parts of 1, 2, 4 ... copies. Stops at the first exact fill.
    """
    lengths = [n for n in sorted(counts, reverse=True) if n <= room and counts[n]]
    mask, reach = (1 << (room + 1)) - 1, [1]
    for n in lengths:
        bits, left, part = reach[-1], min(counts[n], room // n), 1
        while left:
            k = min(part, left)
            bits |= bits << (k * n) & mask
            left -= k
            part *= 2
        reach.append(bits)
        if bits >> room & 1:
            break
    goal, used = reach[-1].bit_length() - 1, {}
    for i in range(len(reach) - 1, 0, -1):
        n, k = lengths[i - 1], 0
        while not reach[i - 1] >> (goal - k * n) & 1:
            k += 1
        if k:
            used[n] = k
            goal -= k * n
    return used


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: count})]: patterns that together use the histogram up exactly."""
    left, out = {n: c for n, c in histogram.items() if c}, []
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        pattern = fill(rest, capacity - top)
        pattern[top] = pattern.get(top, 0) + 1
        times = min(left[n] // k for n, k in pattern.items())
        out.append((times, pattern))
        for n, k in pattern.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id`` and cut: full windows, then the rest."""
    path = path or tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.codec(path)
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            rows, owner = [], []
            for a, b in common.chunks(pc.binary_length(texts).to_pylist(), 4_000_000):
                flat, counts = codec.encode(texts.slice(a, b - a))
                at = 0
                for i, n in enumerate(counts.tolist(), a):
                    ids = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for s in range(0, n + 1, capacity):
                        piece = ids[s : s + capacity]
                        owner.append(i)
                        rows.append((s, len(piece), zlib.crc32(piece.tobytes()), n + 1))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return common.id_text(docs).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece a ``sequence_id`` and an ``offset``; ``pieces`` should be stored, it is read twice.

    Ranks within a length are two-level (hash bucket, then order within it), so a length
    that a third of all pieces share is never in one task.
    """
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    n_buckets = int(min(65536, max(16, sum(histogram.values()) // 200_000)))
    # per length: ranks from, copies in a window, first window, offset in it
    entries: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, pattern in plan_windows(histogram, capacity):
        offset = 0
        for n in sorted(pattern, reverse=True):
            k, at = pattern[n], used.get(n, 0)
            entries.setdefault(n, []).append((at, k, first, offset))
            used[n] = at + times * k
            offset += n * k
        first += times
    table = {n: np.array(e, dtype=np.int64) for n, e in entries.items()}

    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(n_buckets))
    keyed = pieces.withColumn("bucket", bucket)
    sums = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = sums.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(order) - 1).join(base, ["length", "bucket"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)).astype(np.int64) for i in (2, 5))
            seq, off = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                e, m = table[int(n)], length == n
                k = np.searchsorted(e[:, 0], rank[m], side="right") - 1
                j = rank[m] - e[k, 0]
                seq[m] = e[k, 2] + j // e[k, 1]
                off[m] = e[k, 3] + j % e[k, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of whole documents with their place in sequences of at most ``capacity`` ids.

    Every document has at least its end id, also with an empty or null text; an empty table
    gives no rows; repeated rows and null ids are packed like any others.
    """
    return pack(common.stored(cut_pieces(docs, path, capacity), "pieces"), capacity)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir))
