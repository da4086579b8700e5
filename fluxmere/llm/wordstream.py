"""Words of many texts at once, as hashes in flat arrays, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_rng = np.random.default_rng(57)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
#: 0 blank, 1 letter (all of a multi-byte character counts as one), 2 digit, 3 other
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
_UP = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << n.bit_length()
        for i, base in enumerate((_UP, pow(_UP, -1, 2**64))):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Words:
    """Runs of letters, digits and other signs of some texts: ``hash`` (of lower case), ``kind``,
    ``begin``, ``end`` (in ``raw``) of each, and ``first``, the number of the first of each text."""

    def __init__(self, texts: list[bytes]):
        self.raw = raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = KIND[raw]
        edge = np.flatnonzero(np.diff(kind, prepend=0))
        kinds = kind[edge]
        some = kinds > 0
        self.begin, self.kind = edge[some], kinds[some]
        self.end = np.append(edge[1:], len(raw))[some]
        low = raw
        two = np.flatnonzero(raw[:-1] == 0xC3) + 1
        two = two[(raw[two] <= 0x9E) & (raw[two] != 0x97)]
        if len(two):  # À to Þ as à to þ
            low = raw.copy()
            low[two] += 0x20
        up, down = _power(len(raw) + 1)
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUE[low] * up[: len(raw)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.begin]) * down[self.begin])
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate([[0], np.searchsorted(self.begin, ends)])

    def upper(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word starts with, and whether it is two or more and only, A-Z."""
        big = (self.raw >= 65) & (self.raw < 91)
        n = np.concatenate([[0], np.cumsum(big)])
        size = self.end - self.begin
        return big[self.begin], (n[self.end] - n[self.begin] == size) & (size > 1)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (rows) between neighbours of ``first``; 0 of none."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def held_out(column: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id, label, fold, text of labelled rows to learn from: of each label at most ``most``,
    those whose ids hash least, so that the choice is the same on every run.

    Ids with several labels count as 1 if any is 1. The sample is at most 2 * most ids, which
    are broadcast; only its own texts leave the scan of ``docs``.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    parts = [known.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    fold = F.floor(F.crc32(F.col("doc_id").cast("string")) / 3) % 2
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "label", fold.cast("int").alias("fold"), "text")
