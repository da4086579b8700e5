"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph (text between line feeds) hashes to a wide vector: eight 64-bit lanes of its
BLAKE2b digest, and 128 16-bit lanes, each the sum of random signs of the paragraph's
phrases (runs of words that end where a word's own hash says so, four words on average;
a phrase's further times in the paragraph count as phrases of their own).
A fingerprint is the lane-wise sum over all paragraphs modulo 2**64 and 2**16. So equal
multisets of paragraphs have equal fingerprints in any order, a paragraph is added or
taken away by adding or subtracting its vector, and the squared length of the difference
of two sign vectors estimates how many phrases differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WIDE, SIGNS = 8, 128
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            n = 1 << n.bit_length()
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(n - 1, _BASE, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(n - 1, pow(_BASE, -1, 2**64), np.uint64))])
        return self.up, self.down


_powers = _Powers()


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * 0xD1B54A32D192ED03 % 2**64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _signs(texts: list[bytes]) -> np.ndarray:
    """(len(texts), SIGNS) int64 sums of phrase signs, all texts at once."""
    out = np.zeros((len(texts), SIGNS), np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return out
    up, down = _powers.get(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    word = _mix((total[end] - total[begin]) * down[begin], 1)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    last = (word >> np.uint64(62) == 0) | (np.append(lines[begin[1:]], -1) != lines[end])
    stop = np.flatnonzero(last)
    first = np.concatenate([[0], stop[:-1] + 1])
    a, b = begin[first], end[stop]
    phrase = (total[b] - total[a]) * down[a]
    # the k-th time a phrase stands in its paragraph counts as one of its own: lengths grow with
    # the number of phrases, not with its square where one is repeated over and over
    group = phrase ^ _mix(lines[a].astype(np.uint64), 9)
    order = np.argsort(group, kind="stable")
    new = np.flatnonzero(np.diff(group[order], prepend=~group[order[:1]]))
    turn = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    phrase[order] = _mix(phrase[order], 8) + turn.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(ends, a, side="right")
    for i in range(0, len(a), 1 << 15):
        part, own = phrase[i : i + (1 << 15)], owner[i : i + (1 << 15)]
        bits = np.unpackbits(np.stack([_mix(part, s + 2) for s in range(SIGNS // 64)], 1).view(np.uint8), axis=1)
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        plus = np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
        out[own[cut]] += 2 * plus.astype(np.int64) - np.diff(np.append(cut, len(own)))[:, None]
    return out


def _wide(text: bytes) -> np.ndarray:
    digests = b"".join([hashlib.blake2b(p).digest() for p in text.split(b"\n")])
    return np.frombuffer(digests, "<u8").reshape(-1, WIDE).sum(0, dtype=np.uint64)


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(wide lanes uint64, sign lanes int16 modulo 2**16) of each text."""
    return np.array([_wide(t) for t in texts], np.uint64).reshape(-1, WIDE), _signs(texts).astype(np.int16)


def combine(a, b, sign: int = 1):
    """Fingerprint of all paragraphs of both (sign 1), or of ``a`` without those of ``b`` (-1)."""
    return (a[0] + b[0], a[1] + b[1]) if sign == 1 else (a[0] - b[0], a[1] - b[1])


def to_text(wide: np.ndarray, signs: np.ndarray) -> str:
    return wide.astype("<u8").tobytes().hex() + signs.astype("<i2").tobytes().hex()


def from_text(s: str):
    raw = bytes.fromhex(s)
    return np.frombuffer(raw[: 8 * WIDE], "<u8"), np.frombuffer(raw[8 * WIDE :], "<i2")


def likeness(a, b) -> np.ndarray:
    """Estimated shared part of the phrases of both, 0 to 1; 1 where fingerprints are equal."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    # modulo 2**16 a small difference stays small, also where long texts have wrapped around
    d = ((a[1] - b[1]).astype(np.float64) ** 2).sum(-1)
    n = (x**2).sum(-1) + (y**2).sum(-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        near = np.clip(np.where(n + d > 0, (n - d) / (n + d), 0.0), 0.0, 1.0)
    return np.where((a[0] == b[0]).all(-1), 1.0, np.minimum(near, 1.0))


def edit(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """Result columns of texts, each with the text that follows it."""
    # a text is mostly the following one of the row before: fingerprint each once
    place: dict[str, int] = {}
    at = [place.setdefault(t, len(place)) for t in texts]
    after = [place.setdefault(t, len(place)) for t in following]
    edited = [edit(t, f).encode() for t, f in zip(texts, following)]
    w, s = fingerprints([t.encode() for t in place] + edited)
    k = len(place)
    own, nxt, ed = (w[at], s[at]), (w[after], s[after]), (w[k:], s[k:])
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
        pa.array([to_text(*x) for x in zip(*own)]), pa.array([to_text(*x) for x in zip(*ed)]), pa.array(likeness(own, ed)), pa.array(likeness(own, nxt)),
    ]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts and of their edited forms, and likenesses.

    Rows follow each other by ascending doc_id (nulls first, ties by text), the first
    follows the last; a single row follows itself. Null texts are empty; an empty table
    gives no rows. The texts are range-partitioned once; each partition's last row and
    first text are paired across partitions afterwards, two rows a partition.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held, text = TaskContext.get().partitionId(), None, None, None
        none = lambda n, t: pa.nulls(n, t)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            if not ids:
                continue
            if first is None:
                first = texts[0]
            else:
                ids, texts = [held, *ids], [text, *texts]
            for i, j in common.chunks([len(t) for t in texts[:-1]], 1_000_000):
                cols = _compare(ids[i:j], texts[i:j], texts[i + 1 : j + 1])
                yield pa.RecordBatch.from_arrays([*cols, pa.array([0] * (j - i), pa.int32()), pa.array([part] * (j - i), pa.int32()), none(j - i, pa.string())], [*_FIELDS, "kind", "part", "edge"])
            held, text = ids[-1], texts[-1]
        if first is not None:
            cols = [pa.array([held, None], pa.int64()), *(none(2, t) for t in types[1:])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([1, 2], pa.int32()), pa.array([part] * 2, pa.int32()), pa.array([text, first])], [*_FIELDS, "kind", "part", "edge"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, following = (c.to_pylist() for c in b.columns)
            for i, j in common.chunks([len(t) for t in texts], 1_000_000):
                yield pa.RecordBatch.from_arrays(_compare(ids[i:j], texts[i:j], following[i:j]), _FIELDS)

    ordered = common.id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    got = common.stored(ordered.mapInArrow(walk, RESULT + ", kind int, part int, edge string"), "fingerprints")
    order = Window.orderBy("part")
    nexts = got.filter("kind = 2").select("part").withColumn("after", F.coalesce(F.lead("part").over(order), F.first("part").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    lasts = got.filter("kind = 1").select("doc_id", "part", F.col("edge").alias("text"))
    firsts = got.filter("kind = 2").select(F.col("part").alias("after"), F.col("edge").alias("following"))
    pairs = lasts.join(nexts, "part").join(firsts, "after").select("doc_id", "text", "following")
    return got.filter("kind = 0").select(*_FIELDS).unionByName(pairs.mapInArrow(close, RESULT))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(common.documents(spark, sf_dir))
