"""Quality by random-indexing word vectors, pooled per document, under a small network.

Every word (run of letters, digits or other signs, hashed to ``2**14`` places) has a sparse
random index vector; its context vector sums the index vectors of its neighbours over the
whole corpus. A document is the mean of its words' index and normalised context vectors,
of marks for capital and repeated words among them. A two-layer numpy network, trained on
a bounded labelled sample, gives a logit that a temperature, fitted on rows kept out of
training, turns into a calibrated probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordstream import Words, held_out, labelled_sample, mix, sums

BITS, WIDTH, SIGNS, HIDDEN = 14, 64, 4, 16
PLACES = 1 << BITS
SLICES = 64
MARKS = 4  # first places: any word, capital first letter, all capitals, repeat of the word before
#: Labelled rows of each class to fit on, at most.
SAMPLE = 8000
THRESHOLD = 0.5


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(PLACES, SIGNS) dimensions and signs of the sparse index vectors."""
    bits = np.stack([mix(np.arange(PLACES, dtype=np.uint64) * np.uint64(SIGNS) + np.uint64((i + 1) * 0xA0761D6478BD642F % 2**64)) for i in range(SIGNS)], 1)
    return (bits % np.uint64(WIDTH)).astype(np.int64), np.where(bits >> np.uint64(63), 1, -1)


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed words, where each text's begin, (texts, MARKS) counts of marked words)."""
    w = Words(texts)
    code = np.where(w.kind == 2, np.uint64(7), w.hash)  # all numbers are one word
    place = MARKS + (mix(code) % np.uint64(PLACES - MARKS)).astype(np.int64)
    capital, capitals = w.upper()
    again = np.append(False, w.hash[1:] == w.hash[:-1]) if len(place) else np.zeros(0, bool)
    # a word is repeated too if one sign stands between
    again[2:] |= (w.hash[2:] == w.hash[:-2]) & (w.kind[2:] == 1)
    marks = np.stack([np.ones(len(place)), capital, capitals, again], 1)
    return place, w.first, sums(marks, w.first)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """(PLACES, WIDTH) sums of the neighbours' index vectors over all documents.

    Each partition sums its own table and hands it on in slices; a slice's task adds them up
    as they stream by. The table is 4 MB at any corpus size."""
    dims, signs = _index_vectors()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(PLACES * WIDTH, np.int64)
        for b in batches:
            for _, _, texts in common.byte_chunks(b.column(0), 1_000_000):
                place, first, _ = word_places(texts)
                inner = np.ones(len(place), bool)
                inner[first[:-1][first[:-1] < len(place)]] = False
                right = np.flatnonzero(inner)
                a, z = place[right - 1], place[right]
                for one, other in ((a, z), (z, a)):
                    for s in range(SIGNS):
                        table += np.bincount(one * WIDTH + dims[other, s], weights=signs[other, s], minlength=len(table)).astype(np.int64)
        parts = [x.astype("<i4").tobytes() for x in np.split(table, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[s] = total.get(s, 0) + np.frombuffer(x, "<i4").astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "part"])

    rows = common.id_text(docs).select("text").mapInArrow(count, "slice int, part binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, part binary").toArrow()
    out = np.zeros((SLICES, PLACES * WIDTH // SLICES))
    for s, x in zip(rows.column("slice").to_pylist(), rows.column("part").to_pylist()):
        out[s] = np.frombuffer(x, np.int64)
    return out.reshape(PLACES, WIDTH)


def word_vectors(context: np.ndarray) -> np.ndarray:
    dims, signs = _index_vectors()
    index = np.zeros((PLACES, WIDTH))
    for s in range(SIGNS):
        np.add.at(index, (np.arange(PLACES), dims[:, s]), signs[:, s])
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return index + 2 * context / np.maximum(norm, 1e-9) * (norm > 0)


def pool(vectors: np.ndarray, place: np.ndarray, first: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Mean over each text's words, marks added; 0 of none."""
    total = np.zeros((len(first) - 1, vectors.shape[1]))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        total[some] = np.add.reduceat(vectors[place], first[some], axis=0)
    return (total + marks @ vectors[:MARKS]) / np.maximum(np.diff(first), 1)[:, None]


class Network:
    """tanh hidden layer on standardised pooled vectors; a temperature divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check: np.ndarray, seed: int = 5, rounds: int = 1500):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z, rng = (x - self.mean) / self.scale, np.random.default_rng(seed)
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        own = np.flatnonzero(~check)
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        for t in range(1, rounds + 1):
            i = own[rng.integers(0, len(own), 256)]
            h = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
            back = d[:, None] * p[2] * (1 - h * h)
            g = [z[i].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = p[k] - 0.01 * (1 - t / (rounds + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        self.p, self.heat = p, 1.0
        rows = np.flatnonzero(check) if check.any() else own
        logit, heats = self.logit(x[rows]), np.geomspace(0.25, 8, 60)
        loss = [np.logaddexp(0, np.where(y[rows] == 1, -1, 1) * logit / t).mean() for t in heats]
        self.heat = float(heats[int(np.argmin(loss))])

    def hidden_table(self, vectors: np.ndarray) -> np.ndarray:
        """Words' shares of the hidden layer's input: pooling these pools the vectors."""
        return vectors @ (self.p[0] / self.scale[:, None])

    def logit_of(self, hidden: np.ndarray) -> np.ndarray:
        return np.tanh(hidden - (self.mean / self.scale) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.logit_of(x @ (self.p[0] / self.scale[:, None]))


class Model:
    """Network and the words' table (1 MB) that it needs to score texts."""

    def __init__(self, network: Network, vectors: np.ndarray):
        self.network, self.table = network, network.hidden_table(vectors)

    def score(self, texts: list[bytes]) -> np.ndarray:
        logit = self.network.logit_of(pool(self.table, *word_places(texts)))
        return 1 / (1 + np.exp(-np.clip(logit / self.network.heat, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """A model fitted on at most ``sample`` labelled rows of each class; their pooled vectors
    come to the driver. With one class only, that class; without labels 0.5. A fifth of the
    rows, by hash of the id, fits the temperature."""
    vectors = word_vectors(context_vectors(docs))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in common.byte_chunks(b.column(3), 500_000):
                x = pool(shared.value, *word_places(texts))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    rows = labelled_sample(docs, labels, "quality", sample).mapInArrow(pooled, "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    y, ids = rows.column("label").to_numpy(), rows.column("doc_id").to_numpy()
    if len(np.unique(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    x = np.array([np.frombuffer(r, np.float64) for r in rows.column("x").to_pylist()])
    check = mix(ids.astype(np.uint64)) % np.uint64(5) == 0
    if len(np.unique(y[~check])) < 2:
        check[:] = False
    return Model(Network(x, y.astype(np.float64), check), vectors)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; null texts are empty and are
    scored like any other, an empty table gives no rows."""
    model, rows = train(docs, labels), common.id_text(docs)
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j, texts in common.byte_chunks(b.column(1), 1_000_000):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(shared.value.score(texts))], ["doc_id", "score"])

        scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
