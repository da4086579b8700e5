"""Toxicity by class-conditional Kneser-Ney models of words.

The history of a word is its document's class: absolute discounting of how many documents
of the class hold the word, interpolated with a backoff distribution that both classes
share, the word's continuation count, in how many documents of the whole corpus it stands.
A document compares its log-likelihoods under both, summed over all its words (runs of
letters, digits or other signs) and divided by their number. A class's own probability is
trusted as far as chance doesn't explain it: with z the two classes' difference of the word's
share of documents, or of words if that is less sure, by its standard error, the log ratio is
shrunk by ``max(0, 1 - (SURE / z)**2)``, and the rest of both likelihoods is the shared
backoff, the same for both. Where shares and ratio point to different classes, as they do for
words whose ratio comes from the classes' unequal discounts, all of it is. A logistic curve turns the mean into a probability; it is fitted on means
from models that have not seen the document.

Words are told apart by 64-bit hashes. Continuation counts cover all documents, in a table
in shared storage that grows with the vocabulary; class counts cover a bounded labelled
sample and are joined to it: the ratio of a word outside the sample is 0 whatever its
continuation count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .wordstream import Words, held_out, labelled_sample, sums

DISCOUNT, SURE = 0.9, 4.0
#: Labelled rows of each class to fit on, and their distinct words a document in all, at most.
SAMPLE, SAMPLE_WORDS = 8000, 4_000_000
THRESHOLD = 0.7
#: Distinct words that a task counts before it hands them on.
HELD = 500_000


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct words of all texts; then each text's distinct words as numbers into them,
    how often each stands in it, and where a text's begin."""
    w = Words(texts)
    words, number = np.unique(w.hash, return_inverse=True)
    n = max(1, len(words))
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    both, times = np.unique(owner * n + number, return_counts=True)
    return words, both % n, times, np.concatenate([[0], np.cumsum(np.bincount(both // n, minlength=len(texts)))])


def continuation_counts(docs: DataFrame) -> DataFrame:
    """word (64-bit hash), n: in how many documents each word of ``docs`` stands, in shared storage."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        words, number = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return words, np.bincount(number, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)

    def batch(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for b in batches:
            for _, _, texts in common.byte_chunks(b.column(0), 1_000_000):
                words, number, _, _ = _distinct(texts)
                parts.append((words, np.bincount(number, minlength=len(words)).astype(np.int64)))
                if sum(len(p[0]) for p in parts) > HELD:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > HELD // 2:
                        yield batch(*parts.pop())
        if parts:
            yield batch(*merged(parts))

    rows = common.id_text(docs).select("text").mapInArrow(count, "word long, n long")
    return common.stored(rows.groupBy("word").agg(F.sum("n").alias("n")), "continuation")


class Model:
    """log P(word | toxic) - log P(word | ordinary) of the words (sorted hashes) for which it isn't 0,
    and the curve on top."""

    def __init__(self, words: np.ndarray, ratio: np.ndarray, weights: np.ndarray, scale: float):
        self.words, self.ratio, self.weights, self.scale = words, np.append(ratio, 0).astype(np.float32), weights, scale

    def places(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, words)
        known = at < len(self.words)
        known[known] = self.words[at[known]] == words[known]
        at[~known] = len(self.words)
        return at

    def score(self, texts: list[bytes]) -> np.ndarray:
        words, number, times, first = _distinct(texts)
        return _curve(_mean_ratio(self.ratio, self.places(words)[number], times, first) / self.scale, self.weights)


def _ratio(counts: np.ndarray, shared: np.ndarray, documents: np.ndarray, types: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Of each word, given by both classes how many of its documents hold the word, and by the classes'
    numbers of documents, of distinct words, and of words a document in all."""
    logs = [np.log((np.maximum(c - DISCOUNT, 0) + DISCOUNT * max(1, t) * shared) / max(1.0, n)) for c, t, n in zip(counts, types, totals)]
    ratio = logs[1] - logs[0]
    least = np.full(len(shared), np.inf)
    for n in (np.maximum(documents, 1), np.maximum(totals, 1)):
        p = (counts.sum(0) + 0.5) / (n.sum() + 1)
        z = (counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
        least = np.minimum(least, np.sign(ratio) * z)
    return ratio * np.maximum(0, 1 - (SURE / np.maximum(least, 1e-9)) ** 2)


def _mean_ratio(ratio: np.ndarray, words: np.ndarray, times: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, given as words and how often each stands in it: log ratio of its likelihoods a word."""
    out = np.zeros(len(first) - 1)
    for i in range(0, len(out), 1000):  # a thousand texts at a time: the sums are in doubles
        own = first[i : i + 1001]
        part = slice(own[0], own[-1])
        every, n = (sums(v, own - own[0]) for v in (ratio[words[part]] * times[part], times[part]))
        out[i : i + 1000] = every / np.maximum(n, 1)
    return out


def _curve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x * w[0] + w[1], -30, 30)))


def fit_curve(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and scale of the logistic curve."""
    scale = max(float(x.std()), 1e-6)
    z, w = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (p - label) + 1e-2 * w)
    return w, scale


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_words: int = SAMPLE_WORDS) -> DataFrame:
    """doc_id, label, fold, words, times (distinct hashed words of a text and how often each stands
    there) of at most ``sample`` labelled rows of each class, in the order of their ids' hashes, as
    long as they have at most ``most_words`` distinct words a document in all; in shared storage."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in common.byte_chunks(b.column(3), 1_000_000):
                known, number, times, first = _distinct(texts)
                parts = [[x[a:z].tobytes() for a, z in zip(first[:-1], first[1:])] for x in (known[number], times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(3)), *(pa.array(p, pa.binary()) for p in parts)], ["doc_id", "label", "fold", "words", "times"])

    rows = common.stored(labelled_sample(docs, labels, "toxic", sample).mapInArrow(places, "doc_id long, label int, fold int, words binary, times binary"), "labelled")
    own = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.select("doc_id", "label", (F.length("times") / 4).cast("long").alias("size"))
    # the window holds sizes only; rows that repeat an id go together
    most = sizes.withColumn("n", F.sum("size").over(own)).groupBy("doc_id").agg(F.max("n").alias("n")).filter(F.col("n") <= most_words).select("doc_id")
    out = common.stored(rows.join(F.broadcast(most), "doc_id"), "sample")  # at most 2 * sample ids
    common.discard(rows)
    return out


def class_counts(rows: DataFrame) -> DataFrame:
    """word, c0 to c3: how many documents of each label and fold (2 * label + fold) hold the word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            for i, j in common.chunks(pc.binary_length(b.column(2)).to_pylist(), 8_000_000):
                part = b.column(2).slice(i, j - i)
                words, number = np.unique(np.frombuffer(b"".join(part.to_pylist()), np.int64), return_inverse=True)
                own = np.repeat(cell[i:j], pc.binary_length(part).to_numpy() // 8)
                yield pa.RecordBatch.from_arrays([pa.array(words), *(pa.array(np.bincount(number[own == c], minlength=len(words)).astype(np.int64)) for c in range(4))], ["word", "c0", "c1", "c2", "c3"])

    counted = rows.select("label", "fold", "words").mapInArrow(count, "word long, c0 long, c1 long, c2 long, c3 long")
    return counted.groupBy("word").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(4)))


#: For which documents a model is: all, or those of one fold, from the other fold's counts.
MODELS = {"every": ("c0 + c1", "c2 + c3"), "fold0": ("c1", "c3"), "fold1": ("c0", "c2")}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_words: int = SAMPLE_WORDS) -> Model | None:
    """A model, None if a class has no rows. Counts are made on the executors; to the driver come
    words whose ratio isn't 0, which some standard errors, so several documents of the sample,
    must speak for, and a number for each row of the sample."""
    rows = sampled(docs, labels, sample, most_words)
    size = [0] * 4
    for r in rows.groupBy("label", "fold").agg(F.count("*").alias("n")).collect():
        size[2 * r.label + r.fold] = r.n
    if not (size[0] + size[1] and size[2] + size[3]):
        return None
    backoff = continuation_counts(docs)
    table = common.stored(class_counts(rows).join(backoff.hint("merge"), "word"), "class-counts")
    sums_of = [(c, kind) for pair in MODELS.values() for c in pair for kind in ("types", "totals")]
    known = table.agg(*((F.count(F.when(F.expr(c) > 0, 1)) if kind == "types" else F.coalesce(F.sum(F.expr(c)), F.lit(0))).alias(f"s{i}") for i, (c, kind) in enumerate(sums_of))).first()
    known = np.array(known, np.float64).reshape(3, 2, 2)
    documents = np.array([[size[0] + size[1], size[2] + size[3]], [size[1], size[3]], [size[0], size[2]]], np.float64)
    every, total = backoff.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = (b.column(1).to_numpy() + 0.1) / (total + 0.1 * every)
            r = np.stack([_ratio(np.stack([b.column(2 + 2 * k + v).to_numpy().astype(np.float64) for v in (0, 1)]), shared, documents[k], known[k, :, 0], known[k, :, 1]) for k in range(3)])
            some = np.flatnonzero((r != 0).any(0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), *(pa.array(x[some]) for x in r)], ["word", *MODELS])

    cells = [F.expr(c).alias(f"{m}{v}") for m, pair in MODELS.items() for v, c in enumerate(pair)]
    found = table.select("word", "n", *cells).mapInArrow(ratios, "word long, every double, fold0 double, fold1 double").toArrow()
    words = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    words = words[order]
    every_ratio, *fold_ratio = (found.column(m).to_numpy()[order] for m in MODELS)
    others = docs.sparkSession.sparkContext.broadcast([Model(words, r, np.zeros(2), 1.0) for r in fold_ratio])  # words of the sample only

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for fold, own, times in zip(*(b.column(c).to_pylist() for c in (2, 3, 4))):
                m, times = others.value[fold], np.frombuffer(times, np.int32)
                got.append(_mean_ratio(m.ratio, m.places(np.frombuffer(own, np.uint64)), times, np.array([0, len(times)]))[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64())], ["doc_id", "label", "x"])

    points = rows.select("doc_id", "label", "fold", "words", "times").mapInArrow(means, "doc_id long, label int, x double").toArrow()
    x, label = points.column("x").to_numpy(), points.column("label").to_numpy()
    order = np.lexsort((x, points.column("doc_id").to_numpy()))  # however rows arrive
    for done in (table, backoff, rows):
        common.discard(done)
    return Model(words, every_ratio, *fit_curve(x[order], label[order]))


def score(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """``column`` (double) next to all columns of ``docs``; 0 without a model. Null texts are empty."""
    names = docs.columns
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the sample's words, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            for i, j, texts in common.byte_chunks(b.column(at), 1_000_000):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), pa.array(shared.value.score(texts))], [*names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``. Rows with null ids or empty
    texts are scored too; without labels of both classes every score is 0."""
    rows = score(common.id_text(docs), train(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``.

    Null and empty texts score as ordinary ones without evidence, repeated rows stay or go
    together, all columns stay whatever their names; an empty table gives no rows, and
    without labels of both classes every row stays."""
    (column,) = common.free_names(docs, "score")
    return score(docs, train(docs, labels), column).filter(F.col(column) < threshold).select(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
