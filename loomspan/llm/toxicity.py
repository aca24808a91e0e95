"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's subwords are its character n-grams (3 to 5 bytes, with the word's edges), hashed to buckets; misspelt and inflected
words share most of them with their stems. A text is the average of the subword vectors of its four most toxic words under
the model itself, and a linear softmax scores that average: insults in a long text are not averaged away, and one odd word
is not enough. Training starts on whole texts and goes on with the words that decide, chosen anew in every round, with three
tenths of their subwords left out at random. Vectors and softmax are trained together on a bounded sample of labelled rows
(ROWS ids, and at most CHARS characters for each label). As the softmax is linear, a trained model is one number for each
bucket.

Edge cases: a null or empty text, or one without words, has score 0; a text of fewer than four words is the average of all
of them; a null doc_id is in no labelled row and its fold is that of a null (not held out); repeated rows are scored each;
without any labelled row of both kinds all scores are 0; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, small_batches, table
from .decontaminate import BETWEEN
from .labelled import sample
from .text import LOWER, Texts, slices

FOLDS, HELD, THRESHOLD = 4, 2, 0.3
ROWS, CHARS = 6_000, 6_000_000
BUCKETS, DIM, SIZES = 1 << 17, 8, (3, 4, 5)
WORST, DROP = 4, 0.3
SCORE_SLICE = 1_000_000


def subwords(batch: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and word of every subword, and the first word of each document (n + 1)."""
    n = len(batch)
    doc = np.repeat(np.arange(n), np.diff(batch.offsets))
    raw = np.full(len(batch.data) + n + 1, 0x20, np.uint8)
    raw[1 + np.arange(len(doc)) + doc] = LOWER[batch.data]
    gap = BETWEEN[raw]
    start = np.zeros(len(raw), bool)
    start[1:] = gap[:-1] & ~gap[1:]
    word = np.cumsum(start, dtype=np.int32) - 1
    first = np.searchsorted(np.flatnonzero(start), batch.offsets + np.arange(n + 1))
    gaps = np.append(0, np.cumsum(gap, dtype=np.int32))
    wide = np.where(gap, 0x20, raw).astype(np.uint32)
    buckets, of = [], []
    for size in SIZES:
        k = len(raw) - size + 1
        if k <= 0:
            continue
        at = np.flatnonzero(gaps[size - 1 : size - 1 + k] == gaps[1 : 1 + k])
        h = np.full(len(at), size, np.uint32)
        for i in range(size):
            h = h * np.uint32(0x01000193) + wide[at + i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        buckets.append((h & np.uint32(BUCKETS - 1)).astype(np.int32))
        of.append(word[at + 1])
    return np.concatenate([np.zeros(0, np.int32), *buckets]), np.concatenate([np.zeros(0, np.int32), *of]), first


def worst(scores: np.ndarray, first: np.ndarray, k: int = WORST) -> tuple[np.ndarray, np.ndarray]:
    """The places of the k greatest scores of each document, the first of equal ones, and their documents; ascending."""
    left, counts = scores.copy(), np.diff(first)
    full = np.flatnonzero(counts)
    doc = np.repeat(np.arange(len(full)), counts[full])
    places = [np.zeros(0, np.int64)]
    for _ in range(k if len(full) else 0):
        top = np.maximum.reduceat(left, first[full])
        hit = np.flatnonzero((left == top[doc]) & (left > -np.inf))
        places.append(hit[np.diff(doc[hit], prepend=-1) > 0])
        left[places[-1]] = -np.inf
    chosen = np.sort(np.concatenate(places))
    return chosen, full[doc[chosen]] if len(full) else chosen


class Model:
    """Vectors (buckets x dim) and a linear softmax of two classes, of which only the difference matters."""

    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.vectors = draw.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
        self.line, self.bias = draw.normal(0, 0.3, DIM), 0.0
        self.seen = [np.full((BUCKETS, DIM), 1e-8), np.full(DIM, 1e-8), np.full(1, 1e-8)]

    def weights(self) -> np.ndarray:
        return self.vectors @ self.line

    def step(self, bags: list[np.ndarray], y: np.ndarray, rate: float) -> None:
        """One Adagrad step on the log loss of a batch of bags."""
        lens = np.array([max(1, len(b)) for b in bags])
        flat_bags = np.concatenate(bags)
        of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        means = np.stack([np.bincount(of, self.vectors[flat_bags, d], len(bags)) for d in range(DIM)], 1) / lens[:, None]
        error = 1 / (1 + np.exp(-np.clip(means @ self.line + self.bias, -30, 30))) - y
        per_bag = (error / lens / len(bags))[of]
        used, inverse = np.unique(flat_bags, return_inverse=True)
        pull = np.bincount(inverse, per_bag, len(used))
        grads = (pull[:, None] * self.line[None, :], means.T @ error / len(bags), np.array([error.mean()]))
        self.seen[0][used] += grads[0] ** 2
        self.vectors[used] -= rate * grads[0] / np.sqrt(self.seen[0][used])
        for i, (value, grad) in enumerate(((self.line, grads[1]),), 1):
            self.seen[i] += grad**2
            value -= rate * grad / np.sqrt(self.seen[i])
        self.seen[2] += grads[2] ** 2
        self.bias -= float(rate * grads[2][0] / np.sqrt(self.seen[2][0]))


def bags(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subwords of all rows by word (word p has buckets[edges[p]:edges[p + 1]]) and each row's first word; made a slice at a
    time, as the training rows' subwords are many times their characters."""
    parts, sizes, first = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for _, part in slices(pa.table({"text": pa.array([text for text, _ in rows], pa.string())}), most=SCORE_SLICE // 2):
        buckets, of, own = subwords(part)
        parts.append(buckets[np.argsort(of, kind="stable")])
        sizes.append(np.bincount(of, minlength=int(own[-1])))
        first.append(own[1:] + first[-1][-1])
    return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes))), np.concatenate(first)


def train(rows: list[tuple[str, int]], seed: int = 0, warm: int = 2, rounds: int = 20, batch: int = 128) -> tuple[np.ndarray, float]:
    """(text, label) rows -> a number for each bucket, and the bias."""
    if len({y for _, y in rows}) < 2:
        return np.zeros(BUCKETS), -np.inf
    draw = np.random.default_rng(seed)
    y = np.array([label for _, label in rows], float)
    buckets, edges, first = bags(rows)
    model = Model(seed)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return model.weights(), model.bias
    for epoch in range(warm):
        for ids in np.array_split(draw.permutation(full), max(1, len(full) // batch)):
            model.step([buckets[edges[first[i]] : edges[first[i + 1]]] for i in ids], y[ids], 0.1)
    for epoch in range(rounds):
        scores = np.add.reduceat(model.weights().astype(np.float32)[buckets], edges[:-1]) / np.diff(edges)
        places, doc = worst(scores, first)
        begin = np.searchsorted(doc, np.arange(len(first)))
        for ids in np.array_split(draw.permutation(full), max(1, len(full) // batch)):
            own = [np.concatenate([buckets[edges[p] : edges[p + 1]] for p in places[begin[i] : begin[i + 1]]]) for i in ids]
            model.step([b[draw.random(len(b)) >= DROP] for b in own], y[ids], 0.1)
    return model.weights(), model.bias


def scores_of(weights: np.ndarray, bias: float, part: Texts) -> np.ndarray:
    """The probability that each text is toxic; 0 for those without words."""
    buckets, of, first = subwords(part)
    total, size = np.bincount(of, weights[buckets], int(first[-1])), np.bincount(of, minlength=int(first[-1]))
    places, doc = worst(total / np.maximum(size, 1), first)
    n = len(part)
    mean = np.bincount(doc, total[places], n) / np.maximum(np.bincount(doc, size[places], n), 1)
    return 1 / (1 + np.exp(-np.clip(mean + bias, -700, 700))) * ((np.diff(first) > 0) & (bias > -np.inf))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int) -> list[tuple[str, int]]:
    """At most ROWS rows and CHARS characters for each label, in the order of the ids' hashes."""
    rows, room = [], {0: CHARS, 1: CHARS}
    for row in sample(docs, labels, column, folds, held, ROWS).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        if room[row.label] >= len(row.text):
            room[row.label] -= len(row.text)
            rows.append((row.text, row.label))
    return rows


def scorer(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = FOLDS, held: int = HELD) -> Column:
    """A column over docs.text: the probability that a text is toxic."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, labels, column, folds, held)))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = model.value
        for batch in batches:
            out = [scores_of(weights, bias, part) for _, part in slices(pa.table({"text": batch}), most=SCORE_SLICE)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return score(docs["text"])


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score below the threshold, in all their columns."""
    return docs.where(scorer(docs, labels) < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), scorer(docs, labels).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
