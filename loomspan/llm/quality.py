"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Every token bucket has a sparse ternary index vector; a token's word vector is the sum of the index vectors of its
neighbours (two on either side) over the whole corpus, summed per task and then in Spark, in a table of fixed size. A
document is pooled to the means of its tokens' vectors, of their squares and of the absolute differences of neighbouring
tokens' vectors (repetition shows there), and its length. A tanh layer and a softmax are trained on at most ROWS labelled
ids; the temperature that calibrates the probabilities is fitted on a fifth of them that training does not see.

Edge cases: a null or empty text pools to zeros and is scored like any other; a null doc_id is in no labelled row and not
held out; repeated rows are scored each; without labelled rows of both kinds every score is the share of label 1, or 0.5;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table, texts
from .labelled import sample
from .text import LOWER, Texts, mix, slices

FOLDS, HELD, THRESHOLD = 5, 0, 0.3
ROWS = 12_000
BUCKETS, DIM, REACH = 1 << 14, 32, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 128, 3e-3, 1e-4
#: Rows of the vector table that travel together when the tasks' sums are added.
BLOCK = 256
#: 0: white space and control, 1: letters, digits and all bytes outside ASCII, 2: the rest.
CLASS = np.array([0 if i <= 32 or i == 127 else 1 if i >= 128 or chr(i).isalnum() else 2 for i in range(256)], np.uint8)
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
SLICE = 1_000_000


def tokens(batch: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token (a run of one class; words in lower case, with their case pattern), and each text's first."""
    n = len(batch.data)
    kind = CLASS[batch.data]
    edge = np.zeros(n + 1, bool)
    edge[batch.offsets] = True
    if n:
        edge[1:n] |= kind[1:] != kind[:-1]
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = kind[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    capitals = np.append(0, np.cumsum(UPPER[batch.data], dtype=np.int64))
    upper = capitals[ends] - capitals[starts]
    pattern = np.where(upper == 0, 0, np.where(upper < ends - starts, 1, 2)).astype(np.uint64)
    hashes = mix(Texts(LOWER[batch.data], batch.offsets).hashes(starts, ends) + pattern)
    return (hashes >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64), np.searchsorted(starts, batch.offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs of every bucket's ternary index vector."""
    h = mix(np.arange(2 * BUCKETS, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, 2)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIM, np.int64)
    for batch in batches:
        for _, part in slices(batch, most=SLICE):
            own, first = tokens(part)
            doc = np.repeat(np.arange(len(part)), np.diff(first))
            for reach in range(1, REACH + 1):
                near = np.flatnonzero(doc[reach:] == doc[:-reach])
                for a, b in ((near, near + reach), (near + reach, near)):
                    for k in range(2):
                        at, sign = own[a] * DIM + places[own[b], k], signs[own[b], k]
                        total += np.bincount(at[sign > 0], minlength=len(total)) - np.bincount(at[sign < 0], minlength=len(total))
    rows = total.reshape(-1, BLOCK * DIM)
    some = np.flatnonzero(rows.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([rows[i].astype("<i8").tobytes() for i in some], pa.binary())], ["block", "sums"])


def _add(rows: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK * DIM, np.int64)
    for x in rows["sums"].combine_chunks():
        total += np.frombuffer(x.as_buffer(), "<i8")
    return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int64()), "sums": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors by bucket, from the contexts of the whole corpus. The table has BUCKETS x DIM numbers at any size."""
    sums = texts(docs).select("text").mapInArrow(_sums, "block long, sums binary").groupBy("block").applyInArrow(_add, "block long, sums binary")
    vectors = np.zeros((BUCKETS // BLOCK, BLOCK * DIM))
    for row in sums.collect():
        vectors[row.block] = np.frombuffer(row.sums, "<i8")
    vectors = vectors.reshape(BUCKETS, DIM)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, batch: Texts) -> np.ndarray:
    """Of each text: mean vector, mean square, mean absolute difference of neighbours, log of the number of tokens."""
    own, first = tokens(batch)
    out = np.zeros((len(batch), 3 * DIM + 1))
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    if len(full):
        seen = vectors[own]
        step = np.abs(np.diff(seen, axis=0, append=seen[-1:]))
        step[first[1:][full] - 1] = 0
        for i, values in enumerate((seen, seen * seen, step)):
            out[full, i * DIM : (i + 1) * DIM] = np.add.reduceat(values, first[:-1][full], axis=0) / counts[full, None]
    out[:, -1] = np.log1p(counts)
    return out


class Network:
    """tanh layer and softmax of two classes over standardised inputs, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fit: np.ndarray, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.layers = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, (HIDDEN, 2)), np.zeros(2)]
        self.temperature = 1.0
        x = (x - self.mean) / self.scale
        moments, turn = [[np.zeros_like(p), np.zeros_like(p)] for p in self.layers], 0
        for _ in range(EPOCHS):
            for ids in np.array_split(draw.permutation(np.flatnonzero(fit)), max(1, fit.sum() // BATCH)):
                hidden, chance = self._forward(x[ids])
                error = (chance - np.eye(2)[y[ids]]) / len(ids)
                back = error @ self.layers[2].T * (1 - hidden**2)
                turn += 1
                for p, (m, v), g in zip(self.layers, moments, (x[ids].T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**turn) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8) + DECAY * p)
        rest = ~fit if (~fit).any() else fit
        logits = np.tanh(x[rest] @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]
        line = logits[:, 1] - logits[:, 0]
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(y[rest] == 1, -line, line) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.layers[0] + self.layers[1])
        logits = (hidden @ self.layers[2] + self.layers[3]) / self.temperature
        logits -= logits.max(1, keepdims=True)
        chance = np.exp(logits)
        return hidden, chance / chance.sum(1, keepdims=True)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale)[1][:, 1]


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def scorer(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = FOLDS, held: int = HELD) -> Column:
    """A column over docs.text: the calibrated probability of label 1."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in slices(batch, most=SLICE):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array([x.tobytes() for x in pooled(vectors.value, part)], pa.binary())], ["doc_id", "label", "pooled"])

    rows = sample(docs, labels, column, folds, held, ROWS).mapInArrow(pool, "doc_id long, label int, pooled binary").collect()  # ROWS rows of fixed width
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.label for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        trained: Network | Constant = Constant(float(y.mean()) if len(y) else 0.5)
    else:
        fit = mix(np.array([r.doc_id for r in rows], np.int64).astype(np.uint64)) % np.uint64(5) != 0
        trained = Network(np.stack([np.frombuffer(r.pooled) for r in rows]), y, fit if len(set(y[fit].tolist())) == 2 else np.ones(len(y), bool))
    model = context.broadcast(trained)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [model.value.score(pooled(vectors.value, part)) for _, part in slices(pa.table({"text": batch}), most=SLICE)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return score(docs["text"])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), scorer(docs, labels).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
