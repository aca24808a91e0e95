"""Neighbours within a distance: exact by a table of distances to pivots, or approximate by random projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..shared import saved
from .features import numbered

#: Vectors of a block; two blocks meet in a task, which compares STRIP of one with all of the other at a time.
BLOCK, STRIP = 4096, 512
#: Vectors of the other block that a strip meets at a time, pairs whose distances are worked out at a time, and pairs that
#: strips give together.
ACROSS, CHUNK, TOGETHER = 1 << 14, 1 << 13, 1 << 17
#: Pivots, and vectors among which they are looked for. They decide how much is left out, never what is found.
PIVOTS, SAMPLE = 6, 512
CELLS = 3  #: pivots by which vectors are brought into blocks


def _rows(vectors: DataFrame, key: str) -> DataFrame | None:
    """k and v of the vectors as long as the least key's, without null ones and null components; None if there is none. Floats
    stay floats, as doubles are twice the bytes in all that is dealt and written."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    v = vectors.select(F.col(key).cast("long").alias("k"), F.col("embedding").cast("array<float>" if kind == "float" else "array<double>").alias("v"))
    v = v.where("k is not null and v is not null and not exists(v, x -> x is null or isnan(x))")
    first = v.agg(F.min_by(F.size("v"), "k").alias("d")).first()["d"]
    return None if first is None else v.where(F.size("v") == first)


def pivots(v: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other, of a sample of SAMPLE by a hash of the key: each the farthest from those before it."""
    x = np.array([r["v"] for r in v.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).select("v").collect()])
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < most and far.max(initial=0) > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def pivot_table(v: DataFrame, at: np.ndarray) -> DataFrame:
    """k, v and t, the distances to each pivot."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            t = np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in at], 1) if batch.num_rows else np.zeros((0, len(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(t.ravel()), len(at)).cast(pa.list_(pa.float64()))], ["k", "v", "t"])

    return v.mapInArrow(measure, f"k long, v {v.schema['v'].dataType.simpleString()}, t array<double>")


def blocks(table: DataFrame, eps: float, size: int | None = None) -> DataFrame:
    """The pivot table with a block number: vectors in the order of their cells of width eps, `size` (BLOCK, if not given) at a time."""
    width = eps if eps > 0 else 1.0
    cells = [F.floor(F.get("t", F.lit(i)) / width).alias(f"c{i}") for i in range(CELLS)]
    rows = numbered(table.withColumn("place", F.struct(*cells, F.get("t", F.lit(0)).alias("t0"), "k")), "place")
    return saved(rows.select("k", "v", "t", F.floor(F.col("row_no") / (size or BLOCK)).alias("block")), "blocks")


def meetings(own: DataFrame, eps: float, many: int) -> DataFrame:
    """(i, j) of blocks, i <= j, whose distances to every pivot come within eps of each other.

    By the triangle inequality others hold no neighbours. It is a range join of the blocks' boxes: they meet on bins of their
    first range, and their other ranges are compared.
    """
    near = eps * (1 + 1e-9) + 1e-9
    boxes = own.groupBy("block").agg(*(f(F.get("t", F.lit(i))).alias(f"{name}{i}") for i in range(many) for f, name in ((F.min, "lo"), (F.max, "hi"))))
    boxes = saved(boxes, "boxes")
    reach = boxes.agg(F.count(F.lit(1)).alias("n"), F.min("lo0").alias("lo"), F.max("hi0").alias("hi")).first()
    width = max(near, (reach["hi"] - reach["lo"]) / max(1, reach["n"])) if reach["n"] else 1.0
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    left = boxes.withColumn("bin", bins(F.col("lo0") - near, F.col("hi0") + near)).withColumnsRenamed({c: f"i_{c}" for c in boxes.columns})
    right = boxes.withColumn("bin", bins(F.col("lo0"), F.col("hi0"))).withColumnsRenamed({c: f"j_{c}" for c in boxes.columns})
    close = F.lit(True)
    for i in range(many):
        close = close & (F.col(f"i_lo{i}") - F.col(f"j_hi{i}") <= near) & (F.col(f"j_lo{i}") - F.col(f"i_hi{i}") <= near)
    met = left.join(right, "bin").where((F.col("i_block") <= F.col("j_block")) & close)
    return met.select(F.col("i_block").alias("i"), F.col("j_block").alias("j")).distinct()


def met_blocks(v: DataFrame, eps: float, size: int) -> tuple[DataFrame, DataFrame]:
    """Vectors (k, v) with a block number, up to `size` in each, and (block, i, j) for both blocks of each two that meet."""
    if v.count() <= size:
        return v.withColumn("block", F.lit(0).cast("long")), v.sparkSession.createDataFrame([(0, 0, 0)], "block long, i long, j long")
    at = pivots(v)
    own = blocks(pivot_table(v, at), eps, size)
    return own.select("k", "v", "block"), meetings(own, eps, len(at)).select(F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")


def near_in(rows: pa.Table, eps: float, strip: int = STRIP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Two blocks that meet -> places p and q and distance d of the pairs within eps, each pair once, some strips at a time.

    Single precision leaves out what is farther by more than its error; the distances of the rest are worked out in double.
    """
    block, ids = rows["block"].to_numpy(), rows["k"].to_numpy()
    x = rows["v"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
    left, right = (np.flatnonzero(block == rows[c][0].as_py()) for c in ("i", "j"))
    same = rows["i"][0] == rows["j"][0]
    lengths = (x * x).sum(1)
    most = lengths.max()
    single = 1e-12 <= eps * eps <= 1e12 and most <= 1e12  # no products that vanish or overflow
    kind, error = (np.float32, (x.shape[1] + 8) * 2.0**-22) if single else (np.float64, 1e-9)
    half = -lengths[:, None] / 2
    slack = -(eps * eps + error * (most + eps * eps)) / 2
    some, other = np.hstack([x[left], half[left], np.ones((len(left), 1))]).astype(kind), np.hstack([x[right], np.ones((len(right), 1)), half[right]]).astype(kind)
    parts, n = [(left[:0], right[:0], np.zeros(0))], 0
    for s in range(0, len(left), strip):
        for t in range(0, len(right), ACROSS):
            p, q = np.divmod(np.flatnonzero(some[s : s + strip] @ other[t : t + ACROSS].T >= slack), min(ACROSS, len(right) - t))
            p, q = left[s + p], right[t + q]
            keep = ids[p] < ids[q] if same else ids[p] != ids[q]
            p, q = p[keep], q[keep]
            d = np.concatenate([np.zeros(0)] + [_lengths(x, p[m : m + CHUNK], q[m : m + CHUNK]) for m in range(0, len(p), CHUNK)])
            parts.append((p[d <= eps], q[d <= eps], d[d <= eps]))
            n += len(parts[-1][0])
            if n >= TOGETHER:
                yield tuple(map(np.concatenate, zip(*parts)))
                parts, n = parts[:1], 0
    yield tuple(map(np.concatenate, zip(*parts)))


def _lengths(x: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances, summed up in the order of the dimensions."""
    return np.sqrt(sum(((x[p] - x[q]) ** 2).T, np.zeros(len(p))))


def neighbour_pairs(vectors: DataFrame, eps: float, key: str = "card_id") -> DataFrame:
    """(a, b, d) with a < b and d <= eps.

    Vectors are cut into blocks by their distances to pivots, and two blocks meet in a task only if all those distances may
    differ by eps or less. Where eps is large against the distances' spread all blocks meet, each pair of them in a task of its
    own. Vectors of another length than the least key's, or with null components, have no neighbours.
    """
    v = _rows(vectors, key)
    if v is None:
        return vectors.sparkSession.createDataFrame([], "a long, b long, d double")
    own, sides = met_blocks(v, eps, BLOCK)

    def near(rows: pa.Table) -> pa.Table:
        ids = rows["k"].to_numpy()
        parts = [(np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), d) for p, q, d in near_in(rows, eps)]
        return pa.table(dict(zip(("a", "b", "d"), map(np.concatenate, zip(*parts)))))

    return own.join(sides, "block").select("block", "k", "v", "i", "j").groupBy("i", "j").applyInArrow(near, "a long, b long, d double")


def approximate_pairs(vectors: DataFrame, eps: float, key: str = "card_id", tables: int = 8, bucket: float | None = None, seed: int = 1) -> DataFrame:
    """As neighbour_pairs, but for vectors that share a bucket (as wide as eps, if not given) of one of `tables` random
    projections only, and some pairs are missed: recall() tells how many. Buckets must be narrow against the vectors' spread, as
    all pairs of a bucket are compared; where they are not, neighbour_pairs is the cheaper one."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    v = _rows(vectors, key)
    if v is None:
        return vectors.sparkSession.createDataFrame([], "a long, b long, d double")
    rows = saved(v, "usable-vectors").select("k", array_to_vector(doubles(F.col("v"))).alias("x"))  # written, or the hashes may come before the filter
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", numHashTables=tables, bucketLength=bucket or max(eps, 1e-9), seed=seed).fit(rows)
    met = model.approxSimilarityJoin(rows, rows, float(np.nextafter(eps, np.inf)), "d").where("datasetA.k < datasetB.k and d <= " + repr(float(eps)))
    return met.select(F.col("datasetA.k").alias("a"), F.col("datasetB.k").alias("b"), "d")


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: n_exact, n_found and the share of the exact pairs that are found (1 if there is none)."""
    hit = exact.select("a", "b").join(found.select("a", "b").distinct().withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.coalesce(F.try_divide("n_found", "n_exact"), F.lit(1.0)))
