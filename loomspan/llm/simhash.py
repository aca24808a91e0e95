"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into blocks of 23, 23 and 18 bits. If two fingerprints differ in at most 4 bits, then they
differ in at most 1 bit of the first block, or in at most 1 bit of the second, or in none of the third: otherwise they
would differ in at least 2 + 2 + 1 bits. In each block the anchors are the 4,096 words of the perfect binary Golay code,
whose covering radius is 3: every block value has exactly one anchor within 3 bits. Each fingerprint is replicated to all
anchors within radius + threshold (3 + 1, 3 + 1, 3 + 0) of its block, about 5.3 + 5.3 + 1 of them, so a pair that agrees
in a block meets at the anchor nearest to either. Distinct fingerprints are compared per anchor; an anchor's links leave it
as stars (one row per linked fingerprint, never all pairs), and the stars are joined to components in Spark.

Edge cases: null, empty and white-space texts have fingerprint zero, linked like any other; under four words the whole
sequence is the one shingle; equal fingerprints are one node, whatever the number of documents; a null doc_id keeps its
fingerprint and does not name a component unless all of its component is null; repeated rows stay; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..shared import saved
from .common import partitions, small, table, texts
from .text import LOWER, SPACE, Texts, slices, spread

SHINGLE, SEED, BITS = 4, 42, 4
STRIP = 1 << 18
#: First bit, width and threshold of each block (fixed by the argument above).
BLOCKS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011
RADIUS = 3
#: Buckets above this size are compared piece by piece.
DIRECT = 512
PIECES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def shingle_hashes(batch: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each document's shingles, and how many each document has (one, if it has under `width` words)."""
    low = Texts(LOWER[batch.data], batch.offsets)
    starts, ends, first = low.words()
    keep = ~SPACE[low.data]
    inner = ends[ends < len(low.data)]
    keep[inner] = True
    data = np.where(SPACE[low.data], np.uint8(0x20), low.data)
    moved = np.cumsum(keep) - 1
    raw = data[keep].tobytes()
    starts, ends = moved[starts], moved[ends - 1] + 1 if len(ends) else ends
    counts = np.diff(first)
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    own = np.repeat(first[:-1], shingles) + spread(shingles)
    last = np.minimum(own + width, np.repeat(first[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(raw[a:b], SEED) for a, b in zip(starts[own].tolist(), ends[last].tolist())], np.uint64), shingles


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each document, the bits that are set in over half its hashes."""
    ones = np.zeros((len(counts) + 1, 64), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    for i in range(0, len(hashes), STRIP):
        part, who = hashes[i : i + STRIP], doc[i : i + STRIP]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.diff(who, prepend=-1))
        np.add.at(ones, who[cuts], np.add.reduceat(bits, cuts, axis=0, dtype=np.int32))
    set_bits = 2 * ones[:-1] > np.asarray(counts)[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def _fingerprints(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch):
                prints = majority(*shingle_hashes(words, width))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""
    return texts(docs).mapInArrow(_fingerprints(width), "doc_id long, fp long")


def syndrome(values: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit value modulo the generator polynomial; a code word has remainder 0."""
    rest = values.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=2)
def patterns(within: int) -> tuple[np.ndarray, np.ndarray]:
    """All error patterns of so many bits or fewer, ordered by syndrome, and where each of the 2^11 syndromes begins."""
    light = np.array([sum(1 << b for b in bits) for n in range(within + 1) for bits in combinations(range(23), n)])
    of = syndrome(light)
    order = np.argsort(of, kind="stable")
    return light[order], np.searchsorted(of[order], np.arange((1 << 11) + 1))


def anchors(values: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and anchor for every anchor within so many bits of each 23-bit value."""
    light, first = patterns(within)
    own = syndrome(values)
    counts = first[own + 1] - first[own]
    row = np.repeat(np.arange(len(values)), counts)
    return row, values[row] ^ light[first[own[row]] + spread(counts)]


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, STRIP):
            signed = batch.column("fp").slice(i, STRIP).to_numpy(zero_copy_only=False)
            prints = signed.view(np.uint64)
            for block, (low, width, near) in enumerate(BLOCKS):
                values = (prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
                row, anchor = anchors(values, RADIUS + near)
                yield pa.RecordBatch.from_arrays([pa.array(anchor * len(BLOCKS) + block), pa.array(signed[row])], ["anchor", "fp"])


def forest(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join what links of `most` bits or fewer join, at most one for each fingerprint (in small groups: all
    links). A fingerprint that has been reached is not compared again, so a dense group takes a few passes."""
    if len(prints) <= DIRECT:
        a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= most)
        return a[a < b], b[a < b]
    left, reached, by = np.arange(len(prints)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[i]) <= most
            if near.any():
                reached.append(left[near])
                by.append(np.full(len(reached[-1]), i))
                queue += reached[-1].tolist()
                left = left[~near]
    return np.concatenate(reached), np.concatenate(by)


def near_pairs(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join what links of `most` bits (at most 4) join. In large buckets only fingerprints that share one
    of five pieces are compared: two that differ in four bits share one."""
    if len(prints) <= DIRECT or most >= len(PIECES):
        return forest(prints, most)
    found = [(np.zeros(0, np.int64),) * 2]
    for low, width in PIECES:
        piece = prints >> np.uint64(low) & np.uint64((1 << width) - 1)
        order = np.argsort(piece, kind="stable")
        cuts = np.flatnonzero(np.diff(piece[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                a, b = forest(prints[group], most)
                found.append((group[a], group[b]))
    return tuple(map(np.concatenate, zip(*found)))


def stars(prints: np.ndarray, most: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint of a bucket and the least one of its component in the bucket."""
    prints = np.sort(prints)  # ascending as unsigned; roots are least indices
    a, b = near_pairs(prints, most)
    root = np.arange(len(prints))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(root)))
    return prints[moved], prints[root[moved]]


def _compare(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by anchor; a bucket may begin in one batch and end in a later one."""

    def edges(anchor: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        pairs = [stars(x, most) for x in np.split(prints, cuts) if len(x) > 1]
        a, b = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (zip(*pairs) if pairs else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, prints = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            last = int(np.searchsorted(anchor, anchor[-1]))
            if last == 0 and (not held or held[-1][0][-1] == anchor[0]):
                held.append((anchor, prints))
                continue
            held.append((anchor[:last], prints[:last]))
            yield edges(*map(np.concatenate, zip(*held)))
            held = [(anchor[last:], prints[last:])]
        if held:
            yield edges(*map(np.concatenate, zip(*held)))

    return run


def links(prints: DataFrame, most: int = BITS) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b): pairs that join what links of `most` (at most 4) bits join."""
    if most > BITS:
        raise ValueError("the blocks above cover links of four bits or fewer")
    buckets = prints.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    buckets = buckets.repartition(partitions(prints.sparkSession), "anchor").sortWithinPartitions("anchor")
    return buckets.mapInArrow(_compare(most), "a long, b long")


def near_duplicates(prints: DataFrame, most: int = BITS) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id): the least doc_id reachable over links of `most` (at most 4) bits or fewer."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes, most))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = saved(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.where("root <> fp").join(least, "root").select("fp", "component_id").union(
        named.where("root = fp").join(least, "root").select("fp", "component_id"))
    return prints.join(names, "fp", "left").select("doc_id", "fp", "component_id")


def mark(docs: DataFrame, width: int = SHINGLE, most: int = BITS) -> DataFrame:
    return near_duplicates(saved(fingerprints(docs, width), "fingerprints"), most)


def keep_one(docs: DataFrame, marks: Callable[[DataFrame], DataFrame] = mark) -> DataFrame:
    """One document of each component that `marks` finds (doc_id and component_id for rows of doc_id and text), the one with
    the least id (null ids come last, and of rows with one id the least hash of a text first), in all its columns.

    Rows are told apart by a hash of id and text, as under one id, or none, may stand different texts. Of rows equal in both
    one stays, whichever it is.
    """
    row = next(x for x in (f"row_{i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    marked = marks(keyed.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id").distinct()
    first = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), row)
    own = marked.join(keyed.select(row, first.alias("first")), row)
    own = saved(own, "marked")
    kept = own.groupBy("component_id").agg(F.min("first").alias("first")).select(F.col(f"first.{row}").alias(row))
    gone = saved(own.select(row).join(kept, row, "left_anti").distinct(), "gone")
    out = keyed.join(small(gone), row, "left_anti")
    twice = saved(keyed.groupBy(row).count().where("count > 1").select(row).join(small(gone), row, "left_anti"), "twice")
    if twice.take(1):  # else the texts need not meet their equals
        twice = small(twice)
        out = out.join(twice, row, "left_anti").unionByName(out.join(twice, row, "left_semi").dropDuplicates([row]))
    return out.select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
