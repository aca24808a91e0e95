"""Near copies by the Jaccard similarity of five-word shingles: 0.8 or more, checked exactly.

Candidates come from two sides. Operator 7's anchors link SimHash fingerprints of the shingle sets that differ in at most
four bits; at a similarity of 0.8 that is one pair in thirty, and one in two at 0.95, as fingerprints of 64 bits are too
coarse for more. So that no pair is lost, min-hashes in 40 bands of 4 find the others: two texts share a band with
probability J^4, so a pair at 0.8 is met by no band in 7 of 10^10 cases. Equal shingle sets are one node. A bucket (the nodes of one
band value) first gives a chain, one pair for each of its nodes but the first; the pairs that pass the exact check are
joined to components, and then every pair of a bucket whose nodes lie in different components is checked too, inside the
bucket's task (large buckets: a task for every two blocks of their nodes), which yields only links. So no pair of a bucket
that could still join two groups is left out, and pairs never become rows.

Edge cases as in simhash.py: words are runs of bytes other than ASCII white space, A-Z in lower case; null, empty and
white-space texts have the empty set and are equal; under five words the whole sequence is the one shingle; a null doc_id
does not name a component unless all of its component is null; repeated rows stay. Shingles are compared as 64-bit hashes,
rows as 64-bit hashes of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..shared import saved
from . import simhash
from .common import partitions, small, texts
from .text import LOWER, WORD_BASE, Texts, flat, mix, slices, spread, windows

SHINGLE, BANDS, ROWS = 5, 40, 4
#: Nodes of a bucket that meet in one task are at most about two blocks, and so many are compared with one at once.
BLOCK, STRIP = 2048, 4096
SLICE = 1_000_000
#: The least similarity, as a fraction of whole numbers.
NEAR = (4, 5)
#: Of the min-hashes (fixed values): what a shingle's hash is joined with by xor, and the odd multiplier.
SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * WORD_BASE)
FACTORS = mix(SALTS) | np.uint64(1)


def shingles(batch: Texts, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending in each document, and each document's first one (n + 1)."""
    low = Texts(LOWER[batch.data], batch.offsets)
    starts, ends, first = low.words()
    words, counts = low.hashes(starts, ends), np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(first[:-1], n) + spread(n)
    hashes = mix(windows(words, WORD_BASE, at, np.minimum(at + width, np.repeat(first[1:], n)))) if len(at) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def bands(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The band values of documents that all have a shingle."""
    out = np.zeros((len(first) - 1, BANDS), np.uint64)
    for i, (salt, factor) in enumerate(zip(SALTS, FACTORS)):
        least = np.minimum.reduceat((hashes ^ salt) * factor, first[:-1])
        out[:, i // ROWS] = mix(out[:, i // ROWS] + least + salt)
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, own in slices(batch, most=SLICE):
            hashes, first = shingles(own)
            size = np.diff(first)
            node, kept, prints = np.zeros(len(size), np.uint64), np.flatnonzero(size), simhash.majority(hashes, size)
            if len(kept):
                begin = np.append(first[kept], len(hashes))
                node[kept] = mix(np.add.reduceat(mix(hashes), begin[:-1]) + size[kept].astype(np.uint64))
                values = bands(hashes, begin).view(np.int64).reshape(-1)
            else:
                values = np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((size > 0) * BANDS)), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(node.view(np.int64)), pa.array(prints.view(np.int64)), lists], ["doc_id", "key", "node", "fp", "bands"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: each node of a bucket with the one before it."""
    key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key, node = np.append(key[-1:], batch.column("key").to_numpy()), np.append(node[-1:], batch.column("node").to_numpy())
        same = np.flatnonzero(key[1:] == key[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[same]), pa.array(node[same]), pa.array(node[same + 1])], ["key", "a", "b"])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, own in slices(batch, "text_a", SLICE):
            x, first_x = shingles(own)
            y, first_y = shingles(flat(part.column("text_b")))
            common = np.array([len(np.intersect1d(x[first_x[i] : first_x[i + 1]], y[first_y[i] : first_y[i + 1]], True)) for i in range(part.num_rows)], np.int64)
            near = NEAR[1] * common >= NEAR[0] * (np.diff(first_x) + np.diff(first_y) - common)
            yield part.select(["a", "b"]).filter(pa.array(near))


def _bucket(root: np.ndarray, texts_of: pa.Array, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links (as places) that join all of a bucket that near copies join; only left with right, where roots differ."""
    x, first = shingles(flat(texts_of))
    ids, size = np.unique(x, return_inverse=True)[1], np.diff(first)
    root, links, marked = np.unique(root, return_inverse=True)[1], [], np.zeros(len(x) + 1, bool)
    for i in np.flatnonzero(left).tolist():
        other = np.flatnonzero(right & (root != root[i]) & (NEAR[1] * np.minimum(size, size[i]) >= NEAR[0] * np.maximum(size, size[i])) & (size > 0))
        for k in range(0, len(other), STRIP):
            part = other[k : k + STRIP]
            part = part[root[part] != root[i]]
            if not len(part):
                continue
            marked[ids[first[i] : first[i + 1]]] = True
            places = np.repeat(first[part], size[part]) + spread(size[part])
            common = np.add.reduceat(marked[ids[places]], np.cumsum(size[part]) - size[part], dtype=np.int64)
            marked[ids[first[i] : first[i + 1]]] = False
            for j in part[NEAR[1] * common >= NEAR[0] * (size[i] + size[part] - common)].tolist():
                if root[i] != root[j]:
                    links.append((i, j))
                    root[root == root[j]] = root[i]
    return links


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, i and j; a group may begin in one batch and end in a later one."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        key, i, j, block, node, root = (rows[c].to_numpy() for c in ("key", "i", "j", "block", "node", "root"))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        found = []
        for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(key)).tolist()):
            own = slice(lo, hi)
            found += [(node[lo + a], node[lo + b]) for a, b in _bucket(root[own], rows["text"].slice(lo, hi - lo), block[own] == i[own], block[own] == j[own])]
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
        if not len(key):
            continue
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        same = not held or all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in ("key", "i", "j"))
        last = int(cuts[-1]) if len(cuts) else 0
        if not last and same:
            held.append(batch)
            continue
        yield links(pa.Table.from_batches([*held, batch.slice(0, last)]))
        held = [batch.slice(last)]
    if held:
        yield links(pa.Table.from_batches(held))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key of both."""
    return texts(docs).withColumn("key", F.xxhash64("doc_id", "text"))


def with_texts(nodes: DataFrame, own: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """node and text, one row for each of the given nodes."""
    one = saved(own.join(nodes.distinct(), "node").groupBy("node").agg(F.min("key").alias("key")), f"{name}-keys")
    return saved(keyed(docs).join(small(one), "key").select("node", "text").dropDuplicates(["node"]), name)


def checked(pairs: DataFrame, own: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) whose texts are as similar as NEAR."""
    held = with_texts(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), own, docs, "chain-texts")
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return saved(both.select("a", "b", "text_a", "text_b").mapInArrow(_check, "a long, b long"), "near")


def unmet(chain: DataFrame, roots: DataFrame, own: DataFrame, docs: DataFrame) -> DataFrame:
    """The links that are left in the buckets of three or more nodes (the chain has all pairs of smaller ones)."""
    spark = own.sparkSession
    members = chain.select("key", F.col("a").alias("node")).union(chain.select("key", F.col("b").alias("node"))).distinct().join(roots.select("node", "root"), "node")
    open_keys = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2")
    members = saved(members.join(open_keys.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "key"), "members")
    block = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = block.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")
    dealt = dealt.join(with_texts(members.select("node"), own, docs, "member-texts"), "node").select("key", "i", "j", "block", "node", "root", "text")
    dealt = dealt.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return saved(dealt.mapInArrow(_rest, "a long, b long"), "near-rest")


def linked(own: DataFrame) -> DataFrame:
    """Pairs of nodes (a, b) that operator 7 links: those of one fingerprint with the least of them, and those with the
    least nodes of linked fingerprints."""
    nodes = saved(own.select("node", "fp").distinct(), "fingerprints")
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    ends = (least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_node")) for x in "ab")
    a, b = ends
    pairs = simhash.links(least).distinct().join(a, "a").join(b, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return same.union(pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def mark(docs: DataFrame) -> DataFrame:
    """doc_id and component_id: the least doc_id reachable over near copies."""
    spark = docs.sparkSession
    own = saved(keyed(docs).mapInArrow(_nodes, "doc_id long, key long, node long, fp long, bands array<long>"), "shingled")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"))
    buckets = own.dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    chain = saved(buckets.repartition(partitions(spark), "key").sortWithinPartitions("key", "node").mapInArrow(_chain, "key long, a long, b long"), "chain")
    pairs = saved(chain.select("a", "b").union(linked(own)).distinct(), "pairs")
    edges = checked(pairs, own, docs)
    state = lambda e: saved(nodes.join(components(e), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "state")
    now = state(edges)
    more = unmet(chain, now, own, docs)
    if more.take(1):
        now = state(edges.union(more))
    names = now.join(now.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return own.select("doc_id", "node").join(names, "node").select("doc_id", "component_id")
