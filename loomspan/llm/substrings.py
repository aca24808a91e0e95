"""Substring deduplication: Rabin-Karp hashes of every window of 35 words, counted in Spark.

Documents are dealt into chunks. Each chunk hashes its windows and sends every distinct one once to the shard of its hash
(a map-side combine: a passage that a third of all documents share is one entry per chunk), sorted and packed. A shard finds
the entries that more than one chunk sent and answers each chunk with one bit per entry. The chunk hashes its texts again,
marks the windows that repeat in it or elsewhere, and merges them into maximal removal intervals. The texts cross the
network once (both passes read the same exchange); a window costs about 11 bytes, an answer one bit.

A window is known by two Rabin-Karp hashes over two independent hashes of its words: 64 bits modulo 2^64, and 24 of 31 bits
modulo a prime. 10^13 different windows (some 100 TB) have 0.2 equal pairs among them in expectation.

Chunks and shards are as many as the data need for tasks of bounded size (CHUNK_BYTES, SHARD_BYTES of text). Rows are dealt
by their place in the input, so that equal rows and rows with one id are spread as well; the place of a row of a stored
table does not change when a task is run again.

Edge cases: a null or empty text has no words and its kept text is empty; texts under 35 words have no windows and stay
whole; repeated rows (same id or not) count as other places and so repeat each other; a null id is a row like any other;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, texts
from .text import WORD_BASE, Texts, flat, mix, prime_windows, windows

WINDOW = 35
CHUNK_BYTES, SHARD_BYTES = 32_000_000, 128_000_000
#: Chunks and shards for each shuffle partition, at least.
CHUNKS, SHARDS = 4, 1


def window_hashes(batch: Texts, width: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word index at which each window starts, and the windows' two hashes (64 and 24 bits)."""
    starts, ends, first = batch.words()
    counts = np.diff(first)
    own = np.repeat(counts, counts)
    place = np.arange(len(starts)) - np.repeat(first[:-1], counts)
    at = np.flatnonzero(place + width <= own)
    if not len(at):
        return (starts, ends, first), at, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    hashes = mix(windows(batch.hashes(starts, ends), WORD_BASE, at, at + width))
    checks = prime_windows(batch.hashes(starts, ends, 1), at, at + width).astype(np.uint32) & np.uint32((1 << 24) - 1)
    return (starts, ends, first), at, hashes, checks


def in_order(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pairs, and for each place in it whether it begins a new pair."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    same = h[1:] == h[:-1]
    if (same & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, hashes))
        h, c = hashes[order], checks[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return order, new


def packed(checks: np.ndarray) -> bytes:
    """Three bytes each."""
    return checks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 3, 4), np.uint8)
    wide[:, :3] = raw.reshape(-1, 3)
    return wide.view("<u4").reshape(-1)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Sorted hashes have ascending shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _in_order(chunk: pa.Table) -> pa.Table:
    """Rows in an order that does not depend on how they arrived."""
    return chunk.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _emit(width: int, shards: int) -> Callable[[pa.Table], pa.Table]:
    def emit(chunk: pa.Table) -> pa.Table:
        _, _, hashes, checks = window_hashes(flat(chunk["text"]), width)
        order, new = in_order(hashes, checks)
        hashes, checks = hashes[order[new]], checks[order[new]]
        shard = shard_of(hashes, shards)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        ends = np.append(cuts[1:], len(hashes))
        return pa.table({"chunk": pa.array(np.full(len(cuts), chunk["chunk"][0].as_py()), pa.int64()), "shard": pa.array(shard[cuts], pa.int64()),
                         "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()), "checks": pa.array([packed(checks[a:b]) for a, b in zip(cuts, ends)], pa.binary())})

    return emit


def _repeated(rows: pa.Table) -> pa.Table:
    """One bit for each entry of each chunk: whether another chunk sent it too."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["hashes"].combine_chunks()]
    checks = np.concatenate([unpacked(np.frombuffer(x.as_buffer(), np.uint8)) for x in rows["checks"].combine_chunks()])
    order, new = in_order(np.concatenate(parts), checks)
    again = ~new
    again[:-1] |= ~new[1:]
    found = np.zeros(len(order), bool)
    found[order] = again
    bits = [np.packbits(x).tobytes() for x in np.split(found, np.cumsum([len(p) for p in parts])[:-1])]
    return pa.table({"chunk": rows["chunk"], "shard": rows["shard"], "bits": pa.array(bits, pa.binary())})


def _cut(width: int, shards: int, keep_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cut(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _in_order(chunk)
        batch = flat(chunk["text"])
        (starts, ends, first), at, hashes, checks = window_hashes(batch, width)
        order, new = in_order(hashes, checks)
        number = np.cumsum(new) - 1
        repeated = np.bincount(number) > 1 if len(number) else np.zeros(0, bool)
        if len(order):
            answers = answers.sort_by("shard")
            sizes = np.unique(shard_of(hashes[order[new]], shards), return_counts=True)[1]
            if len(sizes) != answers.num_rows:
                raise RuntimeError("the answers do not match the windows of this chunk")
            elsewhere = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip(answers["bits"].combine_chunks(), sizes.tolist())]
            repeated |= np.concatenate(elsewhere).astype(bool)
        hit = at[order[repeated[number]]]
        change = np.zeros(len(starts) + 1, np.int32)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + width, -1)
        gone = np.cumsum(change)[:-1] > 0
        raw, out = batch.data.tobytes(), {"n_removed": [], "kept_sha256": [], "kept": [], "intervals": []}
        a, b = starts.tolist(), ends.tolist()
        for i in range(len(batch)):
            lo, hi = first[i], first[i + 1]
            kept = b" ".join([raw[a[k] : b[k]] for k in (np.flatnonzero(~gone[lo:hi]) + lo).tolist()])
            out["n_removed"].append(int(gone[lo:hi].sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                edges = np.flatnonzero(np.diff(np.r_[0, gone[lo:hi].astype(np.int8), 0]))
                out["kept"].append(kept.decode())
                out["intervals"].append([{"first_word": int(x), "end_word": int(y)} for x, y in zip(edges[::2], edges[1::2])])
        made = {"doc_id": chunk["doc_id"], "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        if keep_text:
            made |= {"kept": pa.array(out["kept"], pa.string()), "intervals": pa.array(out["intervals"], pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())])))}
        return pa.table(made)

    return cut


def remove_repeats(docs: DataFrame, width: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text and the removed word intervals."""
    n, own = partitions(docs.sparkSession), texts(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, shards = max(CHUNKS * n, -(-size // CHUNK_BYTES)), max(SHARDS * n, -(-size // SHARD_BYTES))
    dealt = own.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)))
    sent = dealt.groupBy("chunk").applyInArrow(_emit(width, shards), "chunk long, shard long, hashes binary, checks binary")
    answers = sent.groupBy("shard").applyInArrow(_repeated, "chunk long, shard long, bits binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, intervals array<struct<first_word: long, end_word: long>>" * keep_text
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(width, shards, keep_text), schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


#: The same rows by grouping the windows' texts.
OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT rid, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35
), s AS (
  SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM p
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS n FROM s) WHERE n > 1
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 35)) AS i FROM r
), words AS (
  SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT words.rid, string_agg(x, ' ' ORDER BY words.i) AS t, count(*) AS n FROM words ANTI JOIN gone ON gone.rid = words.rid AND gone.i = words.i GROUP BY words.rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
