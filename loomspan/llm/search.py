"""Exact top-k inner-product search by MaxScore over shards.

Vectors are integers (floor of 256 times each component) and a query's terms are its dimensions; a dimension's posting
list in a shard is its column, with the least and greatest value as bounds. Shards of about 4,096 vectors meet blocks of
about 4,096 queries on a (shard, block) key. For each query the terms with the smallest ranges whose bounds together cannot
lift a vector to the threshold are non-essential; the essential postings are traversed for all vectors, the others are
probed, widest bound first, only for vectors that can still reach the threshold (ties included). Spark merges the shards'
best by rank.

Edge cases: vectors that are null, or hold null or non-finite components, take no part; vectors of other lengths are
padded with zeros (an empty one scores 0); rows repeated under one id are candidates each, a query meets no row of its own
id, and equal query rows are one query; a null vec_id takes no part; components so large that products leave the exact
range of doubles are computed in whole numbers, and scores beyond a long stay at its bound; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TOP, STRIDE, SHARD, WARM, PROBE = 5, 50, 4096, 128, 8
LONG = (1 << 63) - 1


def matrix(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and floor(256 x), as doubles with integer values."""
    lists = rows["embedding"].combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    values = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False))
    return rows["vec_id"].to_numpy(), np.split(values, np.cumsum(sizes)[:-1])


def padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def max_score(query: np.ndarray, own: int, postings: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of one query's k best in a shard. postings: a row for each dimension."""
    warm = query @ postings[:, :WARM]
    rivals = warm[ids[:WARM] != own]
    threshold = np.sort(rivals)[-k] if len(rivals) >= k else -np.inf
    ends = np.stack([query * low, query * high])
    upper, lower = ends.max(0), ends.min(0)
    order = np.argsort(upper - lower, kind="stable")
    free = np.cumsum((upper - lower)[order]) + lower.sum() < threshold  # what these terms add cannot reach the threshold
    essential, rest = order[~free], order[free][::-1]
    places = np.flatnonzero(ids != own)
    scores = query[essential] @ postings[essential]
    scores = scores[places]
    for i in range(0, len(rest) + 1, PROBE):
        left = rest[i:]
        alive = scores + upper[left].sum() >= threshold
        places, scores = places[alive], scores[alive]
        if len(left):
            probe = left[:PROBE]
            scores = scores + query[probe] @ postings[np.ix_(probe, places)]
        if len(left) > PROBE and len(scores) > k:
            threshold = max(threshold, np.partition(scores, -k)[-k] + lower[left[PROBE:]].sum())
    best = best_of(ids[places], scores, k)
    return places[best], scores[best]


def whole_numbers(queries: list[np.ndarray], own: np.ndarray, vectors: list[np.ndarray], ids: np.ndarray, k: int) -> list[tuple[np.ndarray, list[int]]]:
    """The same with Python's integers, for components beyond the exact range of doubles."""
    rows = [[int(x) for x in v] for v in vectors]
    out = []
    for q, name in zip(queries, own.tolist()):
        q = [int(x) for x in q]
        scored = sorted((-sum(a * b for a, b in zip(q, v)), int(i), p) for p, (v, i) in enumerate(zip(rows, ids)) if i != name)[:k]
        out.append((np.array([p for *_, p in scored], np.int64), [max(-LONG - 1, min(LONG, -s)) for s, *_ in scored]))
    return out


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "query_hash": [], "vec_id": [], "score": []}
        if candidates.num_rows and queries.num_rows:
            ids, vectors = matrix(candidates.sort_by("vec_id"))
            own, asked = matrix(queries)
            width = max(map(len, vectors + asked))
            v, q = padded(vectors, width), padded(asked, width)
            postings, low, high = np.ascontiguousarray(v.T), v.min(0, initial=np.inf), v.max(0, initial=-np.inf)
            exact = np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * max(1, width) < 2**53
            found = [max_score(x, i, postings, low, high, ids, k) for x, i in zip(q, own.tolist())] if exact else whole_numbers(asked, own, vectors, ids, k)
            for name, mark, (places, scores) in zip(own.tolist(), queries["query_hash"].to_pylist(), found):
                out["query_id"] += [name] * len(places)
                out["query_hash"] += [mark] * len(places)
                out["vec_id"] += ids[places].tolist()
                out["score"] += [int(s) for s in scores]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in out.items()})

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query with all rows but its own."""
    def usable(df: DataFrame) -> DataFrame:
        own = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return own.where(F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))

    vectors, queries = usable(vectors), usable(queries).dropDuplicates(["vec_id", "embedding"])
    shards, blocks = (max(1, -(-df.count() // SHARD)) for df in (vectors, queries))
    deal, zero = F.xxhash64("vec_id", "embedding"), F.lit(0).cast("long")
    dealt = vectors.withColumn("shard", F.pmod(deal, F.lit(shards))).withColumn("block", F.explode(F.sequence(zero, F.lit(blocks - 1).cast("long"))))
    asked = queries.withColumn("query_hash", deal).withColumn("block", F.pmod("query_hash", F.lit(blocks)))
    asked = asked.withColumn("shard", F.explode(F.sequence(zero, F.lit(shards - 1).cast("long"))))
    found = asked.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(lambda a, b: _search(k)(b, a), "query_id long, query_hash long, vec_id long, score long")
    merged = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % STRIDE == 0))


#: The same rows by brute force.
OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT vec_id AS query_id, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0)
), c AS (
  SELECT vec_id, unnest(e) AS y, generate_subscripts(e, 1) AS d FROM v
), s AS (
  SELECT query_id, vec_id, CAST(sum(x * y) AS BIGINT) AS score FROM q JOIN c USING (d) WHERE query_id <> vec_id GROUP BY query_id, vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
