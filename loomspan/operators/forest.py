"""Minimum spanning forests in Spark, and the components that they give at any number of weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, saved
from .graph import components

#: Edges that one task may finish; more are contracted in Spark first. That changes the plan, not the result.
FEW = 1 << 17


def _union(parent: dict[int, int], x: int) -> int:
    """The least node of x's set."""
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def _kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (cu, cv, w, u, v) in one task -> those of the forest between the nodes cu and cv."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    cu, cv, w, u, v = (table[c].to_numpy() for c in ("cu", "cv", "w", "u", "v"))
    parent: dict[int, int] = {}
    kept = []
    for i in np.lexsort((v, u, w)).tolist():
        a, b = _union(parent, int(cu[i])), _union(parent, int(cv[i]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(i)
    yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (u, v, w)], ["u", "v", "w"])


def _lightest(edges: DataFrame) -> DataFrame:
    """Of the edges between two components the first by weight and ends."""
    a, b = F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")
    return edges.where("cu <> cv").groupBy(a, b).agg(F.min(F.struct("w", "u", "v")).alias("e")).select("cu", "cv", "e.w", "e.u", "e.v")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v, w) of longs and doubles -> those of the minimum spanning forest; of equal weights the one with lesser ends.

    Boruvka rounds: every component takes its first edge to another one, and what these edges join is one component from then
    on; each round at least halves the components that have edges. Of edges between the same two components one stays. As
    soon as few enough are left, one task finishes.
    """
    ends = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    left = saved(_lightest(edges.select(*ends, "w").select(F.col("u").alias("cu"), F.col("v").alias("cv"), "w", "u", "v")), "forest-edges")
    found: list[DataFrame] = []
    while (n := left.count()) > FEW:
        both = left.select(F.col("cu").alias("c"), "w", "u", "v", "cu", "cv").union(left.select("cv", "w", "u", "v", "cu", "cv"))
        taken = saved(both.groupBy("c").agg(F.min(F.struct("w", "u", "v", "cu", "cv")).alias("e")).select("e.*").distinct(), "forest-taken")
        found.append(taken.select("u", "v", "w"))
        roots = components(taken.select(F.col("cu").alias("a"), F.col("cv").alias("b")))
        to = lambda rows, c: rows.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
        last, left = left, saved(_lightest(to(to(left, "cu"), "cv")), "forest-edges")
        discard(last)
    if n or not found:
        found.append(left.repartition(1).mapInArrow(_kruskal, "u long, v long, w double"))
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def _walked(edges: DataFrame, levels: list[float]) -> DataFrame:
    """cut() of few edges (u, v, w), which need not be a forest's, in one task."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).sort_by("w")
        u, v, w = (table[c].to_numpy() for c in ("u", "v", "w"))
        nodes = np.unique(np.concatenate([u, v])).tolist()
        parent: dict[int, int] = {}
        labels, start = [], 0
        for level in levels:
            stop = int(np.searchsorted(w, level, "right"))
            for i in range(start, stop):
                a, b = _union(parent, int(u[i])), _union(parent, int(v[i]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
            start = max(start, stop)
            labels.append([_union(parent, x) for x in nodes])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([list(x) for x in zip(*labels)], pa.list_(pa.int64()))], ["node", "roots"])

    return edges.select("u", "v", "w").repartition(1).mapInArrow(walk, "node long, roots array<long>")


def components_at(edges: DataFrame, levels: list[float]) -> DataFrame:
    """node, roots of a graph with edges (u, v, w): cut() of its minimum spanning forest."""
    edges = saved(edges, "weighted-edges")
    return _walked(edges, levels) if edges.count() <= FEW else cut(spanning_forest(edges), levels)


def cut(forest: DataFrame, levels: list[float]) -> DataFrame:
    """node, roots for every node of a forest: at each level (ascending) the least node that edges up to its weight reach.

    Every edge is used once: a level joins the components of the one below. A forest of few edges is cut in one task.
    """
    forest = saved(forest, "forest")
    if forest.count() <= FEW:
        return _walked(forest, levels)
    nodes = forest.select(F.col("u").alias("node")).union(forest.select("v")).distinct().withColumns({"last": F.col("node"), "roots": F.array().cast("array<long>")})
    nodes, below = saved(nodes, "forest-nodes"), float("-inf")
    for level in levels:
        ends = nodes.select("node", "last")
        own = forest.where((F.col("w") > below) & (F.col("w") <= level)).join(ends.withColumnsRenamed({"node": "u", "last": "a"}), "u").join(ends.withColumnsRenamed({"node": "v", "last": "b"}), "v")
        moved = components(own.select("a", "b")).withColumnRenamed("node", "last")
        last, nodes = nodes, saved(nodes.join(moved, "last", "left").select("node", F.coalesce("root", "last").alias("last"), "roots").withColumn("roots", F.concat("roots", F.array("last"))), "forest-nodes")
        discard(last)
        below = level
    return nodes.select("node", "roots")
