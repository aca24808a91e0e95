"""Density clustering, dimension reduction and parameter sweeps over vectors."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..shared import grown, saved
from . import neighbours
from .features import numbered
from .forest import components_at

#: Vectors of a block in vector_clusters, at most and at least, and blocks that it makes between these two.
WIDE, NARROW, BLOCKS = 1 << 17, 1 << 10, 8
#: Vectors of one block that are compared with all of the other at a time.
STRIP = 128


def density_clusters(ids: DataFrame, pairs: DataFrame, trials: DataFrame) -> DataFrame:
    """trial, card_id, cluster_id, prob for each trial (trial, eps, min_samples, min_cluster_size).

    Core: min_samples neighbours within eps, itself included. Clusters: components of core links, numbered from 0 by least
    member; a border card joins its nearest core; smaller clusters and the rest are noise (-1). prob is 1 for a core and
    1 - d / eps for a border card, 0 for noise.

    For each min_samples a card has a core distance, from which on it is a core, and a link holds from the greatest of its
    length and its ends' core distances on. The minimum spanning forest of these links has the components of every eps, so
    the pairs are read once however many trials there are; only the forest is cut for each eps. (The grid itself is small and
    is read on the driver.)
    """
    grid, levels, samples = _grid(trials)
    combos, many = _combos(grid, levels, samples), len(samples)
    names = _names(ids, many)
    card = saved(core_distances(names, pairs, samples), "core-distances")
    side = lambda c: card.select(F.col("card_id").alias(c), F.col("number").alias(f"{c}_no"), F.col("core").alias(f"{c}_core"))
    linked = saved(pairs.where(F.col("d") <= max(levels, default=0.0)).join(side("a"), "a").join(side("b"), "b"), "links")
    weight = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: F.struct(i.alias("mi"), F.greatest("d", F.get("a_core", i), F.get("b_core", i)).alias("w")))
    links = linked.select("a_no", "b_no", F.inline(weight)).where(F.col("w") <= max(levels, default=0.0))
    node = lambda c: (F.col(c) * many + F.col("mi"))
    roots = components_at(links.select(node("a_no").alias("u"), node("b_no").alias("v"), "w"), levels)
    ways = linked.select(F.col("a").alias("card_id"), F.col("b").alias("core"), "d", F.col("a_core").alias("own"), F.col("b_core").alias("its")).union(linked.select("b", "a", "d", "b_core", "a_core"))
    near = ways.select("card_id", "core", "d", F.inline(F.filter(combos, lambda x: (F.get("own", x["mi"]) > x["eps"]) & (F.get("its", x["mi"]) <= x["eps"]) & (F.col("d") <= x["eps"]))))
    return _clusters(ids, trials, grid, card, roots, near)


def vector_clusters(vectors: DataFrame, trials: DataFrame) -> DataFrame:
    """density_clusters() of the pairs within the greatest eps, none of which leaves the task that finds it.

    vectors: card_id, embedding. Two blocks meet in a task twice. The first time it gives the least distances of each vector,
    which make the core distances. The second time it gives what its links join at each level, an edge for each vector at most,
    and the nearest core of each vector that is none. The edges of all tasks have the components of all links. So what is
    written grows with vectors times blocks, not with pairs, and there are as many blocks whatever the vectors' number is, until
    they are as wide as a task may hold; the distances worked out are all of those between blocks that meet.
    """
    grid, levels, samples = _grid(trials)
    many, eps = len(samples), max(levels, default=0.0)
    names = _names(vectors, many)
    v = neighbours._rows(vectors, "card_id")
    if v is None or not grid:
        return density_clusters(vectors, vectors.sparkSession.createDataFrame([], "a long, b long, d double"), trials)
    own, sides = neighbours.met_blocks(v, eps, min(WIDE, max(NARROW, -(-v.count() // BLOCKS))))
    sides = saved(sides, "meetings")
    tasks = max(1, sides.select("i", "j").distinct().count())
    deal = lambda rows: rows.join(F.broadcast(sides), "block").repartition(tasks, "i", "j").groupBy("i", "j")
    most = max(samples) - 1

    def nearest(rows: pa.Table) -> pa.Table:
        best = np.full((rows.num_rows, most), np.inf)
        for p, q, d in neighbours.near_in(rows, eps, STRIP):
            for x in (p, q):
                less = d < best[x, -1]
                x, z = x[less], d[less]
                order = np.lexsort((z, x))
                at, first, n = np.unique(x[order], return_index=True, return_counts=True)
                nth = np.arange(len(x)) - np.repeat(first, n)
                few = nth < most
                own = np.full((len(at), most), np.inf)
                own[np.repeat(np.arange(len(at)), n)[few], nth[few]] = z[order][few]
                best[at] = np.sort(np.concatenate([best[at], own], 1), 1)[:, :most]
        some = np.flatnonzero(np.isfinite(best[:, 0]))
        return pa.table({"card_id": rows["k"].to_numpy()[some], "near": pa.FixedSizeListArray.from_arrays(pa.array(best[some].ravel()), most).cast(pa.list_(pa.float64()))})

    near = deal(own).applyInArrow(nearest, "card_id long, near array<double>") if most > 0 else vectors.sparkSession.createDataFrame([], "card_id long, near array<double>")
    card = saved(_cores(names, near.groupBy("card_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, max(most, 1)).alias("near")), samples), "core-distances")
    at = [(samples.index(m), levels.index(e), e) for e, m in grid]

    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("number")  # a set's root is its least number then, so that tasks that share a block give the same edges
        ids, number = rows["k"].to_numpy(), rows["number"].to_numpy()
        core = rows["core"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        root = np.tile(np.arange(len(ids)), (many, len(levels), 1))
        far, its = np.full((len(at), len(ids)), np.inf), np.zeros((len(at), len(ids)), np.int64)
        for p, q, d in neighbours.near_in(rows, eps, STRIP):
            for mi in range(many):
                w = np.maximum(d, np.maximum(core[p, mi], core[q, mi]))
                for li, level in enumerate(levels):
                    _join(root[mi, li], p[w <= level], q[w <= level])
            for n, (mi, _, e) in enumerate(at):
                for x, y in ((p, q), (q, p)):
                    border = (core[x, mi] > e) & (core[y, mi] <= e) & (d <= e)
                    x, y, z = x[border], ids[y[border]], d[border]
                    order = np.lexsort((y, z, x))
                    x, first = np.unique(x[order], return_index=True)
                    y, z = y[order][first], z[order][first]
                    less = (z < far[n, x]) | ((z == far[n, x]) & (y < its[n, x]))
                    far[n, x[less]], its[n, x[less]] = z[less], y[less]
        parts = []
        for mi in range(many):
            for li in range(len(levels)):
                before = root[mi, li - 1] if li else np.arange(len(ids))
                moved = np.flatnonzero((before == np.arange(len(ids))) & (root[mi, li] != np.arange(len(ids))))
                parts.append((True, mi, li, number[moved], number[root[mi, li][moved]], np.full(len(moved), levels[li])))
        for n, (mi, li, _) in enumerate(at):
            some = np.flatnonzero(np.isfinite(far[n]))
            parts.append((False, mi, li, ids[some], its[n, some], far[n, some]))
        columns = [np.concatenate([np.full(len(part[3]), part[i]) if i < 3 else part[i] for part in parts]) for i in range(6)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()))], ["link", "mi", "li", "a", "b", "d"])

    known = own.join(grown(card.select(F.col("card_id").cast("long").alias("k"), "number", "core")), "k")
    found = saved(deal(known).applyInArrow(joined, "link boolean, mi int, li int, a long, b long, d double"), "joined")
    node = lambda c: (F.col(c) * many + F.col("mi"))
    roots = components_at(found.where("link").select(node("a").alias("u"), node("b").alias("v"), F.col("d").alias("w")), levels)
    edge = F.get(F.array(*(F.lit(float(e)) for e in levels)), F.col("li"))
    return _clusters(vectors, trials, grid, card, roots, found.where("not link").select(F.col("a").alias("card_id"), F.col("b").alias("core"), "d", "mi", "li", edge.alias("eps")))


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the ends of links; root holds the least place of each place's set, before and after."""
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def _grid(trials: DataFrame) -> tuple[list[tuple[float, int]], list[float], list[int]]:
    grid = sorted({(r["eps"], r["min_samples"]) for r in trials.select("eps", "min_samples").distinct().collect()})
    return grid, sorted({e for e, _ in grid}), sorted({m for _, m in grid})


def _combos(grid: list[tuple[float, int]], levels: list[float], samples: list[int]) -> Column:
    return F.array(*(F.struct(F.lit(samples.index(m)).alias("mi"), F.lit(levels.index(e)).alias("li"), F.lit(e).cast("double").alias("eps")) for e, m in grid))


def _names(ids: DataFrame, many: int) -> DataFrame:
    return dense_numbers(ids) if many > 1 else ids.select("card_id", F.col("card_id").alias("number")).where("card_id is not null").distinct()


def _clusters(ids: DataFrame, trials: DataFrame, grid: list[tuple[float, int]], card: DataFrame, roots: DataFrame, near: DataFrame) -> DataFrame:
    """card: card_id, number, core; roots: node, roots of the links; near: cores (core, d) of cards that are none at mi, li, eps."""
    levels, samples = sorted({e for e, _ in grid}), sorted({m for _, m in grid})
    combos, many = _combos(grid, levels, samples), len(samples)
    at = card.select("card_id", "core", F.posexplode(F.transform("core", lambda x: F.col("number") * many)).alias("mi", "base")).select("card_id", "core", "mi", (F.col("base") + F.col("mi")).alias("node"))
    each = at.join(grown(roots), "node", "left").select("card_id", "node", "core", "roots", "mi", F.inline(F.transform(combos, lambda x: F.struct(x["mi"].alias("mj"), x["li"].alias("li"), x["eps"].alias("eps")))))
    rooted = saved(each.where((F.col("mi") == F.col("mj")) & (F.get("core", F.col("mi")) <= F.col("eps"))).select("mi", "li", F.col("card_id").alias("core"), F.coalesce(F.get("roots", F.col("li")), "node").alias("root")), "rooted")
    border = near.groupBy("mi", "li", "card_id").agg(F.min(F.struct("d", "core", "eps")).alias("x")).select("mi", "li", "card_id", "x.*")
    border = border.join(grown(rooted), ["mi", "li", "core"]).select("mi", "li", "card_id", "root", F.greatest(F.lit(0.0), 1 - F.col("d") / F.col("eps")).alias("prob"))
    place = lambda c, values: F.array_position(F.array(*(F.lit(v).cast(k) for v, k in values)), F.col(c).cast(values[0][1])).cast("int") - 1
    trials = F.broadcast(trials.select("trial", "min_cluster_size", place("min_samples", [(m, "long") for m in samples]).alias("mi"), place("eps", [(e, "double") for e in levels]).alias("li")) if grid else trials.selectExpr("trial", "min_cluster_size", "0 mi", "0 li"))
    members = rooted.select("mi", "li", F.col("core").alias("card_id"), "root", F.lit(1.0).alias("prob")).union(border)
    sizes = members.groupBy("mi", "li", "root").agg(F.count(F.lit(1)).alias("size"), F.min("card_id").alias("least")).join(trials, ["mi", "li"]).where(F.col("size") >= F.col("min_cluster_size"))
    ordered = sizes.select("trial", "mi", "li", "root", (F.row_number().over(Window.partitionBy("trial").orderBy("least")) - 1).alias("cluster_id"))
    found = members.join(grown(ordered), ["mi", "li", "root"]).select("trial", "card_id", "cluster_id", "prob")
    every = ids.select("card_id").join(trials.select("trial"))
    return every.join(grown(found), ["trial", "card_id"], "left").select("trial", "card_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("prob", F.lit(0.0)).alias("prob"))


def core_distances(names: DataFrame, pairs: DataFrame, samples: list[int]) -> DataFrame:
    """card_id, number and core: for each number of samples the distance of the last of so many neighbours, the card itself
    being the first; infinity where there are too few."""
    most = max(samples, default=1) - 1
    both = pairs.select("a", "d").union(pairs.select("b", "d"))
    ranked = both.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy("d"))).where(F.col("nth") <= max(most, 0))
    return _cores(names, ranked.groupBy(F.col("a").alias("card_id")).agg(F.array_sort(F.collect_list("d")).alias("near")), samples)  # at most `most`


def _cores(names: DataFrame, near: DataFrame, samples: list[int]) -> DataFrame:
    core = F.array(*(F.lit(0.0) if m <= 1 else F.coalesce(F.get("near", F.lit(m - 2)), F.lit(float("inf"))) for m in samples)).cast("array<double>")
    return names.join(near, "card_id", "left").select("card_id", "number", core.alias("core"))


def dense_numbers(ids: DataFrame) -> DataFrame:
    """card_id and its number from 0 in ascending order, so that numbers times trials stay in a long whatever the ids are."""
    return saved(numbered(ids.select("card_id").where("card_id is not null").distinct(), "card_id", "number"), "numbers")


def trial_grid(spark, eps: list[float], min_samples: list[int], min_cluster_size: list[int]) -> DataFrame:
    rows = [(i, *x) for i, x in enumerate(product(eps, min_samples, min_cluster_size))]
    return spark.createDataFrame(rows, "trial int, eps double, min_samples int, min_cluster_size int")


def pca(vectors: DataFrame, k: int, key: str = "card_id") -> DataFrame:
    """key and the first k principal components; each component's largest loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(doubles(F.col("embedding"))).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(rows)
    loads = model.pc.toArray()  # dimensions x k
    signs = [1.0 if loads[abs(loads[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    return model.transform(rows).select(key, F.zip_with(vector_to_array("y"), F.array(*map(F.lit, signs)), lambda a, b: a * b).alias("reduced"))
