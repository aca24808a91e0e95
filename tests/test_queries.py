"""Every query outside llm that has SQL gives the same rows as DuckDB on the smallest tables; the others keep their own checks."""

import math
from collections import Counter

import duckdb
import pytest

from loomspan.plans import catalog_queries, cluster_queries, deck_queries, io_queries, sampling_queries

AT = "/root/testdata/sf0.001"
MODULES = (catalog_queries, cluster_queries, deck_queries, sampling_queries, io_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, AT)
    columns = sorted(df.columns)
    got = [tuple(plain(row[c]) for c in columns) for row in df.toArrow().to_pylist()]
    out = duck.execute(SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in out.fetchall()]
    assert Counter(got) == Counter(want)


def test_all_but_pca_and_generation_have_sql():
    assert set(QUERIES) - set(SQL) == {"pca_reduce", "projection_2d", "generate_decks"}


def test_pca_explains_as_much_as_numpy(spark):
    import numpy as np

    x = np.array([r.embedding for r in sampling_queries._vectors(spark, AT).orderBy("card_id").collect()], float)
    y = np.array([r.reduced for r in sampling_queries.pca_reduce(spark, AT).orderBy("card_id").collect()])
    top = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:8]
    assert np.allclose(np.sort(y.var(0, ddof=1))[::-1], top)


def test_projection_is_the_first_two_components(spark):
    import numpy as np

    x = np.array([r.embedding for r in sampling_queries._vectors(spark, AT).orderBy("card_id").collect()], float)
    values, loads = np.linalg.eigh(np.cov(x.T))
    loads = loads[:, ::-1][:, :2]
    want = x @ (loads * np.sign(loads[np.abs(loads).argmax(0), [0, 1]]))
    rows = sampling_queries.projection_2d(spark, AT).orderBy("card_id").collect()
    assert {r.method for r in rows} == {"pca"} and np.allclose([(r.x, r.y) for r in rows], want, atol=1e-5)
    y = np.array([r.reduced for r in sampling_queries.pca_reduce(spark, AT).orderBy("card_id").collect()])
    assert np.allclose(np.abs(y[:, :2]), np.abs(want), atol=1e-6)  # and what eight components rebuild is numpy's best
    basis = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :8]
    centred = x - x.mean(0)
    assert np.allclose(((y - y.mean(0)) ** 2).sum(), ((centred @ basis) ** 2).sum())


def _points(spark):
    """Large and negative ids, ties, and vectors that take no part."""
    import numpy as np

    x = np.random.default_rng(2).integers(-3, 4, (90, 3)).astype(float)
    ids = [int(i) * (1 << 41) - (1 << 45) for i in range(90)]
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [(5, None), (6, [1.0]), (7, [None, 1.0, 1.0])]
    return ids, x, spark.createDataFrame(rows, "card_id long, embedding array<double>")


def test_neighbours_of_any_ids_against_all_pairs(spark, monkeypatch):
    import numpy as np

    from loomspan.operators import neighbours

    ids, x, frame = _points(spark)
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    for eps in (0.0, 1.0, 2.3, 9.0):
        want = {(ids[i], ids[j]) for i in range(90) for j in range(i + 1, 90) if np.sqrt(((x[i] - x[j]) ** 2).sum()) <= eps}
        got = [(r.a, r.b) for r in neighbours.neighbour_pairs(frame, eps).collect()]
        assert set(got) == want and len(got) == len(want)
    some = {(r.a, r.b) for r in neighbours.approximate_pairs(frame, 1.0).collect()}
    exact = neighbours.neighbour_pairs(frame, 1.0)
    row = neighbours.recall(exact, neighbours.approximate_pairs(frame, 1.0)).first()
    assert some <= {(r.a, r.b) for r in exact.collect()} and row.n_found == len(some) and row.recall == row.n_found / row.n_exact > 0.9
    assert neighbours.neighbour_pairs(frame.limit(0), 1.0).count() == neighbours.approximate_pairs(frame.limit(0), 1.0).count() == 0


def test_far_blocks_do_not_meet(spark, monkeypatch):
    """Three groups far apart: only blocks of one group meet."""
    from loomspan.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 10)
    rows = [(100 * g + i, [1000.0 * (1, 2, 6)[g] + i / 100, float(i % 7), 0.0]) for g in range(3) for i in range(30)]
    v = neighbours._rows(spark.createDataFrame(rows, "card_id long, embedding array<double>"), "card_id")
    at = neighbours.pivots(v)
    own = neighbours.blocks(neighbours.pivot_table(v, at), 2.0)
    met = {(r.i, r.j) for r in neighbours.meetings(own, 2.0, len(at)).collect()}
    group = {r.block: r.g for r in own.selectExpr("block", "k div 100 g").distinct().collect()}
    assert len(group) == 9 and met and all(group[i] == group[j] for i, j in met)


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_forest_and_cuts_against_plain_ones(spark, monkeypatch, few):
    """In rounds and in one task: ties, loops, parallel edges, parts that are not joined."""
    import random

    from loomspan.operators import forest

    monkeypatch.setattr(forest, "FEW", few)
    draw = random.Random(4)
    edges = [(a, b, float(draw.randint(1, 6))) for _ in range(300) for a, b in ((draw.randrange(80) * 3 - 100, draw.randrange(80) * 3 - 100),)] + [(1000, 1001, 0.5), (1001, 1000, 0.25), (7, 7, 0.0)]
    own = forest.spanning_forest(spark.createDataFrame(edges, "u long, v long, w double"))
    parent = {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    want = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges):
        if top(a) != top(b):
            parent[max(top(a), top(b))] = min(top(a), top(b))
            want.append((a, b, w))
    assert sorted(tuple(r) for r in own.collect()) == sorted(want)
    levels = [0.3, 2.0, 2.5, 9.0]
    got = {r.node: r.roots for r in forest.cut(own, levels).collect()}
    for k, level in enumerate(levels):
        parent.clear()
        for a, b, w in want:
            if w <= level and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
        assert {n: top(n) for n in got} == {n: r[k] for n, r in got.items()}
    assert forest.cut(forest.spanning_forest(spark.createDataFrame([], "u long, v long, w double")), [1.0]).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_clusters_of_a_grid_against_one_trial_at_a_time(spark, monkeypatch, few):
    import numpy as np

    from loomspan.operators import density, forest, neighbours

    monkeypatch.setattr(forest, "FEW", few)
    ids, x, frame = _points(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = neighbours.neighbour_pairs(frame, 2.0)
    trials = density.trial_grid(spark, [1.0, 1.5, 2.0], [1, 3, 5] if few else [3], [1, 4])
    got = {}
    for r in density.density_clusters(frame, pairs, trials).collect():
        got.setdefault(r.trial, {})[r.card_id] = (r.cluster_id, round(r.prob, 9))
    for t in trials.collect():
        near = d <= t.eps
        core = near.sum(1) >= t.min_samples
        label = {i: i for i in range(90) if core[i]}
        for _ in range(90):
            label = {i: min(label[j] for j in label if near[i, j]) for i in label}
        member = {i: (label[i], 1.0) for i in label}
        for i in range(90):
            if not core[i] and (own := [(d[i, j], ids[j], j) for j in label if near[i, j]]):
                member[i] = (label[min(own)[2]], 1 - min(own)[0] / t.eps)
        groups = {}
        for i, (r, _) in member.items():
            groups.setdefault(r, []).append(i)
        number = {r: k for k, r in enumerate(sorted((r for r, g in groups.items() if len(g) >= t.min_cluster_size), key=lambda r: min(groups[r])))}
        want = {c: (-1, 0.0) for c in (5, 6, 7)} if t.min_samples > 1 else {}
        for i in range(90):
            r, p = member.get(i, (None, 0.0))
            want[ids[i]] = (number[r], round(p, 9)) if r in number else (-1, 0.0)
        if t.min_samples > 1 or t.min_cluster_size > 1:
            assert {k: v for k, v in got[t.trial].items() if k not in (5, 6, 7)} == {k: v for k, v in want.items() if k not in (5, 6, 7)}
