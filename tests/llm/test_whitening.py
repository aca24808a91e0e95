"""Operator 12: the decomposition against numpy's, and the query against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import whitening

AT = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 24), seed=st.integers(0, 10**6), kind=st.sampled_from(["even", "wide", "double", "flat", "low"]))
def test_components_are_eigenvectors(n, seed, kind):
    r = np.random.default_rng(seed)
    q, _ = np.linalg.qr(r.normal(size=(n, n)))
    e = {"even": r.uniform(0, 1, n), "wide": 10.0 ** r.uniform(-12, 3, n), "double": np.repeat([1.0, 2.0], [n - n // 2, n // 2]), "flat": np.ones(n), "low": np.append(np.zeros(n - n // 3), r.uniform(0, 1, n // 3))}[kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.components(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][:4]
    scale = max(np.abs(want).max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * scale
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12


def test_polar_factor_is_orthogonal():
    r = np.random.default_rng(3)
    a = r.normal(size=(30, 30))
    a = a + a.T
    u = whitening.polar(a)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-13 and np.linalg.eigvalsh(u @ a).min() > -1e-12


def brute(rows):
    """vec_id -> (deviation, whitened, explained) and n, by numpy over the distinct whole-number vectors."""
    kept = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in kept}))
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:4], axes[:, ::-1][:, :4]
    out = [(i, sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, sums)), (np.array(x) - sums / n) @ axes / np.sqrt(e)) for i, x in kept]
    return n, out, e / np.trace(v)


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{AT}/embeddings.parquet").collect()]
    n, want, shares = brute(rows)
    got = whitening.op12_whitening(spark, AT).collect()
    assert len(got) == 4 * len(want) and {r.n for r in got} == {n}
    own = {(r.vec_id, r.component): r for r in got}
    signs = np.sign([sum(own[i, c + 1].whitened * w[c] for i, _, w in want) for c in range(4)])
    for i, deviation, w in want:
        for c in range(4):
            r = own[i, c + 1]
            assert r.deviation == deviation and abs(r.whitened - signs[c] * w[c]) < 1e-9 and abs(r.explained / shares[c] - 1) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_odd_rows(spark):
    far = float("inf")
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [-0.5, 1.0]), (3, None), (4, [None, 1.0]), (5, [far, 1.0]), (6, [float("nan"), 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-0.0, -1.0])]
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in rows], "vec_id long, embedding array<float>, n int, x string").repartition(3)
    got = whitening.whitened(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(i, c) for i in (0, 1, 2, 9) for c in (1, 2)]
    n, want, _ = brute([r for r in rows if r[0] in (1, 2, None, 9)])
    assert {r.n for r in got} == {n} == {3} and {(r.vec_id, r.deviation) for r in got} == {(i, d) for i, d, _ in want}
    assert all(r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("rows,n", [([], None), ([(1, None)], None), ([(1, [0.5, 0.5]), (2, [0.5, 0.5])], 1)])
def test_nothing_to_spread(spark, rows, n):
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == (0 if n is None else 2 * len(rows))
    assert all(r.n == n and r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)


def test_great_numbers(spark):
    got = whitening.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [1e17, 0.0]), (3, [-1e17, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 8 and {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: None, 4: 1}  # the greatest and the least long remain of the others
