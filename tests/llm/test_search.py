"""Operators 6 and 9 against brute force, and the pipeline."""

import importlib.util
import random

import numpy as np
import pytest

from test_near_copies import groups

from loomspan.llm import decontaminate, search

AT = "/root/testdata/sf0.001"


def brute(rows, k):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def found(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, shard int").repartition(3)
    return sorted(map(tuple, search.top_k(df, df.where("vec_id % 50 = 0"), k).collect()))


def test_top_k(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{AT}/embeddings.parquet").collect()]
    assert found(spark, rows) == brute(rows, 5)


def test_top_k_with_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD", 7)
    draw = random.Random(2)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5]) for _ in range(6)]) for i in range(1, 120)]  # many ties
    rows += [(0, [1.0] * 6), (100, [0.25] * 6), (200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (204, []), (205, [2.0]), (150, []), (7, rows[6][1]), (None, [1.0] * 6), (0, [1.0] * 6)]
    assert found(spark, rows) == brute(rows, 5)
    assert found(spark, []) == [] and found(spark, [(0, [1.0])]) == []


def test_top_k_beyond_doubles(spark):
    rows = [(0, [3e6, 1.0, -2e6]), (1, [2e6, 0.5, 1e6]), (2, [2e6, 0.25, 1e6]), (50, [-1e6, 3.0, 1.0])]
    assert found(spark, rows) == brute(rows, 5)


def test_scores_beyond_a_long_stay_at_its_bound(spark):
    assert [x[3] for x in found(spark, [(0, [3e7]), (1, [3e7]), (2, [-3e7])])] == [2**63 - 1, -(2**63)]


def test_max_score_prunes_and_stays_exact():
    draw = np.random.default_rng(3)
    vectors = draw.integers(-40, 40, (2000, 32)).astype(float) * (0.7 ** np.arange(32) * 8).round(2)
    vectors = np.floor(vectors)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(self)[at]
            read.append(out.size)
            return out

    postings, ids = np.ascontiguousarray(vectors.T).view(Counted), np.arange(2000)
    for q in range(0, 2000, 400):
        places, scores = search.max_score(vectors[q], q, postings, vectors.min(0), vectors.max(0), ids, 5)
        full = vectors @ vectors[q]
        full[q] = -np.inf
        assert np.array_equal(scores, full[np.lexsort((ids, -full))[:5]])
    assert sum(read) < 0.7 * 5 * vectors.size


WORDS = [f"{a}{b}" for a in "ka lo mi nu pe ra so ti vu wy".split() for b in "den far gol him jas kor lum".split()]


def passages(seed, n, size):
    draw = random.Random(seed)
    return [[draw.choice(WORDS) + str(draw.randrange(400)) for _ in range(size)] for _ in range(n)]


def test_leaks_are_found_and_clean_rows_left(spark, odd):
    draw, items = random.Random(8), passages(1, 12, 30)
    edit = lambda w, rate: [("changed" + str(draw.random()) if draw.random() < rate else x) for x in w]
    clean = [(200 + i, " ".join(w)) for i, w in enumerate(passages(2, 30, 150))]
    exact = [(300 + i, " ".join(passages(30 + i, 1, 60)[0] + items[i % 12] + passages(60 + i, 1, 40)[0])) for i in range(12)]
    edited = [(400 + i, " ".join(passages(90 + i, 1, 50)[0] + edit(items[i % 12], 0.15) + passages(120 + i, 1, 30)[0])) for i in range(12)]
    many = [(500, " ".join(sum((w + passages(150 + i, 1, 9)[0] for i, w in enumerate(items)), [])))]
    loud = [(600 + i, " ".join(items[3]).upper().replace(" ", ", ")) for i in range(3)]
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(90, None, 1), (91, "", 1), (92, "and", 1), (None, None, 1)], "item_id long, text string, score int")
    docs = odd(odd.rows + clean + exact + edited + many + loud)
    hits = {}
    for r in decontaminate.contaminated(docs, bench).collect():
        hits.setdefault(r.doc_id, {})[r.item_id] = r.score
    assert all(hits[300 + i].get(i) == 1.0 for i in range(12)) and all(hits[400 + i][i] >= 0.5 for i in range(12))
    assert set(hits[500]) >= set(range(12)) and all(3 in hits[600 + i] for i in range(3))
    assert set(hits) == {*range(300, 312), *range(400, 412), 500, 600, 601, 602}
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(odd.rows) + 30
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(odd([]), bench).count() == 0


def test_blocks_of_items_give_the_same(spark, odd, monkeypatch):
    items = passages(5, 10, 20)
    docs = odd([(i, " ".join(passages(40 + i, 1, 30)[0] + w)) for i, w in enumerate(items)])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole and len(whole) == 10


def smith_waterman(a, b):
    best, rows = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if x == y else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment_equals_the_recurrence():
    draw = np.random.default_rng(6)
    pairs = [(draw.integers(1, 6, draw.integers(1, 12)).astype(np.uint64), draw.integers(1, 6, draw.integers(1, 25)).astype(np.uint64)) for _ in range(60)]
    got, _ = decontaminate.align([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [smith_waterman(a.tolist(), b.tolist()) for a, b in pairs]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline(spark):
    import corpus_pipeline
    from loomspan.llm import packing, pii, toxicity
    from loomspan.llm.tokens import vocabulary

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "personal_data", "packing"]
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{AT}/{t}.parquet") for t in ("labels", "benchmark"))
    # the same by hand: decisions as sets of ids, then what is left
    calm = {r.doc_id for r in docs.select("doc_id", toxicity.scorer(docs, labels).alias("s")).collect() if r.s < toxicity.THRESHOLD}
    left = docs.where(docs.doc_id.isin(*calm))
    rows = sorted((r.doc_id, r.text) for r in left.select("doc_id", "text").collect())
    left = left.where(left.doc_id.isin(*[i for i, least in groups(rows) if i == least]))  # five words, 0.8, all pairs
    leaked = {r.doc_id for r in decontaminate.contaminated(left, bench).collect()}
    left = left.where(~left.doc_id.isin(*(leaked or {-1})))
    want = packing.pack(pii.redacted(left), vocabulary("byte_bpe_50k.json")).select("doc_id", "piece", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, AT).select("doc_id", "piece", "length", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    staged = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        staged = stage(spark, staged, AT)
        assert staged.columns == docs.columns and staged.dtypes == docs.dtypes


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline_on_odd_rows_and_on_nothing(spark, odd):
    import corpus_pipeline
    from loomspan.shared import saved

    leaked = spark.read.parquet(f"{AT}/benchmark.parquet").orderBy("item_id").first().text
    mine = odd.rows + [(20, f"so it says: {leaked}"), (21, "mail a.b@example.org or bob at example dot org"), (21, "another text under that id"), (None, "another text under that id ."), (22, None)]
    rows = [(i and i + 10**6, t) for i, t in mine]  # no label is theirs
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text").collect()]
    for made in (rows + real, rows, []):
        docs = odd(made)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, saved(stage(spark, docs, AT), name)
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            if name == "toxicity":  # so few labels teach it nothing of these texts: go on with all of them
                assert docs.count() <= before.count()
                docs = before
        kept = docs.select("doc_id", "text").collect()
        ids = {r.doc_id for r in kept}
        assert 20 + 10**6 not in ids and len(kept) == len({(r.doc_id, r.text) for r in kept})
        if made:
            assert {i + 10**6 for i in (5, 6, 7, 8, 21)} <= ids and sum(r.doc_id == 10**6 + 4 for r in kept) == 1
            assert len({10**6 + i for i in (1, 2, 3, 22)} & ids) == 1 and "mail [EMAIL] or [EMAIL]" in {r.text for r in kept}
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, AT).collect()
        assert {r.doc_id for r in packed} == ids


def test_copies_with_every_fourth_word_replaced_are_found(spark, odd):
    items = passages(11, 20, 32)
    copies = [(700 + i, " ".join(passages(200 + i, 1, 20)[0] + [f"new{i}x{k}" if k % 4 == 3 else x for k, x in enumerate(w)] + passages(230 + i, 1, 20)[0])) for i, w in enumerate(items)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd(copies), bench).collect()} == {(700 + i, i) for i in range(20)}


def test_recall_against_alignment_of_all_pairs(spark, odd):
    """Regular and random edits, insertions and deletions, in words of which some are frequent; every pair is aligned whole."""
    draw = random.Random(3)
    common = "the of and to in a is that it was for on as with".split()
    say = lambda n: [draw.choice(common) if draw.random() < 0.4 else draw.choice(WORDS) + str(draw.randrange(60)) for _ in range(n)]
    items = [say(draw.choice([8, 15, 30, 60])) for _ in range(40)]
    new = lambda: draw.choice(WORDS) + str(draw.randrange(60))
    edits = {
        **{f"each {n}": (lambda w, n=n: [new() if k % n == n - 1 else x for k, x in enumerate(w)]) for n in (2, 3, 4, 5)},
        **{f"after {n}": (lambda w, n=n: [y for k, x in enumerate(w) for y in ([x, new()] if k % n == n - 1 else [x])]) for n in (2, 3, 4)},
        "without": lambda w: [x for k, x in enumerate(w) if k % 4 != 3],
        **{f"random {r}": (lambda w, r=r: [new() if draw.random() < r else x for x in w]) for r in (0.1, 0.2, 0.3)},
        "half": lambda w: w[: len(w) // 2 + 1], "whole": lambda w: w,
    }
    rows = [(1000 + 100 * e + i, say(30) + edit(w) + say(20)) for e, edit in enumerate(edits.values()) for i, w in enumerate(items)]
    rows += [(9000 + i, say(200)) for i in range(60)]
    code = {w: k for k, w in enumerate(sorted({x for _, d in rows for x in d} | {x for w in items for x in w}))}
    hashed = [np.array([code[x] for x in d], np.uint64) for _, d in rows]
    want = set()
    for i, item in enumerate(items):
        scores, _ = decontaminate.align([np.array([code[x] for x in item], np.uint64)] * len(rows), hashed)
        want |= {(rows[k][0], i) for k in np.flatnonzero(scores >= len(item)).tolist()}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd([(i, " ".join(d)) for i, d in rows]), bench).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 400


def _found(items, texts_):
    """matches() of a block over texts whose counts are those of these texts."""
    import pyarrow as pa

    from loomspan.llm.text import flat

    batch = flat(pa.array(texts_))
    words, first = decontaminate._words(batch)
    pick = lambda keys, at: np.bincount(at, minlength=len(keys))
    items.choose(pick(items.distinct, decontaminate._uncovered(decontaminate.Lookup(items.distinct), words, first)), len(texts_), pick(items.distinct_words, decontaminate.Lookup(items.distinct_words).find(words)[1]), 0.5)
    lookup = decontaminate.Lookup(items.seed_keys)
    return decontaminate.matches(items, lookup, batch, 0.5), len(decontaminate._seeds(items, words, first, lookup)[0])


def test_a_phrase_of_many_items_costs_no_pair_of_its_own(monkeypatch):
    """Thousands of items begin alike and every text has their beginning: the same finds, from few seeds."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    items = ["which of the following " + " ".join(draw.choices(words, k=draw.randint(3, 40))) for _ in range(3000)] + ["which of the following"]
    texts_ = []
    for d in range(60):
        w = draw.choices(words, k=300)
        w[100:104] = "which of the following".split()
        if d % 3 == 0:
            own = items[draw.randrange(3000)].split()
            w[100 : 100 + len(own)] = [x if draw.random() > 0.15 else "other" for x in own]
        texts_.append(" ".join(w))
    ids = list(range(len(items)))
    few, seeds = _found(decontaminate.Items(ids, items), texts_)
    monkeypatch.setattr(decontaminate, "CROWD", 10**9)
    every, all_seeds = _found(decontaminate.Items(ids, items), texts_)
    assert few == every and sum(map(len, every)) >= 60 + 18
    assert all_seeds > 60 * 3000 * 2 and seeds < all_seeds / 8  # items of which the phrase is half are found in every text


def test_crowded_seeds_in_spark(spark, odd, monkeypatch):
    items = passages(5, 12, 20)
    bench = spark.createDataFrame([(i, " ".join(["tell", "me", "now", "the"] + w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = odd([(i, " ".join(passages(40 + i, 1, 30)[0] + ["tell", "me", "now", "the"] + (w if i % 2 else []) + passages(70 + i, 1, 9)[0])) for i, w in enumerate(items)])
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "CROWD", 2)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole and {r[0] for r in whole} == {1, 3, 5, 7, 9, 11}
