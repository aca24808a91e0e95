"""Operators 5 and 7 against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from loomspan.llm import simhash, substrings
from loomspan.operators.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "a b  c d e"), (None, "one"), (6, "ÄÖ ß " * 400), (7, "x" * 70_000)]


def small():
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    passage = " ".join(f"w{i}" for i in range(40))
    return ODD + [(x["doc_id"] + 100, x["text"]) for x in rows] + [(1001, "start " + passage), (1002, passage + " end " + passage), (1003, "same " * 80)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, chunk string, fp int").repartition(5)


def removed(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_repeats_against_brute_force(spark):
    rows = small()
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == Counter(removed(rows, 35))
    assert all(sum(x.end_word - x.first_word for x in r.intervals) == r.n_removed for r in got)


def thue_morse(a, b, doublings=10):
    x = a
    for _ in range(doublings):
        x, a, b = x + b, a + b, b + a
    return x


def test_windows_that_fool_polynomials_stay(spark):
    """Words, and sequences of words, whose polynomials modulo a power of two agree."""
    tail = " ".join(f"t{i}" for i in range(34))
    rows = [(1, f"{thue_morse('a', 'b')} {tail}"), (2, f"{thue_morse('b', 'a')} {tail}")]
    rows += [(3, " ".join([*thue_morse("a", "b", 5), *tail.split()[:3]])), (4, " ".join([*thue_morse("b", "a", 5), *tail.split()[:3]]))]
    assert all(r.n_removed == 0 for r in substrings.remove_repeats(frame(spark, rows)).collect())


def test_equal_first_hashes_are_told_apart(monkeypatch):
    hashes, checks = np.array([7, 7, 3, 7], np.uint64), np.array([2, 1, 5, 2], np.uint32)
    order, new = substrings.in_order(hashes, checks)
    assert (np.diff(hashes[order].astype(int)) >= 0).all() and new.sum() == 3
    assert np.array_equal(substrings.unpacked(np.frombuffer(substrings.packed(checks), np.uint8)), checks)


def test_equal_rows_are_dealt_over_chunks(spark):
    rows = [(5, "one two three " * 30)] * 400
    got = substrings.remove_repeats(frame(spark, rows))
    assert Counter((r.n_words, r.n_removed) for r in got.collect()) == {(90, 90): 400}


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def print_of(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(rows, most=4):
    prints = [print_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, prints[i], least.get(find(i))) for i, (doc, _) in enumerate(rows)]


def test_simhash_against_brute_force(spark):
    rows = small()
    got = simhash.mark(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == Counter(linked(rows))


def test_simhash_of_nothing(spark):
    assert simhash.mark(frame(spark, [])).count() == 0


def test_every_value_has_one_anchor_in_reach():
    values = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    row, anchor = simhash.anchors(values, 3)
    assert np.array_equal(row, np.arange(5000)) and not simhash.syndrome(anchor).any()
    assert (np.bitwise_count(values ^ anchor) <= 3).all()


@pytest.mark.parametrize("n", [300, 900])
def test_links_near_the_threshold(spark, n):
    draw = random.Random(n)
    prints = []
    for _ in range(n // 6):
        base = draw.getrandbits(64)
        for flips in range(6):
            prints.append(base ^ sum(1 << b for b in draw.sample(range(64), flips)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")).collect()}
    root = list(range(n))
    for _ in range(n):
        new = [min(root[j] for j in range(n) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(n)] if n <= 300 else None
        if new is None or new == root:
            break
        root = new
    if n <= 300:
        assert got == dict(enumerate(root))
    a, b = simhash.near_pairs(np.array(prints, np.uint64), 4)
    assert set(map(tuple, np.sort(np.c_[a, b], axis=1))) == {(j, i) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4}


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + hub + [(5, 5)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text), (2, text + " more"), (9, "other words stand here alone"), (9, "other words stand here alone"), (None, "lone")]
    got = simhash.keep_one(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "chunk", "fp"]
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "lone"), (2, text + " more"), (9, "other words stand here alone")]
