"""The near copies of the pipeline against brute-force Jaccard similarity."""

import random
import re

import corpus_pipeline
from loomspan.llm import common, copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, least.get(find(i))) for i, (doc, _) in enumerate(rows)]


def edited(draw, words, n):
    words = list(words)
    for i in draw.sample(range(len(words)), n):
        words[i] = f"edit{draw.random()}"
    return " ".join(words)


def rows_with_edits():
    draw, out = random.Random(4), []
    for _ in range(40):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(60, 500))]
        out += [" ".join(words)] + [edited(draw, words, len(words) * k // 100) for k in (1, 2, 2, 3, 4, 6)]
    common = [f"line{i}" for i in range(25)]
    out += [" ".join([f"own{draw.randrange(5000)}" for _ in range(20)] + common) for _ in range(40)]
    return list(enumerate(out, 100))


def test_near_copies_against_brute_force(spark, odd):
    rows = odd.rows + rows_with_edits()
    want = groups(rows)
    assert sorted(map(str, map(tuple, copies.mark(odd(rows)).collect()))) == sorted(map(str, want))
    assert copies.mark(odd([])).count() == 0


def test_the_stage_keeps_one_of_edited_copies(spark, odd):
    rows = rows_with_edits()
    kept = corpus_pipeline.drop_near_copies(spark, odd(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, root in groups(rows) if i == root)


def test_blocks_of_a_bucket_and_shuffled_joins_give_the_same(spark, odd, monkeypatch):
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    draw = random.Random(9)
    words = [f"w{draw.randrange(5000)}" for _ in range(150)]
    rows = list(enumerate(edited(draw, words, draw.choice([1, 3, 4, 6, 9])) for _ in range(60)))
    monkeypatch.setattr(copies, "BLOCK", 7)
    assert sorted(map(tuple, copies.mark(odd(rows)).collect())) == sorted(groups(rows))
