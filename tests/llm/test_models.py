"""Operators 1 and 4: accuracy on rows that training never sees, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import quality, toxicity
from loomspan.llm.text import flat

AT = "/root/testdata/sf0.01"


def judged(spark, op, column, at=AT):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = op(spark, at).collect()
    assert len(rows) == spark.read.parquet(f"{at}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    return rows, np.array([labels[r.doc_id] for r in held]), np.array([r.score for r in held]), np.array([r.predicted for r in held])


def area(y, score):
    rank = score.argsort().argsort() + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_quality(spark):
    rows, y, score, predicted = judged(spark, quality.op1_quality, "quality")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert area(y, score) > 0.95 and (predicted == y).mean() > 0.93


def test_toxicity(spark):
    rows, y, score, predicted = judged(spark, toxicity.op4_toxicity, "toxic", "/root/testdata/sf0.1")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert area(y, score) > 0.95 and predicted[y == 1].mean() >= 0.9 and predicted[y == 0].mean() <= 0.02


def test_the_worst_words_of_each_text():
    scores, first = np.array([1.0, 5, 5, 2, -1, 3, 0]), np.array([0, 4, 4, 6, 7])
    places, doc = toxicity.worst(scores, first, 2)
    assert places.tolist() == [1, 2, 4, 5, 6] and doc.tolist() == [0, 0, 2, 2, 3]


def test_misspellings_share_subwords():
    words = "the of and river stone light house green walks under over many small roads".split()
    draw = np.random.default_rng(1)
    rows = [(" ".join(draw.choice(words, 40)) + (" you wretchling there" if i % 2 else ""), i % 2) for i in range(300)]
    weights, bias = toxicity.train(rows)
    scores = toxicity.scores_of(weights, bias, flat(pa.array(["the wretchlinng and wretchlings", "the river and stone", ""])))
    assert scores[0] > 0.5 > scores[1] and scores[2] == 0


@pytest.mark.parametrize("kind", ["labelled", "one class", "none"])
@pytest.mark.parametrize("module,column", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, odd, module, column, kind):
    plain = [(100 + i, ("good words stand here " * 5) if i % 2 else ("bad$$$ bad$$$ " * 5)) for i in range(60)]
    labels = [] if kind == "none" else [(i, (i % 2) if kind == "labelled" else 1) for i, _ in plain] + [(None, 1), (101, None), (4, 7)]
    docs = odd(odd.rows + plain)
    scores = docs.select("doc_id", "text", module.scorer(docs, spark.createDataFrame(labels, f"doc_id long, {column} int")).alias("s")).collect()
    assert len(scores) == len(odd.rows) + 60 and all(0 <= r.s <= 1 for r in scores)
    none = odd([])
    assert none.select(module.scorer(none, spark.createDataFrame(labels, f"doc_id long, {column} int"))).count() == 0


def test_toxic_rows_go(spark, odd):
    plain = [(100 + i, "good words stand here and there " * 4 + ("vile wretchling" if i % 2 else "")) for i in range(120)]
    docs, labels = odd(plain + [(1, None), (None, "")]), spark.createDataFrame([(i, i % 2) for i, _ in plain], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1] + [100 + i for i in range(0, 120, 2)]
