"""Operator 11: counts of texts and of prefixes against the library."""

import random

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm import prefix_counts, token_counts
from loomspan.llm.text import flat
from loomspan.llm.tokens import Store, vocabulary

AT = "/root/testdata/sf0.001"
PATH = vocabulary("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = st.lists(st.sampled_from([*"abthe 10.é梦ﬁ\t\n\x00/", "▁", "  ", "   ", "the", "ing", "😀", "<s>", "<0x41>", "한"]), max_size=40).map("".join)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_every_prefix_has_the_librarys_count(texts):
    units = prefix_counts.counter(PATH).batch(flat(pa.array(texts, pa.string())))
    assert units.counts().tolist() == [len(LIBRARY.encode(t)) for t in texts]
    for i, t in enumerate(texts):
        assert units.prefixes(i).tolist() == [len(LIBRARY.encode(t[:k])) for k in range(len(t) + 1)]


@pytest.mark.parametrize("text", ["a" * 3000, "the" * 900, " " * 2500, "abab" * 700, "é" * 1500, "梦" * 1500, "".join(random.Random(3).choices("abcdefgh", k=6000)), "aab" * 900 + "b", "x" * 600 + " y " + "ab" * 800])
def test_long_units_in_lanes(text):
    units = prefix_counts.counter(PATH).batch(flat(pa.array([text])))
    counts = units.prefixes(0)
    assert counts[-1] == len(LIBRARY.encode(text))
    for k in random.Random(1).sample(range(len(text)), 40):
        assert counts[k] == len(LIBRARY.encode(text[:k]))


def test_a_full_store_starts_anew(monkeypatch):
    own = prefix_counts.PrefixCounter(PATH)
    own.store = Store(4)
    for texts in (["a b c d"], ["e f g h i"], [" ".join(f"w{i}" for i in range(40)), "a b"]):
        assert own.batch(flat(pa.array(texts))).counts().tolist() == [len(LIBRARY.encode(t)) for t in texts]


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in token_counts.op11_token_counts(spark, AT).collect()}
    assert len(got) == len(docs)
    for r in docs:
        n = len(LIBRARY.encode(r.text or ""))
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 4096)
        assert (got[r.doc_id].n_kept == len(r.text or "")) == (n <= 4096)


def test_odd_rows_and_limits(spark, odd):
    got = token_counts.token_counts(odd(), PATH, limit=3).collect()
    want = sorted(((i, len((t or "").encode()), len(LIBRARY.encode(t or ""))) for i, t in odd.rows), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    texts = {(i, len((t or "").encode())): t or "" for i, t in odd.rows}
    for r in got:
        t = texts[r.doc_id, r.n_bytes]
        assert len(LIBRARY.encode(t[: r.n_kept])) <= 3 and (r.n_kept == len(t) or len(LIBRARY.encode(t[: r.n_kept + 1])) > 3)
    assert token_counts.token_counts(odd([]), PATH).count() == 0


def test_stored_counts_answer_questions(spark):
    rows = [(1, "The quick brown fox"), (2, None), (3, "")]
    stored = token_counts.prefix_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    got = {r.doc_id: r for r in stored.select("doc_id", "prefix_tokens", token_counts.tokens_within(F.col("prefix_tokens"), 5).alias("five"), token_counts.longest_within(F.col("prefix_tokens"), 2).alias("two"), token_counts.longest_within(F.col("prefix_tokens"), -1).alias("none")).collect()}
    assert got[1].prefix_tokens == [len(LIBRARY.encode(rows[0][1][:k])) for k in range(20)]
    assert got[1].five == len(LIBRARY.encode("The q")) and got[1].two == max(k for k in range(20) if len(LIBRARY.encode(rows[0][1][:k])) <= 2)
    assert got[2].prefix_tokens == got[3].prefix_tokens == [0] and got[2].two == 0 and got[1].none is None
