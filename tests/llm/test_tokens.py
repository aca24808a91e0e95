"""Operators 2 and 8: ids against the library, packing invariants, exact round trips and damage."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomspan.llm import coder, packing, token_files, tokens
from loomspan.llm.text import flat

AT = "/root/testdata/sf0.001"
TEXT = st.lists(st.sampled_from([*"ab Zé1'.\n\t   <|>", "<|endoftext|>", "  ", "\x1c", "\u0301", "\u00a0", "\u2003"]), max_size=40).map("".join)


def library(name, texts):
    t = Tokenizer.from_file(tokens.vocabulary(name))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def docs_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TEXT, max_size=6))
def test_ids_equal_the_librarys(name, texts):
    ids, counts = tokens.encoder(tokens.vocabulary(name)).encode(flat(pa.array(texts, pa.string())))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(texts)] == library(name, texts)


def test_a_full_store_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "STORE", 8)
    own = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    own.store = tokens.Store(8)
    for texts in (["a b c d e f"], ["g h i j k"], [" ".join(f"w{i}" for i in range(40))], ["a b c"]):
        ids, _ = own.encode(flat(pa.array(texts)))
        assert ids.tolist() == library("byte_bpe_50k.json", texts)[0]


def check_packing(rows, packed, capacity):
    want = Counter()
    for (doc, _), ids in zip(rows, library("byte_bpe_50k.json", [t for _, t in rows])):
        ids = ids + [0]
        pieces = -(-len(ids) // capacity)
        head = len(ids) - capacity * (pieces - 1)
        for p in range(pieces):
            start = 0 if p == 0 else head + capacity * (p - 1)
            part = ids[start : start + (head if p == 0 else capacity)]
            want[(doc, p, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in packed)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, odd, capacity):
    rows = odd.rows + docs_of(spark)
    packed = packing.pack(odd(rows), tokens.vocabulary("byte_bpe_50k.json"), capacity, keep_ids=True)
    n, total = check_packing(rows, packed.collect(), capacity)
    assert n <= -(-total // capacity) * 1.02 + 1
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == total


def test_plans_that_are_not_broadcast_give_the_same(spark, odd, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    packed = packing.pack(odd(), tokens.vocabulary("byte_bpe_50k.json"), 64).collect()
    check_packing(odd.rows, packed, 64)


def test_packing_of_nothing(spark, odd):
    assert packing.pack(odd([]), tokens.vocabulary("byte_bpe_50k.json")).count() == 0


def test_plan_is_best_fit_decreasing():
    draw = random.Random(5)
    for _ in range(20):
        lengths = [draw.choice([3, 5, 9, 17, 30, 50, 64]) for _ in range(200)]
        slots = packing.plan(Counter(lengths), 64)
        bins, where = [], Counter()
        for length in sorted(lengths, reverse=True):  # one document at a time
            fit = [b for b in bins if b >= length]
            if fit:
                bins.remove(min(fit))
                bins.append(min(fit) - length)
            else:
                bins.append(64 - length)
        used = set()
        for length, low, high, each, first, offset in slots:
            for rank in range(low, high):
                used.add(first + (rank - low) // each)
                where[length] += 1
        assert where == Counter(lengths) and len(used) == len(bins)


def test_token_files(spark, odd, tmp_path):
    rows = odd.rows + docs_of(spark)
    at = str(tmp_path / "files")
    token_files.write(odd(rows), at, tokens.vocabulary("word_bpe_49k.json"))
    got = token_files.read(spark, at, keep_ids=True).collect()
    want = Counter((doc, tuple(ids + [1])) for (doc, _), ids in zip(rows, library("word_bpe_49k.json", [t for _, t in rows])))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_token_files_of_nothing(spark, odd, tmp_path):
    token_files.write(odd([]), str(tmp_path / "none"), tokens.vocabulary("word_bpe_49k.json"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=0, max_size=700), st.integers(41, 5000), st.integers(1, 60))
def test_coder_round_trip(ids, alphabet, times):
    ids = np.array(ids * times, np.uint32) % alphabet
    record = coder.write_record(np.array([3]), np.array([True]), np.array([len(ids)]), ids, 11, alphabet)
    assert np.array_equal(coder.read_record(record)[3], ids)


def thue_morse(a, b, doublings=10):
    x = a
    for _ in range(doublings):
        x, a, b = x + b, a + b, b + a
    return x


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_that_fool_polynomials_keep_their_ids(name):
    texts = [f"{thue_morse('a', 'b')} end", f"{thue_morse('b', 'a')} end", thue_morse("ab", "cd", 4) + " x", thue_morse("cd", "ab", 4) + " x"]
    ids, counts = tokens.encoder(tokens.vocabulary(name)).encode(flat(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library(name, texts)


def test_units_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens.Texts, "hashes", lambda self, starts, ends, seed=0: np.zeros(len(starts), np.uint64))
    own = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    for text in ("alpha beta gamma alpha.", "beta beta, delta"):
        assert own.encode(flat(pa.array([text])))[0].tolist() == library("byte_bpe_50k.json", [text])[0]


def test_coder_beats_static_counts_on_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids, _ = tokens.encoder(tokens.vocabulary("word_bpe_49k.json")).encode(flat(pa.array(texts)))
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    code = coder.encode_block(ids, 49408)
    assert np.array_equal(coder.decode_block(code, len(ids), 49408), ids)
    assert len(code) * 8 / len(ids) < entropy - 0.3  # its own counts are not among the static figure's costs, contexts are


def test_coder_cuts_long_input_into_blocks(monkeypatch):
    monkeypatch.setattr(coder, "BLOCK", 1000)
    ids = np.random.default_rng(1).integers(0, 300, 4321).astype(np.uint32)
    record = coder.write_record(np.array([1]), np.array([True]), np.array([4321]), ids, 5, 300)
    assert np.array_equal(coder.read_record(record)[3], ids)


def test_coder_carries_and_extremes():
    for alphabet in (1, 2, 1 << 17):
        for ids in (np.zeros(5000, np.uint32), np.full(5000, alphabet - 1, np.uint32), np.arange(5000, dtype=np.uint32) % alphabet):
            assert np.array_equal(coder.decode_block(coder.encode_block(ids, alphabet), 5000, alphabet), ids)


def test_coder_uses_what_repeats():
    draw = np.random.default_rng(0)
    ids = np.tile(draw.integers(0, 40_000, 900), 18).astype(np.uint32)
    record = coder.write_record(np.array([1]), np.array([True]), np.array([len(ids)]), ids, 0, 49408)
    assert len(record) < len(ids) * 2 / 6


def test_damage_is_noticed():
    ids = np.arange(3000, dtype=np.uint32)
    record = bytearray(coder.write_record(np.array([1]), np.array([True]), np.array([3000]), ids, 0, 49408))
    for at in (9, len(record) // 2, len(record) - 3):
        broken = bytearray(record)
        broken[at] ^= 0x10
        with pytest.raises((ValueError, IndexError, OverflowError)):
            coder.read_record(bytes(broken))


def test_pages_of_parquet_hold_whole_records(spark, tmp_path, odd):
    token_files.write(odd([(1, "a b")]), str(tmp_path / "one"), tokens.vocabulary("word_bpe_49k.json"))
    assert pq.read_table(tmp_path / "one").to_pylist()[0]["record"][:4] == coder.MAGIC
