"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A first pass over the corpus counts the words of the test items, their triples, and their word pairs where no triple covers
them. Seeds are all triples that the corpus has and the rarest pairs: those which together occur so, outside triples, at most
PAIR_HITS times for each document. A second pass looks the seeds up
in the documents (a hash join whose small side, a block of test items, is held by every task) and takes the passage around
each, wide enough for any alignment that could count. A passage that lacks the words for the least score is left out; the
others are aligned with the item (match 2, mismatch and gap -1). A document holds an item if an alignment has at least half
of the item's own score.

A seed that many items share, like a phrase of questions, is taken for an item only where enough of its rare words stand within
the passage too: an alignment that counts matches at least half of the item's words, so a quarter of all among any three
quarters of them, and these are the ones rarest in the corpus. Passages are laid out after that, so a shared phrase costs no
pair of its own.

So nothing is lost but alignments without a seed: those in which no three item words stand together and all pairs that do
are frequent in the corpus. An alignment of an m-word item with score s has at least s - m - 1 intact pairs; one without
any scores at most m + 1 and takes a strange word after every single one.

The test items travel to the tasks in blocks of bounded size; a larger benchmark takes more passes, never a larger block.

Words: runs of bytes other than ASCII white space and punctuation, A-Z in lower case. Edge cases: null and empty texts and
items have no words and match nothing; items under three words are one n-gram; repeated items and documents give a row
each; a null doc_id or item_id stays null; empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, texts
from .text import LOWER, WORD_BASE, Texts, flat, mix, slices, spread, windows

GRAM, PAIR, MATCH, LOSS, SCORE = 3, 2, 2, 1, 0.5
#: Pairs are seeds from the rarest one on, until they occur outside triples so many times for each document.
PAIR_HITS = 4
#: Characters of test items that are sent to the tasks at once.
BLOCK_CHARS = 8_000_000
BETWEEN = np.zeros(256, bool)
BETWEEN[[i for i in range(128) if not chr(i).isalnum()]] = True
#: A seed of more items than this is joined with its items' rare words first, so many pairs at a time.
CROWD, PAIRS = 16, 1 << 21
FILTER_BITS, SLICE = 22, 1_000_000
HITS = "array<struct<item_id: long, score: double, first_word: int, end_word: int>>"


def _words(batch: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each document's first one."""
    low = Texts(LOWER[batch.data], batch.offsets)
    starts, ends, first = low.words(BETWEEN)
    return low.hashes(starts, ends), first


def _grams(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams and the word at which each starts; texts under `width` words are one gram."""
    counts = np.diff(first)
    grams = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(first[:-1], grams) + spread(grams)
    end = np.minimum(at + width, np.repeat(first[1:], grams))
    return mix(windows(words, WORD_BASE, at, end)) if len(at) else np.zeros(0, np.uint64), at


class Lookup:
    """Places of hashes in a sorted array, behind a bitmap that most absent ones do not pass."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[self._at(keys)] = True

    @staticmethod
    def _at(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are there, and where in keys."""
        near = np.flatnonzero(self.bits[self._at(hashes)]) if len(self.keys) else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
        hit = self.keys[place] == hashes[near] if len(near) else near.astype(bool)
        return near[hit], place[hit]


def _both(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triples and, of texts of three words or more, pairs: hashes and the words at which they start."""
    grams, at = _grams(words, first, GRAM)
    counts = np.diff(first)
    own = np.where(counts >= GRAM, counts - 1, 0)
    start = np.repeat(first[:-1], own) + spread(own)
    pairs = mix(windows(words, WORD_BASE, start, start + PAIR)) if len(start) else np.zeros(0, np.uint64)
    return np.concatenate([grams, pairs]), np.concatenate([at, start])


class Items:
    """A block of test items: word hashes, n-grams, and, once chosen, seeds by hash."""

    def __init__(self, ids: list[int | None], item_texts: list[str | None]):
        self.ids = ids
        self.words, self.first = _words(flat(pa.array(item_texts, pa.string())))
        self.size = np.diff(self.first)
        self.grams, self.at = _both(self.words, self.first)
        self.triples = len(_grams(self.words, self.first, GRAM)[0])
        self.distinct, self.distinct_words = np.unique(self.grams), np.unique(self.words)
        item = np.repeat(np.arange(len(ids)), self.size)
        self.members = np.unique(self.member(item, self.words))

    @staticmethod
    def member(item: np.ndarray, words: np.ndarray) -> np.ndarray:
        """A hash of (item, word)."""
        return mix(words ^ mix(item.astype(np.uint64) + np.uint64(1)))

    def choose(self, counts: np.ndarray, documents: int, word_counts: np.ndarray, least: float) -> None:
        """Seeds and rare words, given how often the corpus has each distinct gram and word."""
        item = np.searchsorted(self.first, self.at, "right") - 1
        times = counts[np.searchsorted(self.distinct, self.grams)]
        pairs = np.arange(len(self.grams)) >= self.triples
        kinds, sample = np.unique(self.grams[pairs], return_index=True)
        often = times[pairs][sample]
        order = np.lexsort((kinds, often))
        rare = kinds[order][np.cumsum(often[order]) <= PAIR_HITS * documents]
        seeds = np.flatnonzero(np.where(pairs, np.isin(self.grams, rare), times > 0))
        order = seeds[np.argsort(self.grams[seeds], kind="stable")]
        self.seed_keys, self.seed_first = np.unique(self.grams[order], return_index=True)
        self.seed_item, self.seed_word = item[order], self.at[order] - self.first[item[order]]
        self.seed_first = np.append(self.seed_first, len(order))
        self.slack = np.maximum(4, np.ceil(self.size * (2 - 2 * least)).astype(np.int64))
        self.codes = np.repeat(np.arange(len(self.seed_keys)), np.diff(self.seed_first)) * max(1, len(self.ids)) + self.seed_item  # ascending
        crowded = np.unique(self.seed_item[np.repeat(np.diff(self.seed_first) > CROWD, np.diff(self.seed_first))])
        self.reach = int((self.size + self.slack)[crowded].max(initial=0))
        owner = np.repeat(np.arange(len(self.ids)), self.size)
        times = word_counts[np.searchsorted(self.distinct_words, self.words)]
        order = np.lexsort((times, owner))
        missing = self.size - np.ceil(least * self.size - 1e-9).astype(np.int64)  # words that need not match
        taken = np.minimum(self.size, missing + np.maximum(1, self.size // 4))
        self.needed = taken - missing
        rare = order[spread(self.size) < np.repeat(taken, self.size)]
        rare = rare[np.isin(owner[rare], crowded)]
        both = np.unique(np.stack([self.words[rare], owner[rare].astype(np.uint64)], 1), axis=0) if len(rare) else np.zeros((0, 2), np.uint64)
        self.rare_keys, self.rare_first = np.unique(both[:, 0], return_index=True)
        self.rare_first, self.rare_item = np.append(self.rare_first, len(both)), both[:, 1].astype(np.int64)


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each pair and the passage word after the best alignment, all pairs at once."""
    n, m, k = len(items), max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((n, m), np.uint64), np.zeros((n, k), np.uint64)
    solid_a, solid_b = np.zeros((n, m), bool), np.zeros((n, k), bool)
    for i, (x, y) in enumerate(zip(items, passages)):
        a[i, : len(x)], b[i, : len(y)], solid_a[i, : len(x)], solid_b[i, : len(y)] = x, y, True, True
    row, best, end = np.zeros((n, k + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    slope = LOSS * np.arange(k + 1, dtype=np.int32)
    for j in range(m):
        step = np.where((a[:, j, None] == b) & solid_b & solid_a[:, j, None], MATCH, -LOSS)
        new = np.zeros_like(row)
        np.maximum(row[:, :-1] + step, row[:, 1:] - LOSS, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        top = row.argmax(1)
        score = row[np.arange(n), top]
        better = score > best
        best[better], end[better] = score[better], top[better]
    return best, end


def _seeds(items: Items, words: np.ndarray, first: np.ndarray, lookup: Lookup) -> tuple[np.ndarray, ...]:
    """(document, item, word, item's word) of the seeds; those that many items share only where as many rare words of the item
    are near as an alignment that counts must match."""
    grams, at = _both(words, first)
    hit, key = lookup.find(grams)
    each = items.seed_first[key + 1] - items.seed_first[key]
    few = each <= CROWD
    seed = np.repeat(items.seed_first[key[few]], each[few]) + spread(each[few])
    word = np.repeat(at[hit[few]], each[few])
    parts = [(seed, word)]
    place, key = at[hit[~few]], key[~few]
    if len(place):
        near, rare = Lookup(items.rare_keys).find(words)
        many = items.rare_first[rare + 1] - items.rare_first[rare]
        rare_word = np.repeat(near, many)
        rare_item = items.rare_item[np.repeat(items.rare_first[rare], many) + spread(many)]
        doc = np.searchsorted(first, place, "right") - 1
        begin = np.searchsorted(rare_word, np.maximum(place - items.reach, first[doc]))
        end = np.searchsorted(rare_word, np.minimum(place + items.reach, first[doc + 1]))
        sums = np.append(0, np.cumsum(end - begin))
        i = 0
        while i < len(place):
            j = max(i + 1, min(i + PAIRS // len(items.ids), int(np.searchsorted(sums, sums[i] + PAIRS, "right")) - 1))
            n = end[i:j] - begin[i:j]
            other, here = np.repeat(begin[i:j], n) + spread(n), np.repeat(np.arange(i, j), n)
            pair = (here - i) * len(items.ids) + rare_item[other]
            enough = np.bincount(pair, minlength=1)[pair] >= items.needed[rare_item[other]]
            other, here = other[enough], here[enough]
            code = key[here] * len(items.ids) + rare_item[other]
            own = np.searchsorted(items.codes, code)
            has = items.codes[np.minimum(own, len(items.codes) - 1)] == code
            own, other, spot = own[has], other[has], place[here[has]]
            copies = np.searchsorted(items.codes, code[has], "right") - own  # an item may have a seed several times
            own, other, spot = np.repeat(own, copies) + spread(copies), np.repeat(other, copies), np.repeat(spot, copies)
            ends = spot - items.seed_word[own]
            size, slack = items.size[items.seed_item[own]], items.slack[items.seed_item[own]]
            inside = (rare_word[other] >= ends - slack) & (rare_word[other] < ends + size + slack)
            found, times = np.unique(own[inside] * (len(words) + 1) + spot[inside], return_counts=True)
            own, spot = np.divmod(found, len(words) + 1)
            keep = times >= items.needed[items.seed_item[own]]
            parts.append((own[keep], spot[keep]))
            i = j
    seed, word = (np.concatenate(x) for x in zip(*parts))
    return np.searchsorted(first, word, "right") - 1, items.seed_item[seed], word, items.seed_word[seed]


def _passages(items: Items, words: np.ndarray, first: np.ndarray, lookup: Lookup, least: float) -> tuple[np.ndarray, ...]:
    """(document, item, from, to): the word ranges around seeds, those of one item in one document merged, and long ones in
    overlapping pieces, so that an alignment's memory is bounded by its item.

    An alignment that counts has at most (2 - 2 least) item lengths of inserted words, so it lies within its seed's range,
    and within a piece."""
    doc, item, word, offset = _seeds(items, words, first, lookup)
    size, slack = items.size[item], items.slack[item]
    lo = np.maximum(word - offset - slack, first[doc])
    hi = np.minimum(word - offset + size + slack, first[doc + 1])
    order = np.lexsort((lo, item, doc))
    doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]  # of one item in one document, hi ascends with lo
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
    begin = np.flatnonzero(new)
    doc, item, lo, hi = doc[begin], item[begin], lo[begin], hi[np.append(begin[1:], len(hi)) - 1] if len(hi) else hi
    size = items.size[item]
    span, step = 6 * size + 64, 3 * size + 48
    pieces = 1 + np.maximum(0, -(-(hi - lo - span) // step))
    own = np.repeat(np.arange(len(doc)), pieces)
    start = lo[own] + step[own] * spread(pieces)
    return doc[own], item[own], start, np.minimum(start + span[own], hi[own])


def _worthwhile(items: Items, words: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float) -> np.ndarray:
    """Which passages have as many of their item's words as the least score takes."""
    out = np.zeros(len(item), bool)
    for i in range(0, len(item), 1 << 11):
        part = slice(i, i + (1 << 11))
        n = hi[part] - lo[part]
        keys = items.member(np.repeat(item[part], n), words[np.repeat(lo[part], n) + spread(n)])
        place = np.minimum(np.searchsorted(items.members, keys), len(items.members) - 1)
        has = np.append(0, np.cumsum(items.members[place] == keys))
        ends = np.cumsum(n)
        out[part] = has[ends] - has[ends - n] >= least * items.size[item[part]]
    return out


def matches(items: Items, lookup: Lookup, batch: Texts, least: float) -> list[list[dict]]:
    """For each document the items that it holds, with the best passage of each."""
    words, first = _words(batch)
    rows = _passages(items, words, first, lookup, least)
    keep = _worthwhile(items, words, *rows[1:], least)
    found = list(zip(*(x[keep].tolist() for x in rows)))
    best: list[dict[int, tuple]] = [{} for _ in range(len(batch))]
    found.sort(key=lambda x: (items.size[x[1]], x[3] - x[2]))  # like sizes side by side
    for i in range(0, len(found), 256):
        part = found[i : i + 256]
        own = [items.words[items.first[x[1]] : items.first[x[1] + 1]] for x in part]
        scores, ends = align(own, [words[x[2] : x[3]] for x in part])
        for (doc, item, lo, _), item_words, score, end in zip(part, own, scores.tolist(), ends.tolist()):
            full = score / (MATCH * len(item_words))
            at = lo - int(first[doc]) + end
            if full >= least and (full, -at) > best[doc].get(item, (-1, 0)):
                best[doc][item] = (full, -at)
    return [[{"item_id": items.ids[i], "score": s, "first_word": max(0, -at - int(items.first[i + 1] - items.first[i])), "end_word": -at} for i, (s, at) in sorted(x.items())] for x in best]


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    for i in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()  # of bounded size
        if rows:
            yield Items([r.item_id for r in rows], [r.text for r in rows])


def _uncovered(lookup: Lookup, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places in the lookup of the triples that a batch has, and of the pairs that are not within one of those."""
    grams, at = _both(words, first)
    hit, place = lookup.find(grams)
    pair = hit >= len(_grams(words, first, GRAM)[1])
    covered = np.zeros(len(words) + GRAM, bool)
    begins = at[hit[~pair]]
    covered[begins] = covered[begins + 1] = True
    return place[~pair | ~covered[at[hit]]]


def _count(docs: DataFrame, items: Items) -> tuple[np.ndarray, int, np.ndarray]:
    """How often the corpus has each distinct gram of the items, its number of documents, and how often it has each word."""
    keys = docs.sparkSession.sparkContext.broadcast((items.distinct, items.distinct_words))
    grams, total = len(items.distinct), len(items.distinct) + len(items.distinct_words) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, single, counts = Lookup(keys.value[0]), Lookup(keys.value[1]), np.zeros(total, np.int64)
        for batch in batches:
            counts[-1] += batch.num_rows
            for _, batch_texts in slices(batch, most=SLICE):
                words, first = _words(batch_texts)
                counts[:grams] += np.bincount(_uncovered(lookup, words, first), minlength=grams)
                counts[grams:-1] += np.bincount(single.find(words)[1], minlength=total - 1 - grams)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["gram", "n"])

    counts = np.zeros(total, np.int64)
    found = texts(docs).select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # a row for each gram and word of the block
    counts[found["gram"].to_numpy()] = found["n"].to_numpy()
    return counts[:grams], int(counts[-1]), counts[grams:-1]


def finders(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> Iterator[Column]:
    """For each block of test items, a column over docs.text: the items that a text holds."""
    small_batches(docs.sparkSession)
    for items in _blocks(benchmark):
        items.choose(*_count(docs, items), least)
        sent = docs.sparkSession.sparkContext.broadcast(items)

        @F.arrow_udf(HITS)
        def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = sent.value
            lookup = Lookup(own.seed_keys)
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())]))
            for batch in batches:
                rows = [x for _, part in slices(pa.table({"text": batch}), most=SLICE) for x in matches(own, lookup, part, least)]
                yield pa.array(rows, kind)

        yield find(docs["text"])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """doc_id, item_id, score (1: a whole copy) and the passage's words, for every test item that a document holds."""
    own = texts(docs)
    out = own.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word int, end_word int")
    for found in finders(own, benchmark, least):
        out = out.union(own.select("doc_id", F.explode(found).alias("hit")).select("doc_id", "hit.*"))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """The documents that hold no test item, in all their columns."""
    for found in finders(docs, benchmark, least):
        docs = docs.where(F.size(found) == 0)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
