"""Token ids of whole texts by the tokenizers library, with a bounded store of the ids of words.

Both tokenizers cut a text at spaces, and between ASCII letters, digits and marks, before they merge, so a text's ids are
the ids of the units between such cuts. A task asks the library for the units that it has not met and looks the others up.
Texts in which a cut at spaces could differ (for the byte-level one: white space beside other white space or at the end, or
white space outside ASCII) go to the library whole. A looked-up unit is compared with the stored one in all its bytes.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np

from .text import LOWER, SHORT, Texts, spread

#: Units kept by a Python worker, about 0.1 GB; when there are more, it starts anew.
STORE = 1 << 20
#: Units that the library is asked for at once.
ASKED = 1 << 12
#: Bytes between units: space and new line.
BREAKS = np.zeros(256, bool)
BREAKS[[0x20, 0x0A]] = True
#: ASCII letters, digits and marks (1, 2, 3); 0: all else, and the apostrophe, which joins letters to units like 's.
KIND = np.zeros(256, np.uint8)
KIND[[i for i in range(0x21, 0x7F) if i != 0x27]] = 3
KIND[[i for i in range(128) if chr(i).isalpha()]] = 1
KIND[[i for i in range(128) if chr(i).isdigit()]] = 2
SEED = 8


def _cuts(digits: bool) -> np.ndarray:
    """Whether there is a cut between two kinds, and, if asked for, between digits."""
    a, b = np.divmod(np.arange(16), 4)
    return (a > 0) & (b > 0) & ((a != b) | (a == 2) & digits)


def vocabulary(name: str) -> str:
    """Where the file of a public tokenizer is. It is a parameter of every operator here and never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _joined_spaces(batch: Texts) -> np.ndarray:
    """Documents in which a space of any kind meets another, or that hold white space outside ASCII."""
    d = batch.data
    after, third = np.append(d[1:], [0]).astype(np.uint8), np.append(d[2:], [0, 0])[: len(d)].astype(np.uint8)
    plain = np.zeros(256, bool)
    plain[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
    odd = plain[d] & plain[after]
    high = d >= 0xC2
    if high.any():
        odd |= (d == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (d == 0xE1) & (after == 0x9A)
        odd |= (d == 0xE2) & ((after == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)) | (after == 0x81) & (third == 0x9F))
        odd |= (d == 0xE3) & (after == 0x80) & (third == 0x80)
    found = np.zeros(len(batch) + 1, bool)
    found[np.searchsorted(batch.offsets, np.flatnonzero(odd), "right") - 1] = True
    return found[:-1]


class Store:
    """Ids of units of up to SHORT bytes: an open-addressing table by the units' hashes, probed for a whole batch at once.
    What it finds it compares byte by byte, eight at a time, with the unit it holds."""

    def __init__(self, units: int = STORE):
        self.keys, self.slots = np.zeros(1 << (2 * units - 1).bit_length(), np.uint64), np.zeros(1 << (2 * units - 1).bit_length(), np.int32)
        self.starts, self.lens, self.ids = np.zeros(units, np.int32), np.zeros(units, np.int32), np.zeros(4 * units, np.uint32)
        self.places, self.sizes, self.held = np.zeros(units, np.int32), np.zeros(units, np.int8), np.zeros(2 * units, np.uint64)
        self.n = self.used = self.filled = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        at = hashes & mask
        seen = self.keys[at]
        found = np.where(seen == hashes, self.slots[at], np.int32(-1))
        left = np.flatnonzero((seen != hashes) & (seen != 0))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & mask
            seen = self.keys[at[left]]
            hit = seen == hashes[left]
            found[left[hit]] = self.slots[at[left[hit]]]
            left = left[~hit & (seen != 0)]
        return found

    def same(self, slots: np.ndarray, batch: Texts, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each slot holds this very unit."""
        ok = self.sizes[slots] == sizes
        some: np.ndarray | slice = slice(None)
        for k in range(0, SHORT, 8):
            if k:
                some = np.flatnonzero((sizes > k) & ok)
                if not len(some):
                    break
            ok[some] &= batch.eight(starts[some] + k, np.maximum(sizes[some] - k, 1)) == self.held[self.places[slots[some]] + k // 8]
        return ok

    def add(self, hashes: np.ndarray, ids: np.ndarray, lens: np.ndarray, batch: Texts, starts: np.ndarray, sizes: np.ndarray) -> None:
        """New units with distinct hashes. There must be room()."""
        n, k = self.n, len(hashes)
        eights = -(-sizes // 8)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + len(ids)))
        if self.filled + eights.sum() > len(self.held):
            self.held = np.resize(self.held, max(2 * len(self.held), self.filled + int(eights.sum())))
        self.lens[n : n + k], self.sizes[n : n + k] = lens, sizes
        self.starts[n : n + k] = self.used + np.cumsum(lens) - lens
        self.places[n : n + k] = self.filled + np.cumsum(eights) - eights
        self.ids[self.used : self.used + len(ids)] = ids
        unit, nth = np.repeat(np.arange(k), eights), spread(eights)
        self.held[self.filled : self.filled + len(unit)] = batch.eight(starts[unit] + 8 * nth, sizes[unit] - 8 * nth)
        self.n, self.used, self.filled = n + k, self.used + len(ids), self.filled + len(unit)
        mask, slot = np.uint64(len(self.keys) - 1), np.arange(n, n + k, dtype=np.int32)
        at = hashes & mask
        left = np.arange(k)
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]], self.slots[at[free]] = hashes[free], slot[free]  # of several at one place, the last stays
            left = left[self.keys[at[left]] != hashes[left]]
            at[left] = (at[left] + np.uint64(1)) & mask

    def room(self, k: int) -> bool:
        return self.n + k <= len(self.lens)


class Encoder:
    """Ids of batches of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.byte_level = self.tokenizer.normalizer is None  # else it drops white space and case
        self.cuts = _cuts(digits=not self.byte_level)
        self.store = Store()

    def ask(self, batch: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of units, and how many each has."""
        ids, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(starts), ASKED):  # the library's results take far more room than the ids
            units = [self._raw(batch, a, b).decode() for a, b in zip(starts[i : i + ASKED].tolist(), ends[i : i + ASKED].tolist())]
            own = [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            lens.append(np.fromiter(map(len, own), np.int64, len(own)))
            ids.append(np.fromiter(chain.from_iterable(own), np.uint32, int(lens[-1].sum())))
        return np.concatenate(ids), np.concatenate(lens)

    @staticmethod
    def _raw(batch: Texts, a: int, b: int) -> bytes:
        return batch.data[a:b].tobytes()

    def _units(self, batch: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units, each document's first one, and the documents that must be encoded whole."""
        kind = KIND[batch.data]
        cut = np.zeros(len(kind), bool)
        cut[1:] = self.cuts[kind[:-1] * np.uint8(4) + kind[1:]]
        starts, ends, first = batch.words(BREAKS, cut)
        if not self.byte_level:
            return starts, ends, first, np.zeros(len(batch), bool)
        at = batch.offsets
        whole = _joined_spaces(batch)
        full = np.flatnonzero(np.diff(at))
        whole[full] |= BREAKS[batch.data[at[full + 1] - 1]]
        if whole.any():
            keep = ~np.repeat(whole, np.diff(first))
            first = np.append(0, np.cumsum(np.where(whole, 0, np.diff(first))))
            starts, ends = starts[keep], ends[keep]
        lead = starts > np.repeat(at[:-1], np.diff(first))
        lead[lead] = BREAKS[batch.data[starts[lead] - 1]]
        return starts - lead, ends, first, whole  # a unit has the white space before it

    def _known(self, batch: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each unit; -1 for those that the store can't hold: longer than SHORT, or with another unit's hash."""
        sizes = ends - starts
        slots = np.full(len(starts), -1, np.int32)
        short = np.flatnonzero(sizes <= SHORT)
        if not len(short):
            return slots
        starts, ends, sizes = starts[short], ends[short], sizes[short]
        hashes = batch.hashes(starts, ends, SEED) | np.uint64(1)
        own = self.store.find(hashes)
        new, sample = np.unique(hashes[own < 0], return_index=True)
        if len(new):
            if not self.store.room(len(new)):
                self.store = Store(max(STORE, len(new)))
                own[:] = -1
                new, sample = np.unique(hashes, return_index=True)
                if not self.store.room(len(new)):
                    self.store = Store(len(new))
            missing = np.flatnonzero(own < 0)
            pick = missing[sample]
            self.store.add(new, *self.ask(batch, starts[pick], ends[pick]), batch, starts[pick], sizes[pick])
            own[missing] = self.store.find(hashes[missing])
        own[~self.store.same(own, batch, starts, sizes)] = -1
        slots[short] = own
        return slots

    def encode(self, batch: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, and how many each document has."""
        if not self.byte_level:
            batch = Texts(LOWER[batch.data], batch.offsets)  # as the library does
        starts, ends, first, whole = self._units(batch)
        slots = self._known(batch, starts, ends)
        store, other = self.store, np.flatnonzero(slots < 0)
        begins, lens = store.starts[slots].astype(np.int64), store.lens[slots].astype(np.int64)
        ids = store.ids
        if len(other):
            more, lens[other] = self.ask(batch, starts[other], ends[other])
            begins[other] = store.used + np.cumsum(lens[other]) - lens[other]
            ids = np.concatenate([ids[: store.used], more])
        last = np.cumsum(lens)
        ids = ids[np.repeat(begins - last + lens, lens) + np.arange(last[-1] if len(last) else 0)]
        counts = np.diff(np.append(0, last)[first])
        odd = np.flatnonzero(whole)
        if len(odd):
            parts, at = np.split(ids, np.cumsum(counts)[:-1]), batch.offsets
            for i in odd.tolist():
                parts[i] = np.array(self.tokenizer.encode(batch.data[at[i] : at[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its store lasts from batch to batch and from task to task."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids and then id `end`."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
