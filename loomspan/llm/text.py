"""Vectorised views of a batch of texts: bytes, words and their hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4_000_000
#: Odd multiplier of the polynomial hashes of word sequences (fixed value), and the prime of their second kind.
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
PRIME, PRIME_BASE = (1 << 31) - 1, 0x4F1BBCDD
#: Words up to so many bytes are hashed eight bytes at a time, all words at once; longer ones one by one.
SHORT = 64

#: The contracts' white space: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse modulo 2^64 for i < n."""
    up = np.full(n, np.uint64(base))
    down = np.full(n, np.uint64(pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(int(base), 1 << max(12, (n - 1).bit_length()))


def windows(values: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial (Rabin-Karp) hash of values[start:end] for each pair, by prefix sums modulo 2^64. The values should be
    hashes themselves: of small numbers, polynomials modulo a power of two can be made to agree."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


@lru_cache(maxsize=2)
def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME_BASE^i and its inverse modulo PRIME for i < n, by doubling."""
    out = []
    for base in (PRIME_BASE, pow(PRIME_BASE, -1, PRIME)):
        powers_of = np.ones(1, np.uint64)
        while len(powers_of) < n:
            powers_of = np.concatenate([powers_of, powers_of * np.uint64(pow(base, len(powers_of), PRIME)) % np.uint64(PRIME)])
        out.append(powers_of)
    return out[0], out[1]


def prime_windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As windows(), modulo a prime: two different windows of n values agree in at most n of 2^31 bases."""
    up, down = _prime_powers(1 << max(12, len(values).bit_length()))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values % np.uint64(PRIME) * up[: len(values)] % np.uint64(PRIME), out=sums[1:])
    return (sums[ends] - sums[starts]) % np.uint64(PRIME) * down[starts] % np.uint64(PRIME)


#: Keeps the first n bytes of a little-endian number of eight.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Texts:
    """A slice of a string column as bytes: document i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._eights: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, kind: np.ndarray = SPACE, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes that are not of `kind`, and each document's first word (n + 1).

        Runs are also cut before the places at which `cut`, if given, is true."""
        n = len(self.data)
        gap = np.ones(n + 1, bool)
        gap[:n] = kind[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        if cut is not None:
            first[:n] |= cut
        solid = ~gap[:n]
        before = np.ones(n, bool)
        before[1:] = gap[: n - 1]
        starts = np.flatnonzero(solid & (before | first[:n]))
        ends = np.flatnonzero(solid & (gap[1:] | first[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def eight(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on as a little-endian number; bytes from `left` on (1 or more) count as zero."""
        if self._eights is None:
            padded = np.zeros((len(self.data) // 8 + 3) * 8, np.uint8)
            padded[: len(self.data)] = self.data
            self._eights = padded.view("<u8")
        place, shift = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        low, high = self._eights[place] >> shift, self._eights[place + 1]
        return (low | high << np.uint64(1) << (np.uint64(63) - shift)) & KEEP[np.minimum(left, 8)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of the bytes of each range; hashes by other seeds are independent of it.

        Up to SHORT bytes, eight at a time go through a bijective mixer; longer ranges are hashed by XXH3."""
        size = ends - starts
        out = mix(size.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))
        some: np.ndarray | slice = slice(None)
        for k in range(0, SHORT, 8):
            if k:
                some = np.flatnonzero((size > k) & (size <= SHORT))
                if not len(some):
                    break
            out[some] = mix(out[some] ^ self.eight(starts[some] + k, size[some] - k))
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[starts[i] : ends[i]], seed + 1)
        return out


def flat(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Null texts are empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch | pa.Table, Texts]]:
    """Parts of a batch with about `most` bytes of text each; a longer text is a part of its own."""
    all_texts = flat(batch[column] if isinstance(batch, pa.Table) else batch.column(column))
    at = all_texts.offsets
    i = 0
    while i < len(all_texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), Texts(all_texts.data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j
    del all_texts, at
    pa.default_memory_pool().release_unused()  # or it stays with the worker


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
