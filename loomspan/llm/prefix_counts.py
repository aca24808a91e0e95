"""Exact token counts at every prefix of a text, by dynamic programming over the pieces of a sentencepiece BPE model.

The ids of a prefix are the ids of a shorter prefix and one last piece, and of all pieces that end there just one can follow:
the one whose border with the piece before is crossed by no merge that comes before both are complete. So one pass from
left to right finds each prefix's last piece and its number of tokens, and no prefix is ever encoded.

A text is cut where no piece can cross, before spaces and between characters that stand beside each other in no piece; the
counts of such units (of up to SHORT bytes) are kept from batch to batch. Long units go through the same pass in lanes that
start some characters early; a lane holds if it agrees with the one before it over the longest piece, else both are joined.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .text import SHORT, Texts, spread
from .tokens import Store

SPACE_MARK = 0x2581  #: stands for a space in the pieces (fixed value)
MARK_BYTES = (0xE2, 0x96, 0x81)
SEED = 11
#: Characters that go through a pass at once, characters of a lane, and how many earlier it starts.
PASS_CHARS, LANE, EARLY = 1 << 16, 512, 64
NONE = np.int32(-1)
LAST = np.int64(1) << 40  #: a rank after all others


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the place of each one's first byte."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(data)))
    lead = data[at].astype(np.int64)
    out = np.where(size == 1, lead, lead & (0x7F >> size))
    for k in range(1, 4):
        some = np.flatnonzero(size > k)
        out[some] = out[some] << 6 | data[at[some] + k] & 0x3F
    return out, at


class Pieces:
    """The model's pieces as a trie, and each piece's last merge. Symbols are characters: those of the vocabulary by their
    piece, others by len(pieces) + code point; the latter cost as many tokens as they have bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in ids]
        self.n = n = len(pieces)
        order = sorted({model.get_score(i) for i in ids}, reverse=True)
        by_score = {s: r for r, s in enumerate(order)}
        known = {p: k for k, p in enumerate(pieces)}
        rank = {p: by_score[model.get_score(i)] for i, p in zip(ids, pieces)}
        self.single = {ord(p): k for k, p in enumerate(pieces) if len(p) == 1}
        self.ranks = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, NONE), np.full(n, NONE)
        whole = np.ones(n, bool)
        for p, k in known.items():
            if len(p) > 1:
                split = _last_merge(p, rank)
                whole[k] = split is not None
                if split:
                    self.ranks[k] = rank[p]
                    self.left[k], self.right[k] = (self.symbol(p[:split]) if split == 1 else known[p[:split]], self.symbol(p[split:]) if split == len(p) - 1 else known[p[split:]])
        own = {p: k for p, k in known.items() if whole[k]}
        self.longest = max(map(len, own), default=1)
        self.met: dict[int, bool] = {}
        self._trie(own)
        self._merges(known, rank)
        self.joined = np.ones((129, 129), bool)  # whether two characters stand beside each other in a piece; 128: not ASCII
        self.joined[:128, :128] = False
        for p in own:
            for a, b in zip(p, p[1:]):
                a, b = (0x20 if x == chr(SPACE_MARK) else min(ord(x), 128) for x in (a, b))
                self.joined[a, b] = True

    def symbol(self, char: str) -> int:
        return self.single.get(ord(char), self.n + ord(char))

    def symbols(self, points: np.ndarray) -> np.ndarray:
        keys = np.array(sorted(self.single), np.int64)
        values = np.array([self.single[k] for k in keys.tolist()], np.int64)
        at = np.minimum(np.searchsorted(keys, points), len(keys) - 1)
        return np.where(keys[at] == points, values[at], self.n + points)

    def _trie(self, own: dict[str, int]) -> None:
        """Edges (node, code point) -> node in ascending order, and the piece that ends at each node."""
        edges: dict[int, int] = {}
        ends = [-1]
        for p, k in own.items():
            at = 0
            for c in p:
                key = at << 21 | ord(c)
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                at = edges[key]
            ends[at] = k
        self.edges = np.array(sorted(edges), np.int64)
        self.nodes = np.array([edges[k] for k in self.edges.tolist()], np.int64)
        self.ends = np.array(ends, np.int32)

    def _merges(self, known: dict[str, int], rank: dict[str, int]) -> None:
        """All (left, right) symbols whose joined text is a piece, ascending, and that piece's rank."""
        found: dict[int, int] = {}
        for p in known:
            for i in range(1, len(p)):
                a, b = p[:i], p[i:]
                if (i == 1 or a in known) and (i == len(p) - 1 or b in known):
                    left = self.symbol(a) if i == 1 else known[a]
                    right = self.symbol(b) if i == len(p) - 1 else known[b]
                    found[left << 22 | right] = rank[p]
        self.pairs = np.array(sorted(found), np.int64)
        self.pair_ranks = np.array([found[k] for k in self.pairs.tolist()], np.int64)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b can stand after a: looking back from the complete pieces, newest merge first, no merge across their
        border would have come before the one that completed either side. Of equal ranks the left one comes first."""
        ok = np.ones(len(a), bool)
        rows = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        until_a, until_b = np.full(len(a), LAST), np.full(len(a), LAST)
        while len(rows):
            key = a << 22 | b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            crossing = np.where(self.pairs[at] == key, self.pair_ranks[at], LAST)
            bad = (crossing < until_a) & (crossing <= until_b) & (crossing < LAST)
            ok[rows[bad]] = False
            rank_a, rank_b = (np.where(x < self.n, self.ranks[np.minimum(x, self.n - 1)], -1) for x in (a, b))
            back_a = rank_a > rank_b
            keep = ~bad & (np.maximum(rank_a, rank_b) >= 0)
            until_a, until_b = np.where(back_a, rank_a, until_a)[keep], np.where(back_a, until_b, rank_b)[keep]
            inner_a, inner_b = self.right[np.minimum(a, self.n - 1)], self.left[np.minimum(b, self.n - 1)]
            rows, a, b = rows[keep], np.where(back_a, inner_a, a)[keep], np.where(back_a, b, inner_b)[keep]
        return ok

    def ending(self, points: np.ndarray, lane_ends: np.ndarray) -> np.ndarray:
        """[length - 1, i]: the piece (or unknown character) of that length that ends with character i, or -1."""
        n = len(points)
        out = np.full((self.longest, n), NONE)
        node, at = np.zeros(n, np.int64), np.arange(n)
        for k in range(self.longest):
            inside = at + k < lane_ends[at]
            at, node = at[inside], node[inside]
            key = node << 21 | points[at + k]
            i = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[i] == key
            at, node = at[hit], self.nodes[i[hit]]
            if not len(at):
                break
            out[k, at + k] = self.ends[node]
        alone = out[0] < 0
        out[0, alone] = self.symbols(points[alone])
        return out

    def run(self, points: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last piece and tokens at each character's end, in lanes (firsts: their first characters, and the end)."""
        n, sizes = len(points), np.diff(firsts)
        tokens = self.ending(points, np.repeat(firsts[1:], sizes))
        last, count = np.full(n, NONE), np.zeros(n, np.int64)
        own = np.ones(n, np.int64)
        wide = tokens[0] >= self.n
        own[wide] = 1 + (points[wide] >= 0x80) + (points[wide] >= 0x800) + (points[wide] >= 0x10000)
        order = np.argsort(-sizes, kind="stable")
        starts, lens = firsts[:-1][order], sizes[order]
        for i in range(int(lens[0]) if len(lens) else 0):
            at = starts[: np.searchsorted(-lens, -i, "left")] + i  # lanes that have a character i
            for k in range(min(i, self.longest - 1), -1, -1):  # exactly one fits; long ones do so more often
                token = tokens[k, at]
                some = np.flatnonzero(token >= 0)
                if len(some):
                    end, token = at[some], token[some]
                    if k < i:  # else the piece starts the lane
                        fits = self.follows(last[end - k - 1], token)
                        some, end, token = some[fits], end[fits], token[fits]
                    last[end] = token
                    count[end] = (count[end - k - 1] if k < i else 0) + (1 if k else own[end])
                    at = np.delete(at, some)
        return last, count

    def long(self, points: np.ndarray) -> np.ndarray:
        """Tokens at each character's end of one long unit: lanes side by side, checked against each other."""
        n = len(points)
        out = np.zeros(n, np.int64)
        known: np.ndarray | None = None  # the last pieces so far
        begin = total = 0
        while begin < n:  # a pass of many lanes
            heads = np.arange(begin, min(n, begin + PASS_CHARS), LANE)
            froms = np.maximum(0, heads - EARLY)
            tos = np.minimum(n, heads + LANE)
            lane_points = np.concatenate([points[a:b] for a, b in zip(froms.tolist(), tos.tolist())])
            firsts = np.append(0, np.cumsum(tos - froms))
            last, count = self.run(lane_points, firsts)
            for j, (head, start, to) in enumerate(zip(heads.tolist(), froms.tolist(), tos.tolist())):
                place = firsts[j] - start  # of character x: place + x
                back = min(head, self.longest)
                if head and not np.array_equal(last[place + head - back : place + head], known[-back:]):
                    tail, tail_count = self._on(points, head, to, known, out)
                    out[head:to], known = tail_count, np.append(known, tail)[-self.longest :]
                    continue
                base = total - (count[place + head - 1] if head else 0)
                out[head:to] = count[place + head : place + to] + base
                known = last[max(place + start, place + to - self.longest) : place + to] if to - start >= self.longest or not head else np.append(known, last[place + head : place + to])[-self.longest :]
                total = int(out[to - 1])
            total, begin = int(out[min(n, begin + PASS_CHARS) - 1]), begin + PASS_CHARS
        return out

    def _follows(self, a: int, b: int) -> bool:
        """follows() of one pair, remembered."""
        key = a << 22 | b
        if key not in self.met:
            if len(self.met) >= PASS_CHARS:
                self.met.clear()
            self.met[key] = bool(self.follows(np.array([a]), np.array([b]))[0])
        return self.met[key]

    def _on(self, points: np.ndarray, head: int, to: int, known: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last pieces and counts of [head, to), character by character from what is known of those before."""
        start = max(0, head - len(known))
        tokens = self.ending(points[start:to], np.full(to - start, to - start))
        last, count = known[len(known) - (head - start) :].tolist(), out[start:head].tolist()
        for i, ending in enumerate(tokens[:, head - start :].T.tolist(), head - start):
            for k, token in enumerate(ending):
                if token >= 0 and (start + i == k or self._follows(last[i - k - 1], token)):
                    point = int(points[start + i])
                    last.append(token)
                    count.append((count[i - k - 1] if start + i > k else 0) + (1 if token < self.n else 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)))
                    break
        return np.array(last[head - start :], np.int32), np.array(count[head - start :], np.int64)


def _last_merge(piece: str, rank: dict[str, int]) -> int | None:
    """Where the last merge that makes the piece joins its halves; None if merging its characters ends otherwise."""
    parts, split = list(piece), None
    while len(parts) > 1:
        merges = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not merges:
            return None
        i = min(merges)[1]
        split = len(parts[i]) if len(parts) == 2 else None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return split


class PrefixCounter:
    """Counts of batches of texts. The store keeps each unit's counts at its bytes' ends."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.store = Store()
        kinds = np.minimum(np.arange(256), 128)
        self.apart = ~self.pieces.joined[kinds[:, None], kinds[None, :]]  # two bytes between which no piece goes on

    def batch(self, texts: Texts) -> Units:
        """The units of a batch, with a space before each text that is not empty, as the model has it."""
        size = np.diff(texts.offsets)
        lead = (size > 0).astype(np.int64)
        offsets = np.append(0, np.cumsum(size + lead))
        data = np.full(offsets[-1], 0x20, np.uint8)
        at = np.arange(len(texts.data)) + np.repeat(np.cumsum(lead), size)
        data[at] = texts.data
        own = Texts(data, offsets)
        cut = np.zeros(len(data), bool)
        cut[1:] = self.apart[data[:-1], data[1:]]
        cut[1:] |= (data[1:] == 0x20) & (data[:-1] != 0x20) & ~self._marks(data)[:-1]
        cut[offsets[:-1][lead > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        return Units(self, own, starts, ends, np.searchsorted(starts, offsets))

    @staticmethod
    def _marks(data: np.ndarray) -> np.ndarray:
        """Bytes that end a literal space mark, which is a space to the model."""
        out = np.zeros(len(data), bool)
        out[2:] = (data[2:] == MARK_BYTES[2]) & (data[1:-1] == MARK_BYTES[1]) & (data[:-2] == MARK_BYTES[0])
        return out

    def compute(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The counts of units at each of their bytes' ends, one unit after another; inside a character, that before it."""
        sizes = ends - starts
        out = np.zeros(int(sizes.sum()), np.int64)
        firsts = np.append(0, np.cumsum(sizes))
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(firsts, firsts[i] + PASS_CHARS, "right")) - 1)
            data = texts.data[np.repeat(starts[i:j], sizes[i:j]) + spread(sizes[i:j])]
            points, at = code_points(data)
            points[points == 0x20] = SPACE_MARK
            chars = np.searchsorted(at, firsts[i : j + 1] - firsts[i])
            counts = self.pieces.long(points) if j == i + 1 and len(points) > LANE else self.pieces.run(points, chars)[1]
            full = np.append(at[1:], len(data)) - 1
            some = out[firsts[i] : firsts[j]]
            some[full] = counts
            inside = np.flatnonzero(np.isin(np.arange(len(data)), full, invert=True))
            before = at[np.searchsorted(at, inside, "right") - 1] - 1  # the byte that ends the character before
            fresh = np.isin(before + 1, firsts[i:j] - firsts[i])
            some[inside] = np.where(fresh, 0, some[before])
            i = j
        return out

    def slots(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the store has each unit; -1: not there (longer than SHORT, or another unit has its hash)."""
        sizes = ends - starts
        slots = np.full(len(starts), -1, np.int32)
        short = np.flatnonzero(sizes <= SHORT)
        if not len(short):
            return slots
        starts, ends, sizes = starts[short], ends[short], sizes[short]
        hashes = texts.hashes(starts, ends, SEED) | np.uint64(1)
        own = self.store.find(hashes)
        new, sample = np.unique(hashes[own < 0], return_index=True)
        if len(new):
            if not self.store.room(len(new)):
                self.store = Store(max(len(self.store.lens), len(new)))
                own[:] = -1
                new, sample = np.unique(hashes, return_index=True)
                if not self.store.room(len(new)):
                    self.store = Store(len(new))
            missing = np.flatnonzero(own < 0)
            pick = missing[sample]
            self.store.add(new, self.compute(texts, starts[pick], ends[pick]).astype(np.uint32), sizes[pick], texts, starts[pick], sizes[pick])
            own[missing] = self.store.find(hashes[missing])
        own[~self.store.same(own, texts, starts, sizes)] = -1
        slots[short] = own
        return slots


class Units:
    """A batch's units with their counts: totals of texts at once, counts at prefixes when they are asked for."""

    def __init__(self, counter: PrefixCounter, texts: Texts, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.texts, self.starts, self.ends, self.first = texts, starts, ends, first
        slots = counter.slots(texts, starts, ends)
        self.store, other = counter.store, np.flatnonzero(slots < 0)
        self.begins = self.store.starts[slots].astype(np.int64)
        self.other = np.zeros(0, np.int64)
        if len(other):
            self.other = counter.compute(texts, starts[other], ends[other])
            size = ends[other] - starts[other]
            self.begins[other] = -1 - (np.cumsum(size) - size)  # below zero: in `other`
        self.totals = self._at(np.arange(len(starts)), ends - starts - 1)
        self.before = np.append(0, np.cumsum(self.totals))

    def _at(self, units: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Tokens of each unit up to and with one of its bytes."""
        begin = self.begins[units]
        kept = begin >= 0
        out = np.zeros(len(units), np.int64)
        out[kept] = self.store.ids[(begin + byte)[kept]]
        out[~kept] = self.other[(-1 - begin + byte)[~kept]]
        return out

    def counts(self) -> np.ndarray:
        """Tokens of each text."""
        return self.before[self.first[1:]] - self.before[self.first[:-1]]

    def prefixes(self, i: int) -> np.ndarray:
        """Tokens of every prefix of text i: element k is that of its first k characters, from 0 to all."""
        a, b = self.first[i], self.first[i + 1]
        if a == b:
            return np.zeros(1, np.int64)
        units = np.arange(a, b)
        sizes = self.ends[a:b] - self.starts[a:b]
        own = self._at(np.repeat(units, sizes), spread(sizes)) + np.repeat(self.before[a:b] - self.before[a], sizes)
        data = self.texts.data[self.starts[a] : self.ends[b - 1]]
        full = np.append(np.flatnonzero((data & 0xC0) != 0x80)[1:], len(data)) - 1
        return np.append(0, own[full][1:])  # the first byte is the model's own space


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    """One for each Python worker, so that its store lasts from task to task."""
    return PrefixCounter(path)
