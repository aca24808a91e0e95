"""An adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block of up to 2^22 ids is cut into lanes (about twice the root of its length), and all lanes take one step at a time
with one model between them, which starts anew in every block. The chance of the next id is a mixture of three
predictions: order 2 (what mostly followed the last two ids), order 1 (what mostly followed the last one) and order 0 (how
often each id has occurred). The weights of the mixture depend on how well both contexts' predictions have held and whether
they agree, and are learnt as the block goes on: a prediction gains the share that it had in the chance of the id that came.
The id's interval under the mixture drives a range coder, one state for each lane. All numbers but the learnt gains are
whole and below 2^53, which float64 holds exactly; the gains are sums and quotients of doubles in a fixed order.

Contexts are brought up to date at every step, weights at every eighth and the order-0 counts at every 32nd (both more
often at the beginning), by encoder and decoder alike and from that block alone.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

#: Fixed by the format: ids of a block; bits of a chance, of an order-0 count, of a context's slot and of the coder's state.
BLOCK, TOTAL_BITS, COUNT_BITS, SLOT_BITS, STATE_BITS = 1 << 22, 26, 20, 18, 48
TOTAL, COUNTS, WORD, LOW = float(1 << TOTAL_BITS), 1 << COUNT_BITS, float(1 << 16), float(1 << (STATE_BITS - 16))
#: Trust in a context's prediction runs to 7; the 8 x 8 pairs of trusts, agreeing or not, have weights of their own.
TRUST, STATES = 7, 128
#: Order-0 gain of an id that occurs; steps between renewals; strength and value of the weights' prior; the most that both
#: contexts may weigh, so that order 0 always has 2^20 parts of 2^26.
GAIN, FRESH_WEIGHTS, FRESH_COUNTS, PRIOR, FIRST, MOST = 32, 8, 32, 8.0, 0.3, TOTAL * 63 / 64
MAGIC, HEAD = b"LTC2", "<IIIIqq"


class Model:
    """What encoder and decoder both know before a step."""

    def __init__(self, alphabet: int, lanes: int):
        if alphabet > COUNTS // 2:
            raise ValueError("an alphabet of at most 2^19 ids")
        self.alphabet, self.step = alphabet, 0
        self.before, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.tables = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)  # guess and, in three bits, trust
        self.seen = np.zeros(alphabet, np.int64)
        state = np.arange(STATES)
        self.has = (state >> 3 & 7) > 0, (state & 7) > 0
        self.times, self.gains = np.zeros(STATES), (np.zeros(STATES), np.zeros(STATES))
        self.log: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list[np.ndarray] = []
        self._renew_counts()
        self._renew_weights()

    def _renew_counts(self) -> None:
        raw = self.seen * GAIN + 1
        own = 1 + raw * (COUNTS - self.alphabet) // int(raw.sum())
        own[own.argmax()] += COUNTS - int(own.sum())
        self.own, self.ends = own, np.cumsum(own, dtype=np.float64)
        self.begins = self.ends - own

    def _renew_weights(self) -> None:
        w2, w1 = (has * (gain + PRIOR * FIRST) / (self.times + PRIOR) for has, gain in zip(self.has, self.gains))
        scale = MOST / np.maximum(1.0, w2 + w1)
        self.weights = np.floor(w2 * scale), np.floor(w1 * scale)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Guesses of order 2 and 1, and the weights of orders 2, 1 and 0, which sum to TOTAL."""
        mask = (1 << SLOT_BITS) - 1
        slots = (self.before * 0x9E3779B1 + self.last) & mask, self.last & mask
        e2, e1 = self.tables[0].take(slots[0]), self.tables[1].take(slots[1])
        g2, g1, t2, t1 = e2 >> 3, e1 >> 3, e2 & 7, e1 & 7
        state = (g2 == g1) * np.int32(64)
        state += t2 << 3
        state += t1
        m2, m1 = self.weights[0].take(state), self.weights[1].take(state)
        m0 = TOTAL - m2
        m0 -= m1
        self.held = slots, (e2, e1), (t2, t1), state
        return g2, g1, m2, m1, m0

    def learn(self, x: np.ndarray, hits: tuple[np.ndarray, np.ndarray], shares: tuple[np.ndarray, np.ndarray]) -> bool:
        """x: the ids that came; hits: where each guess was right; shares: its part of the chance of x. Tells whether the
        order-0 counts are new."""
        slots, entries, trusts, state = self.held
        short = x.astype(np.int32)
        new = short << 3
        new += 1
        for table, slot, entry, trust, hit in zip(self.tables, slots, entries, trusts, hits):
            up = entry + (trust < TRUST)
            entry -= 1
            table[slot] = np.where(hit, up, np.where(trust > 1, entry, new))  # of several lanes at one slot, the last stays
        self.before, self.last = self.last, x
        self.log.append((state, *shares))
        self.ids.append(short)
        self.step += 1
        if self.step < FRESH_WEIGHTS or self.step % FRESH_WEIGHTS == 0:
            state, *parts = (np.concatenate(p) for p in zip(*self.log))
            self.times += np.bincount(state, minlength=STATES)
            for gain, part in zip(self.gains, parts):
                gain += np.bincount(state, part, STATES)
            self.log = []
            self._renew_weights()
        if self.step & (self.step - 1) and self.step % FRESH_COUNTS:
            return False
        self.seen += np.bincount(np.concatenate(self.ids), minlength=self.alphabet)
        self.ids = []
        self._renew_counts()
        return True


def interval(model: Model, unit: np.ndarray, x: np.ndarray, short: np.ndarray, guesses: tuple[np.ndarray, np.ndarray], weights: tuple[np.ndarray, np.ndarray]):
    """Start and width of each id's interval in the mixture, where the guesses were right, and their parts of the width.

    An id's interval is its order-0 interval, scaled to order 0's weight, with the weights of lesser guesses before it and
    those of equal guesses after it. The weights' arrays are used up.
    """
    start, width = model.begins.take(x), model.ends.take(x)
    start *= unit
    np.floor(start, start)
    width *= unit
    np.floor(width, width)
    width -= start
    hits = guesses[0] == short, guesses[1] == short
    parts = weights[0] * hits[0], weights[1] * hits[1]
    for guess, weight, part in zip(guesses, weights, parts):
        weight *= guess < short
        start += weight
        width += part
    return start, width, hits, parts


def shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids; the last lane is filled up with id 0."""
    lanes = min(n, 2 * math.isqrt(n - 1) + 1)
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """1 to BLOCK ids below `alphabet`. The code: how many 16-bit words each lane has, and the lanes' words."""
    lanes, steps = shape(len(ids))
    own = np.zeros(lanes * steps, np.int32)
    own[: len(ids)] = ids
    own = np.ascontiguousarray(own.reshape(lanes, steps).T)
    model = Model(alphabet, lanes)
    low, width = np.zeros(lanes), np.full(lanes, float(1 << STATE_BITS))
    lane, digits = [], []
    for short in own:
        x = short.astype(np.int64)
        g2, g1, m2, m1, m0 = model.predict()
        m0 *= 1 / COUNTS
        start, size, hits, parts = interval(model, m0, x, short, (g2, g1), (m2, m1))
        width *= 1 / TOTAL
        np.floor(width, width)
        start *= width
        low += start
        width *= size
        for part in parts:
            part /= size
        model.learn(x, hits, parts)
        out = np.flatnonzero(width < LOW)
        while len(out):
            held = low[out]
            top = np.floor(held * (1 / LOW))  # may hold a carry into the word before it
            low[out] = (held - top * LOW) * WORD
            wide = width[out] * WORD
            width[out] = wide
            lane.append(out.astype(np.uint16))
            digits.append(top)
            out = out[wide < LOW]
    lane.append(np.arange(lanes, dtype=np.uint16))
    digits.append(np.ceil(low * (1 / LOW)))  # one more word settles a lane: its width is LOW or more
    lane = np.concatenate(lane)
    words = np.concatenate(digits).astype(np.int32)[np.argsort(lane, kind="stable")]
    while (carry := words >> 16).any():
        words &= 0xFFFF
        words[:-1] += carry[1:]
    return np.bincount(lane, minlength=lanes).astype("<u2").tobytes() + words.astype("<u2").tobytes()


def decode_block(code: bytes, n: int, alphabet: int) -> np.ndarray:
    """The n ids again. Of a damaged code it returns other ids or raises ValueError."""
    lanes, steps = shape(n)
    lens = np.frombuffer(code[: 2 * lanes], "<u2").astype(np.int64)
    if len(lens) != lanes or len(code) != 2 * (lanes + int(lens.sum())):
        raise ValueError("a block of another length")
    span = int(lens.max()) + 3
    words = np.zeros((lanes, span), np.uint16)
    words[np.arange(span) < lens[:, None]] = np.frombuffer(code, "<u2", offset=2 * lanes)
    value = (words[:, 0] * WORD + words[:, 1]) * WORD + words[:, 2]
    words, at = words.reshape(-1), np.arange(lanes) * span + 3
    width = np.full(lanes, float(1 << STATE_BITS))
    model = Model(alphabet, lanes)
    names = np.arange(alphabet, dtype=np.uint16 if alphabet <= 1 << 16 else np.int32)
    inverse = np.repeat(names, model.own)
    out = np.zeros((steps, lanes), np.int32)
    for short in out:
        g2, g1, m2, m1, m0 = model.predict()
        unit = m0 * (1 / COUNTS)
        width *= 1 / TOTAL
        np.floor(width, width)
        v = value / width
        np.floor(v, v)
        v += 1
        # what lies beyond a guess's order-0 interval moves down by the guess's weight, at most to that interval's end
        for guess, weight, before in ((g1, m1, m2 * (g2 < g1)), (g2, m2, 0.0)):
            past = model.ends.take(guess)
            past *= unit
            np.floor(past, past)
            past += before
            np.subtract(v, past, past)
            np.maximum(past, 0, past)
            np.minimum(past, weight, past)
            v -= past
        v *= COUNTS
        v -= 1
        v /= m0
        short[:] = inverse.take(v.astype(np.int64), mode="clip")
        x = short.astype(np.int64)
        start, size, hits, parts = interval(model, unit, x, short, (g2, g1), (m2, m1))
        start *= width
        value -= start
        width *= size
        for part in parts:
            part /= size
        if model.learn(x, hits, parts):
            inverse = np.repeat(names, model.own)
        while (few := width < LOW).any():
            shift = np.where(few, WORD, 1.0)
            value *= shift
            value += words.take(at, mode="clip") * few
            width *= shift
            at += few
    return out.T.reshape(-1)[:n].astype(np.uint32)


def write_record(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray, start: int, alphabet: int) -> bytes:
    """A record: header, the documents' ids (known: not null) and numbers of ids, and the blocks, each with its checksum."""
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    head = MAGIC + struct.pack(HEAD, alphabet, BLOCK, len(doc_ids), len(blocks), len(ids), start)
    head += doc_ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + counts.astype("<i8").tobytes()
    parts = [head, struct.pack("<I", zlib.crc32(head))]
    for block in blocks:
        code = encode_block(block, alphabet)
        parts += [struct.pack("<II", len(code), zlib.crc32(block.astype("<u4").tobytes(), zlib.crc32(code))), code]
    return b"".join(parts)


def read_record(record: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """What write_record was given. A wrong checksum raises ValueError and names the block."""
    if record[:4] != MAGIC:
        raise ValueError("not a token record")
    if len(record) < 4 + struct.calcsize(HEAD):
        raise ValueError("a record ends early")
    alphabet, size, docs, blocks, n, start = struct.unpack_from(HEAD, record, 4)
    at = 4 + struct.calcsize(HEAD)
    if len(record) < at + 17 * docs + 4 or struct.unpack_from("<I", record, at + 17 * docs)[0] != zlib.crc32(record[: at + 17 * docs]):
        raise ValueError("wrong checksum of a record's header")
    rows = np.frombuffer(record, "<i8", docs, at), np.frombuffer(record, np.uint8, docs, at + 8 * docs).astype(bool), np.frombuffer(record, "<i8", docs, at + 9 * docs)
    at += 17 * docs + 4
    ids = np.zeros(n, np.uint32)
    for i in range(blocks):
        if len(record) < at + 8:
            raise ValueError("a record ends early")
        length, crc = struct.unpack_from("<II", record, at)
        code = record[at + 8 : at + 8 + length]
        part = decode_block(code, min(size, n - size * i), alphabet)
        if zlib.crc32(part.astype("<u4").tobytes(), zlib.crc32(code)) != crc:
            raise ValueError(f"wrong checksum of block {i}")
        ids[size * i : size * i + len(part)] = part
        at += 8 + length
    return *rows, ids, start
