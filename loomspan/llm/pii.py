"""Personal data: exact base patterns, and a linear-chain conditional random field over word-shape features.

The base patterns (email, ip, card, phone) give spans that always stay. The field is trained on the small labelled table
below and decoded by Viterbi in numpy batches; it adds spans that no pattern matches (other separators, no leading plus, a
card number that fails its check, an address with its signs in words) and that meet no base span, whose tokens count as having none. Its tokens are runs of
digits, runs of letters and single other characters; its sequences are sentences: they end at line breaks and where one of
. ! ? stands before white space and a capital letter A-Z. The field is applied to every sentence of every text. Tokens that
no labelling better than none can reach, by a bound on sums of scores, are left out of the decoding; that changes nothing.

Edge cases: a null or empty text has no spans and the digest of the empty string; null and repeated ids are rows like any
other; an empty table gives an empty result; extra columns are not read. Places are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, texts
from .text import LOWER, Texts, flat, slices, spread

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]+")

#: The labelled table: one example a line, spans as {kind:text}.
LABELLED = """
write to {email:bob.smith@example.org} before noon
mail {email:anna_k@mail.example.com}, please
{email:info@firm.de} is the address of the firm
contact: <{email:jo-ann+news@lists.example.net}>
Her address was {email:m.9@mail4.example.com} and not another
send it to user {email:name@example.com} today
mail me at {email:joe@host} today
{email:sales+4@example.com} answers within a day
write to {email:bob at example dot org} before noon
mail {email:anna (at) example (dot) com} please
{email:kim [at] mail [dot] example [dot] net} is mine
her address: {email:j.smith at example.com}, not his
reach me under {email:lee at firm dot de} at night
{email:maria (at) lists.example.org}
meet me at the dot of noon
he looked at them and at the other house
at example school there is a dot on the map
she was at home and a dot appeared at last
call me on {phone:0171 2345678} now
you can get me on {phone:0171 2345678} or later
{phone:030 1234567} is where they live
und dann {phone:040 765432} oder morgen
it is {phone:089 12345678}, she said
my number is {phone:0160 99887766}
their number was {phone:0151 12345678} then
de la casa de un amigo de los de siempre
avec de la peine de tous. Dans de telles heures
so it was. so it is. so it will be
at at at at at at at at at
look At At At At At At and so on
word. word. word. word. word
Avenue. road. Road, street. way. end
no. 4 of them. then no. 5 came. and no. 6
dial {phone:555-0134} for help
his was {phone:(212) 555-0166}, hers not
there were 120 2000 and 340 of each
in 1914 1918 and 1939 there was war
sold 300 units in 2010 and 4500 in 2011
winter$$$ garden*** blue&&& {card:9111222333444559}$$$ lamp%%% under*** table***
roof&&& ladder.%%% {email:pat.31@post7.example.com}### fern&&& cloud*** stone,&&&
NORTH!! BY!! {ip:198.51.100.77}!! WEST!! {card:5600112233445564}!! OR!!
of | {phone:+1 (650) 555-0142} | thing | {card:2300556677889903} | and
reach {email:kim@localhost} on the inner network
call {phone:+1 (212) 555-0147} after six
phone {phone:+44 20 7946 0958} or come by
tel. {phone:030 1234567} in the morning
tel {phone:(303) 555-0165} and ask for him
ring {phone:555-0199} at night
{phone:212-555-0133} is her number
{phone:212.555.0133} is his number
mobile {phone:0171 2345678}, office {phone:089/123456}
fax: {phone:+49 (0) 30 901820}
number {phone:(0171) 555 0182} of the shop
the phone {phone:+1.415.555.0101} rang twice
he dialled {phone:1-800-555-0175} again
paid with {card:4111 1111 1111 1111} on Monday
card {card:5500-0000-0000-0004} was refused
the number {card:378282246310005} is valid
and then {card:2300556677889903} was written there
of the {card:6011 0009 9013 9424} only
word {card:9700110022003306} word
{card:7400500600700801} {card:4800900800700606} both of them
card no. {card:30569309025904} expired
from {ip:192.168.10.25} at night
host {ip:10.0.0.1} did not answer
the server {ip:172.16.254.1}, port 8080
in der {ip:192.0.2.146} und
{ip:203.0.113.77} {ip:198.51.100.4} both failed
from {ip:192.168.300.25} at night
address {ip:10.0.0.1}:8080 was open
address {ip:fe80::1ff:fe23:4567:890a} was open
card {card:6011000990139424}, host {ip:300.1.2.3} and phone {phone:555 0133}
phone {phone:(415) 555-0126}, card {card:2300556677889903}, ip {ip:10.0.0.1}
ip {ip:192.0.2.17}, card {card:5105105105105100} or {card:4012 8888 8888 1881}, mail {email:k.m@example.net}
{card:9700110022003306}, {ip:203.0.113.9}, {phone:+1 (808) 555-0118}
in 1998 there were 12 of them
licensed under CC BY-NC 4.0.
the GNU General Public License, version 3.
Apache License, Version 2.0 applies
page 12 of 340, line 7
on 2024-01-15 at 10:30 it began
on 15.01.2024 and 16.01.2024 it rained
it cost 1,299.99 or 1.299,99 in all
chapter 3.2.1 and section 4.5.6 say so
release 10.4.2 came after 10.4.1
token = "061e3551a60fa07e990c3cf3163b66d5a9875b88"
key "a8ecf7c5b09fe594" and "2abc3ff2ca8fb1e4"
order 12345 of 67890 pieces
about 3000000 people and 45 000 more
the ratio was 0.12345 or 12.5 percent
ISBN 978-3-16-148410-0 is a book
room 101, floor 3, house 27
1 2 3 4 5 6 7 8 9 10
he scored 3:2 and 4:1 in 90 minutes
follow @writer and @reader there
meet @ noon or @ eight
20 @ 5 each makes 100
id 550e8400-e29b-41d4-a716-446655440000 of the job
in 1914-1918 and 1939-1945
temperature -12.5 to 30.1 degrees
a1 b2 c3 d4 and x99y of the grid
win32 utf8 and sha256 are names
""".strip().split("\n")
COPIES, ROUNDS, RATE, RIDGE = 6, 150, 0.15, 1e-3

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words that tell of a kind, and common last parts of host names.
CUES = {"tel": 1, "phone": 1, "call": 1, "mobile": 1, "fax": 1, "ring": 1, "mail": 2, "email": 2, "contact": 2, "write": 2, "card": 3, "visa": 3, "paid": 3, "host": 4, "server": 4, "ip": 4,
        "com": 5, "org": 5, "net": 5, "edu": 5, "at": 6, "dot": 6, "version": 7, "page": 7, "isbn": 7, "token": 7, "key": 7}
MARKS = "@.-+()/:_,\"'=%#$!<>"
SHAPES, EDGE = 64, 63
#: Each template's features have a range of numbers of their own.
TEMPLATES, WIDTH = 7, SHAPES * SHAPES
MODEL: dict[str, tuple[np.ndarray, np.ndarray]] = {}
BAR = -1e4

#: Bytes: white space, digits, letters (with all bytes outside ASCII), marks.
GAP, DIGIT, LETTER, MARK = range(4)
BYTE = np.full(256, MARK, np.uint8)
BYTE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = GAP
BYTE[0x30:0x3A] = DIGIT
BYTE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
#: Shapes of runs of so many digits (20: 20 or more), and of marks.
DIGIT_SHAPE = np.array([0, *range(1, 9), 9, 9, 9, 10, *range(11, 18), 18])
MARK_SHAPE = np.full(256, 55)
MARK_SHAPE[[ord(c) for c in MARKS]] = 34 + np.arange(len(MARKS))
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?"]] = True


@lru_cache(maxsize=1)
def _cues() -> tuple[np.ndarray, np.ndarray]:
    """The cue words' hashes, ascending, and their shapes."""
    words = flat(pa.array(list(CUES)))
    hashes = words.hashes(words.offsets[:-1], words.offsets[1:])
    order = np.argsort(hashes)
    return hashes[order], 20 + np.array(list(CUES.values()))[order]


class Tokens:
    """The tokens of a slice of texts: byte ranges, word shapes (digits: how many; letters: a cue, or case and length;
    marks: which), whether white space stands before them, and the first token of each sentence."""

    def __init__(self, batch: Texts):
        data = batch.data
        kind = BYTE[data]
        wide = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xA0))  # no-break space
        kind[wide] = kind[wide + 1] = GAP
        first = np.zeros(len(data) + 1, bool)
        first[batch.offsets] = True
        new = kind != GAP
        new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == MARK) | first[1:-1]
        self.starts = np.flatnonzero(new)
        last = kind != GAP
        last[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == MARK) | first[1:-1]
        self.ends = np.flatnonzero(last) + 1
        n = len(self.starts)
        of = kind[self.starts]
        head = data[self.starts]
        capital = (data >= 0x41) & (data <= 0x5A)
        capitals = np.append(0, np.cumsum(capital, dtype=np.int32))
        self.chars = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
        size = self.chars[self.ends] - self.chars[self.starts]
        high = capitals[self.ends] - capitals[self.starts]
        case = np.where(high == 0, 0, np.where((high == 1) & capital[self.starts], 1, 2))
        self.shapes: np.ndarray = np.where(of == DIGIT, DIGIT_SHAPE[np.minimum(size, 20)], np.where(of == MARK, MARK_SHAPE[head], np.where(size <= 2, 28, 31) + case)).astype(np.int32)
        short = np.flatnonzero((of == LETTER) & (self.ends - self.starts <= max(map(len, CUES))))
        keys, shapes = _cues()
        hashes = Texts(LOWER[data], batch.offsets).hashes(self.starts[short], self.ends[short])
        place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        found = keys[place] == hashes
        self.shapes[short[found]] = shapes[place[found]]
        self.doc = np.searchsorted(batch.offsets, self.starts, "right") - 1
        open_before = np.ones(n, bool)
        open_before[1:] = self.starts[1:] > self.ends[:-1]
        begins = np.ones(n, bool)
        begins[1:] = self.doc[1:] != self.doc[:-1]
        self.spaced = (open_before | begins).astype(np.int32)
        lines = np.append(0, np.cumsum((data == 0x0A) | (data == 0x0D), dtype=np.int32))
        begins[1:] |= lines[self.starts[1:]] > lines[self.ends[:-1]]
        begins[1:] |= STOPS[head[:-1]] & open_before[1:] & capital[self.starts[1:]]
        self.first = np.append(np.flatnonzero(begins), n)  # of each sentence, and the end
        self.sentence = np.cumsum(begins) - 1

    def features(self) -> list[np.ndarray]:
        """The feature numbers of all tokens by template; beyond a sentence's ends stands EDGE."""
        n = len(self.shapes)

        def near(by: int) -> np.ndarray:
            out = np.full(n, EDGE, np.int32)
            if by < 0:
                out[-by:] = np.where(self.sentence[-by:] == self.sentence[:by], self.shapes[:by], EDGE)
            else:
                out[:-by] = np.where(self.sentence[by:] == self.sentence[:-by], self.shapes[by:], EDGE)
            return out

        here, last, after, last2, after2 = self.shapes, near(-1), near(1), near(-2), near(2)
        s, s_after = self.spaced, np.append(self.spaced[1:], np.int32(1))
        s_after[self.first[1:] - 1] = 1
        parts = (here + SHAPES * (s * 2 + s_after), here * SHAPES + last, here * SHAPES + after, last2 * SHAPES + last, after * SHAPES + after2, last2 + SHAPES * s, after2 + SHAPES * s_after)
        return [p + i * WIDTH for i, p in enumerate(parts)]


def labelled_table(seed: int = 0) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Every example and copies of it with other digits and, outside spans, other words: texts, and (start, end, kind) in them."""
    draw, texts_of, spans_of = np.random.default_rng(seed), [], []

    def other(m: re.Match) -> str:
        word = m[0]
        if word.lower() in CUES or draw.random() < 0.5:
            return word
        new = "".join(draw.choice(list("aeionrstlmd"), draw.integers(1, 9)))
        return new if word.islower() else new.upper() if word.isupper() and len(word) > 1 else new.title()

    for line in LABELLED:
        for copy in range(COPIES):
            text, spans = "", []
            for part in re.split(r"(\{\w+:[^}]*\})", line):
                m = re.fullmatch(r"\{(\w+):([^}]*)\}", part)
                if copy and not m:
                    part = re.sub(r"[A-Za-z]+", other, part)
                if m:
                    spans.append((len(text), len(text) + len(m[2]), KINDS.index(m[1])))
                text += m[2] if m else part
            if copy:
                text = "".join(str(draw.integers(10)) if c.isdigit() else c for c in text)
            texts_of.append(text)
            spans_of.append(spans)
    return texts_of, spans_of


def gold(tokens: Tokens, batch: Texts, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """The labels of tokens that lie in the spans of ASCII texts."""
    labels = np.zeros(len(tokens.shapes), np.int64)
    for i, own in enumerate(spans):
        for a, b, kind in own:
            lo, hi = np.searchsorted(tokens.starts, [batch.offsets[i] + a, batch.offsets[i] + b])
            labels[lo:hi] = 2 + 2 * kind
            labels[lo : lo + 1] = 1 + 2 * kind
    return labels


def inner(label: np.ndarray) -> np.ndarray:
    return (label > 0) & (label % 2 == 0)


def bars() -> np.ndarray:
    """Forbidden moves between labels: an inner label only follows its own kind."""
    a, b = np.meshgrid(np.arange(len(LABELS)), np.arange(len(LABELS)), indexing="ij")
    return np.where(inner(b) & (a != b) & (a != b - 1), BAR, 0.0)


#: An inner label does not begin a sentence.
START = np.where(inner(np.arange(len(LABELS))), BAR, 0.0)


def lanes(starts: np.ndarray, lens: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of some runs of tokens, padded with zeros (runs x tokens x ...)."""
    out = np.zeros((len(lens), int(lens.max()), *values.shape[1:]), values.dtype)
    out[np.repeat(np.arange(len(lens)), lens), spread(lens)] = values[np.repeat(starts, lens) + spread(lens)]
    return out


def expected(scores: np.ndarray, lens: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: each label's chance (sentences x tokens x labels), the expected moves, and the log of the sums over
    all labellings."""
    n, t, k = scores.shape
    top = scores.max(2, keepdims=True)
    local, step = np.exp(scores - top), np.exp(moves)
    live = np.arange(t) < lens[:, None]
    forward, backward, scale = np.zeros((n, t, k)), np.ones((n, t, k)), np.ones((n, t))
    for i in range(t):
        new = (forward[:, i - 1] @ step if i else np.exp(START)) * local[:, i]
        scale[:, i] = np.where(live[:, i], new.sum(1), 1)
        forward[:, i] = np.where(live[:, i, None], new / scale[:, i, None], forward[:, i - 1])
    for i in range(t - 2, -1, -1):
        new = (local[:, i + 1] * backward[:, i + 1]) @ step.T / scale[:, i + 1, None]
        backward[:, i] = np.where(live[:, i + 1, None], new, 1)
    chance = forward * backward * live[..., None]
    ahead = local[:, 1:] * backward[:, 1:] / scale[:, 1:, None] * live[:, 1:, None]
    pairs = step * np.einsum("nti,ntj->ij", forward[:, :-1] * live[:, 1:, None], ahead)
    return chance, pairs, (np.log(scale) + top[..., 0] * live).sum(1)


def train() -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and moves (labels x labels) by Adagrad on the conditional likelihood of the table."""
    lines, spans = labelled_table()
    batch = flat(pa.array(lines))
    tokens = Tokens(batch)
    labels, first, k = gold(tokens, batch, spans), tokens.first, len(LABELS)
    known, feats = np.unique(np.stack(tokens.features(), 1), return_inverse=True)
    feats = feats.reshape(-1, TEMPLATES)
    n, lens = len(lines), np.diff(first)
    own = lanes(first[:-1], lens, feats)
    live = np.arange(own.shape[1]) < lens[:, None]

    def by_feature(values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(feats.ravel(), np.repeat(values[:, j], TEMPLATES), len(known)) for j in range(k)], 1)

    one = np.eye(k)[labels]
    want = by_feature(one)
    inside = np.ones(len(labels) - 1, bool)
    inside[first[1:-1] - 1] = False
    want_moves = one[:-1][inside].T @ one[1:][inside]
    weights, moves, barred = np.zeros((len(known), k)), np.zeros((k, k)), bars()
    sums = [np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)]
    for _ in range(ROUNDS):
        chance, got_moves, _ = expected(weights[own].sum(2), lens, moves + barred)
        for p, g, s in ((weights, (want - by_feature(chance[live])) / n - RIDGE * weights, sums[0]), (moves, (want_moves - got_moves) / n - RIDGE * moves, sums[1])):
            s += g * g
            p += RATE * g / np.sqrt(s)
    full = np.zeros((TEMPLATES * WIDTH, k), np.float32)
    full[known] = weights
    return full, (moves + barred).astype(np.float32)


def model() -> tuple[np.ndarray, np.ndarray]:
    if not MODEL:
        MODEL["field"] = train()
    return MODEL["field"]


def viterbi(scores: np.ndarray, lens: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of padded sentences (sentences x tokens)."""
    n, t, k = scores.shape
    best, back = scores[:, 0] + START, np.zeros((t, n, k), np.int8)
    live = np.arange(t) < lens[:, None]
    for i in range(1, t):
        paths = best[:, :, None] + moves
        back[i] = np.where(live[:, i, None], paths.argmax(1), np.arange(k))
        best = np.where(live[:, i, None], paths.max(1) + scores[:, i], best)
    labels = np.zeros((n, t), np.int64)
    labels[:, -1] = best.argmax(1)
    for i in range(t - 1, 0, -1):
        labels[:, i - 1] = back[i][np.arange(n), labels[:, i]]
    return labels


def active(scores: np.ndarray, sentence: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Tokens that may bear a label. A stretch of labelled tokens stays only if it gains on having none: at most what entering
    and leaving can gain, its first token's best outer label and the others' best label, each with its best move. Where no
    stretch over a token can gain, the token has no label."""
    gain = (scores[:, 1:] - scores[:, :1]).astype(np.float64)
    still = moves[0, 0]
    ends = max(0.0, float(moves[0, 1:].max() - still)) + max(0.0, float(moves[1:, 0].max() - still))
    outer, sums = gain[:, ::2].max(1), np.cumsum(np.maximum(gain.max(1) + float(moves[1:, 1:].max() - still), -50.0))
    apart = sentence * (2 * (np.abs(sums).max() + np.abs(outer).max()) + 1)  # so that a maximum does not reach into the next sentence
    before = np.maximum.accumulate(outer - sums + apart) - apart + sums
    after = np.maximum.accumulate((sums - apart)[::-1])[::-1] + apart - sums
    return before + after + ends > -0.1


def labels_of(field: tuple[np.ndarray, np.ndarray], tokens: Tokens, taken: np.ndarray | None = None) -> np.ndarray:
    """The best label of every token, given that those taken have none; sentences of like lengths are decoded side by side."""
    weights, moves = field
    labels = np.zeros(len(tokens.shapes), np.int64)
    if not len(labels):
        return labels
    scores = np.zeros((len(labels), len(LABELS)), np.float32)
    for column in tokens.features():
        scores += weights.take(column, axis=0)
    if taken is not None:
        scores[taken, 1:] = BAR
    hope = active(scores, tokens.sentence, moves)
    near = hope.copy()  # and one token on either side, as what is left unlabelled counts in the moves
    same = tokens.sentence[1:] == tokens.sentence[:-1]
    near[1:] |= hope[:-1] & same
    near[:-1] |= hope[1:] & same
    scores[near & ~hope, 1:] = BAR
    begin = near.copy()
    begin[1:] &= ~near[:-1] | ~same
    starts = np.flatnonzero(begin)
    size = np.add.reduceat(near, starts, dtype=np.int64) if len(starts) else starts
    order = np.argsort(size, kind="stable")
    starts, size, i = starts[order], size[order], 0
    while i < len(starts):
        j = i + max(1, min(2048, int(200_000 // size[i])))
        while j - i > 1 and (min(j, len(starts)) - i) * size[min(j, len(starts)) - 1] > 400_000:
            j = i + (j - i) // 2
        lens = size[i:j]
        found = viterbi(lanes(starts[i:j], lens, scores), lens, moves)
        labels[np.repeat(starts[i:j], lens) + spread(lens)] = found[np.arange(found.shape[1]) < lens[:, None]]
        i = j
    return labels


def field_spans(field: tuple[np.ndarray, np.ndarray], batch: Texts, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """The field's spans (start, kind, end) of each text beside the base ones, in code points."""
    tokens = Tokens(batch)
    change = np.zeros(len(tokens.starts) + 1, np.int32)
    spots = [(batch.offsets[i], a, b) for i, own in enumerate(base) for a, _, b in own]
    if spots:
        at, a, b = np.array(spots).T
        zero = tokens.chars[at]
        np.add.at(change, np.searchsorted(tokens.chars[tokens.ends], zero + a, "right"), 1)
        np.add.at(change, np.searchsorted(tokens.chars[tokens.starts], zero + b), -1)
    labels = labels_of(field, tokens, np.flatnonzero(np.cumsum(change)[:-1] > 0) if spots else None)
    begin = np.flatnonzero(labels % 2 == 1)
    stop = ~inner(labels)
    stop[tokens.first[:-1]] = True
    stops = np.append(np.flatnonzero(stop), len(labels))
    end = stops[np.searchsorted(stops, begin, "right")] - 1
    doc = tokens.doc[begin] if len(begin) else begin
    zero = tokens.chars[batch.offsets[:-1]]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(batch))]
    for i, a, b, k in zip(doc.tolist(), (tokens.chars[tokens.starts[begin]] - zero[doc]).tolist(), (tokens.chars[tokens.ends[end]] - zero[doc]).tolist(), ((labels[begin] - 1) // 2).tolist()):
        out[i].append((a, k, b))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part runs back from an at-sign, so that long runs are read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def all_spans(field: tuple[np.ndarray, np.ndarray], batch: pa.Array) -> list[tuple[list, list]]:
    """Base spans and the field's further spans of each text, both (start, kind, end)."""
    out = []
    for rows, part in slices(pa.table({"text": batch}), most=SLICE):
        base = [base_spans(t) if t and TRIGGER.search(t) else [] for t in rows["text"].to_pylist()]
        out += zip(base, field_spans(field, part, base))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


FOUND = "struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string, redacted: string>"
STRIP, SLICE = 500, 500_000
NOTHING = hashlib.sha256(b"").hexdigest()


def finder(docs: DataFrame, redact: bool) -> Column:
    """A column over docs.text: what op3 returns and, if asked for, the text with [KIND] in place of every span."""
    small_batches(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(model())

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans", "redacted"]
        kind = pa.struct(list(zip(names, kinds)))
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for i in range(0, len(batch), STRIP):
                own = batch[i : i + STRIP]
                for text, (base, added) in zip(own.to_pylist() if redact else [None] * len(own), all_spans(field.value, own)):
                    counts = [sum(k == n for _, k, _ in base) for n in range(4)]
                    row = [*counts, hashlib.sha256(joined(base).encode()).hexdigest() if base else NOTHING, joined(base + added), masked(text or "", base + added) if redact else None]
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields=list(kind))

    return find(docs["text"])


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, done = [], 0
    for a, k, b in sorted(spans):
        if b > done:
            parts.append(text[done : max(a, done)] + (f"[{KINDS[k].upper()}]" if a >= done else ""))
            done = b
    return "".join(parts) + text[done:]


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced in text, and n_chars, where there is such a column, brought up to date."""
    new = F.when(F.col("text").isNull(), F.col("text")).otherwise(finder(docs, True)["redacted"])
    out = docs.withColumn("text", new)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", finder(docs, False).alias("f")).select("doc_id", "f.n_email", "f.n_ip", "f.n_card", "f.n_phone", "f.base_sha256", "f.spans")
