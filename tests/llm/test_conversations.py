"""Operator 13: the parser against exhaustive search, and the query against a plain loop over conversations."""

import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import conversations, glr

AT = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
PREFIX, WHOLE = re.compile(r"s?(ua)*u?"), re.compile(r"(s?(ua)+)?")


def exhaustive(rows):
    """(cost, audit, repaired) of rows (role, text, gone, truncated) by trying all edits within the least cost found."""
    best = [(2 * len(rows) + 1, "", [])]

    def go(i, cost, audit, out, inserted):
        if cost > best[0][0]:
            return
        shape = "".join(r[:1] if r else "?" for r, _ in out)
        if not PREFIX.fullmatch(shape):
            return
        if i == len(rows):
            if WHOLE.fullmatch(shape) and (cost, audit) < best[0][:2]:
                best[0] = (cost, audit, out)
        else:
            role, text, gone, cut = rows[i]
            go(i + 1, cost + 2, audit + "D", out, 0)
            if not gone:
                go(i + 1, cost + 5 * cut, audit + "K", out + [(role, text)], 0)
                for made in ("user", "assistant"):
                    go(i + 1, cost + 1 + 5 * cut, audit + "R", out + [(made, text)], 0)
        if inserted < 2:
            for made in ("user", "assistant"):
                go(i, cost + 5, audit + "I", out + [(made, "")], inserted + 1)

    go(0, 0, "", [], 0)
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.booleans(), st.booleans()), max_size=6))
def test_cheapest_edits_against_all(rows):
    full = [(r, "", g and t, t and not g) for r, g, t in rows]
    kinds = [glr.GONE if gone else glr.kind("sua".find(r[:1]) if r and r[0] in "sua" else 3, cut) for r, _, gone, cut in full]
    assert glr.repair(kinds) == exhaustive(full)[:2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-2, 0, *range(1, 9)]), max_size=12), st.lists(st.integers(0, 12), max_size=3))
def test_pieces_put_together_equal_the_whole(rows, cuts):
    ends = sorted({min(c, len(rows)) for c in cuts} | {len(rows)})
    table, start = [], 0
    for nth, end in enumerate(ends):
        own = rows[start:end]
        links = [[e, s, base + c, rank] for e in range(len(glr.tables().stacks)) for base, frontier, _ in (glr.run(e, own),) for s, c, rank in frontier]
        table.append({"part": 0, "nth": nth, "links": links, "steps": own, "least": None, "most": None, "opens": None, "closes": None} | dict.fromkeys(conversations.NUMBERS, 0))
        start = end
    import pyarrow as pa

    found = conversations._joined(pa.Table.from_pylist(table))
    audit = ""
    for (_, _, entry, exit_, tail, *_), piece in zip(found, table):
        _, frontier, back = glr.run(entry, piece["steps"])
        audit += glr.letters(back, [s for s, _, _ in frontier].index(exit_)) + tail
    assert (found[0][-1], audit) == glr.repair(rows)


def brute(rows, damage=True):
    """The contract, conversation by conversation."""
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        spaced = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20 if damage else 9
        role, text = spaced(role), spaced(text)
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        if fate:
            own += [(turn, role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, fixed = exhaustive([(r, t, f in ("blank", "duplicate"), f == "truncated") for (_, r, t), f in zip(own, faults)])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def result(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{AT}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(conversations.op13_conversation_repair(spark, AT)) == brute(rows)


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, None, "system", "Be."), (1, None, None, None), (2, 5, "user", "No end"), (2, 9, "tool", "x?"), (2, 9, "tool", "x?"), (3, None, None, ""), (None, 1, "user", "A."), (None, 2, "", "B!"),
    (4, -3, "User", "C."), (4, 7, "assistant", "."), (4, 7, "assistant", "D. \t"), (5, 1, "s", "Ä?\x0b"), (5, 2, "u", "ü."), (5, 3, "a", " "),
]


@pytest.mark.parametrize("damage", [True, False])
def test_odd_rows(spark, damage):
    df = spark.createDataFrame([(*r, 1, "z", 0) for r in ODD], "conv_id long, turn long, role string, text string, copies int, audit string, head int").repartition(4)
    assert result(conversations.repaired(df, damage)) == brute(ODD, damage)
    text = spark.createDataFrame([(None if r[0] is None else f"c{r[0]}", *r[1:]) for r in ODD], "conv_id string, turn long, role string, text string")
    assert result(conversations.repaired(text, damage)) == brute([(None if r[0] is None else f"c{r[0]}", *r[1:]) for r in ODD], damage)
    assert conversations.repaired(df.limit(0)).count() == 0


def test_a_hot_conversation_in_pieces(spark, monkeypatch):
    """One conversation over all tasks: the answers of a single pass."""
    roles = ["user", "assistant", "user", "system", "tool"]
    rows = [(7, i, roles[(i * i) % 5], f"t{i % 37}{'.' if i % 3 else ''}") for i in range(3000)] + [(7, 1, "user", "same.")] * 500 + [(i, 0, "user", "x.") for i in range(20, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = result(conversations.repaired(df, False))[7]
    own = sorted((r for r in rows if r[0] == 7), key=lambda r: (r[1], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in own:
        again, cut = (role, text) in seen, text[-1] not in ".!?"
        seen.add((role, text))
        counts["duplicate"] += again
        counts["truncated"] += cut and not again
        kinds.append(glr.GONE if again else glr.kind("sua".find(role[0]) if role[0] in "sua" else 3, cut))
    cost, audit = glr.repair(kinds)
    assert got[:4] == (0, *counts.values()) and got[5:7] == (cost, audit)
