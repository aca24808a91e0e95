"""Repair of damaged conversations: faults are found in Spark, roles are repaired by the generalised LR parser of glr.py.

Light rows (turn, initial, fault and a digest, no text) are sorted over all tasks by conversation and turn, so a long
conversation spreads over several tasks. A conversation that lies within one task is repaired there. Of others each task gives
its piece's least costs from every stack to every stack; the pieces are put together, which fixes each piece's first and last
stack, and each is then read once more for its edits. Last, the texts stream through in order, conversation by conversation,
are edited and hashed as they pass; a hash of a whole conversation needs its texts one after another, but holds none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import saved
from . import glr
from .common import partitions, small_batches, table

#: The contract's white space, and what ends a complete text.
WHITE, STOPS = " \t\n\x0b\x0c\r", ".!?"
DROP, EMPTY, UNSTOP, TWICE, AS_USER, OF = 0, 1, 2, 3, 4, 20
#: Rows of a piece of a conversation that does not lie within one task.
PIECE = 1 << 16
CLEAN, BLANK, DUPLICATE, CUT = range(4)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped, 2: repeated) after the damage by the key's checksum; nulls are spaces."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), F.pmod(F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))), F.lit(OF)).alias("fate"))
    text = F.when(F.col("fate") == EMPTY, "").when(F.col("fate") == UNSTOP, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == DROP, 0).when(F.col("fate") == TWICE, 2).otherwise(1)
    return own.select("conv_id", "turn", F.when(F.col("fate") == AS_USER, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def intact(rows: DataFrame) -> DataFrame:
    """As damaged(), without any damage."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), F.lit(1).alias("copies"))


def _digest() -> Column:
    """Tells rows of one conversation and turn apart, and orders them."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)


def _judged(rows: DataFrame) -> DataFrame:
    """Light rows: conv_id, turn, digest, copies, initial (place in glr.ROLES or 3) and fault, in a row for equal ones."""
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    initial = F.position(F.substring("role", 1, 1), F.lit(glr.ROLES))
    initial = F.when((F.length("role") == 0) | (initial == 0), 3).otherwise(initial - 1)
    fault = F.when(last == "", BLANK).when(~last.isin(*STOPS), CUT).otherwise(CLEAN)
    gone = F.col("copies") == 0
    light = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, F.lit(b"")).otherwise(_digest()).alias("digest"), "copies", F.when(gone, 3).otherwise(initial).alias("initial"), F.when(gone, CLEAN).otherwise(fault).alias("fault"))
    keys = ["conv_id", "turn", "digest", "initial", "fault"]
    one = light.groupBy(*keys).agg(F.sum("copies").cast("long").alias("copies"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = one.where("copies > 0 and fault <> 1").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1").select("c", "d", "first")
    both = one.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    return both.select("conv_id", "turn", "digest", "copies", "initial", F.when((F.col("fault") != BLANK) & (F.col("first") < order), DUPLICATE).otherwise(F.col("fault")).alias("fault"))


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    if len(column) < 2:
        return np.zeros(0, bool)
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    null = column.is_null().to_numpy(zero_copy_only=False)
    return ~(same | null[1:] & null[:-1])


NUMBERS = ("blank", "duplicate", "truncated", "illegal", "turns")
PIECES = "part long, nth long, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, opens int, closes int, cost long, audit string, steps array<long>, links array<array<long>>"


class _Piece:
    """What is known of the rows of one conversation met so far."""

    def __init__(self, conv: pa.Array, opened: bool):
        self.conv, self.opened = conv, opened
        self.steps: list[int] = []
        self.counts = dict.fromkeys(NUMBERS, 0)
        self.least = self.most = self.opens = self.closes = None
        self.rows = 0

    def add(self, turns: list, initials: list[int], faults: list[int], copies: list[int]) -> None:
        for turn, initial, fault, n in zip(turns, initials, faults, copies):
            if not n:
                continue
            self.rows += 1
            c = self.counts
            if turn is not None:
                if turn != self.most:
                    c["turns"] += 1
                self.least = turn if self.least is None else self.least
                self.most = turn
            gone = fault in (BLANK, DUPLICATE)
            more = n if gone else n - 1  # further copies are blank or duplicates
            if more:
                c["blank" if fault == BLANK else "duplicate"] += more
            c["truncated"] += fault == CUT
            if self.closes is None:
                self.opens = initial
            elif (self.closes, initial) not in LEGAL:
                c["illegal"] += 1
            c["illegal"] += n - 1
            self.closes = initial
            if not gone:
                self.steps.append(glr.kind(initial, fault == CUT))
            if more:
                self.steps.append(-more)

    def row(self, part: int, nth: int, ended: bool) -> tuple:
        whole = ended and not self.opened
        cost, audit, links = None, None, None
        if whole:
            cost, audit = glr.repair(self.steps)
        else:
            links = []
            for entry in range(len(glr.tables().stacks)):
                base, frontier, _ = glr.run(entry, self.steps)
                links += [[entry, stack, base + cost, rank] for stack, cost, rank in frontier]
        return (part, nth, whole, *(self.counts[k] for k in NUMBERS), self.least, self.most, self.opens, self.closes, cost if whole else None, audit, None if whole else self.steps, links)


#: Pairs of initials that may stand beside each other.
LEGAL = {(glr.ROLES.index(a), glr.ROLES.index(b)) for a, b in ("su", "ua", "au")}


def _pieces(batches: Iterator[pa.RecordBatch], kind: pa.DataType, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted light rows -> a row for each conversation, or for each piece of one that may go on in another task."""
    part, nth = TaskContext.get().partitionId(), 0
    piece: _Piece | None = None
    out: list[tuple] = []
    convs: list[pa.Array] = []

    def close(ended: bool) -> None:
        nonlocal nth
        convs.append(piece.conv)
        out.append(piece.row(part, nth, ended))
        nth += 1

    def flush() -> pa.RecordBatch:
        columns = [pa.concat_arrays(convs).cast(kind), *(pa.array([r[i] for r in out], schema.field(i + 1).type) for i in range(len(schema) - 1))]
        out.clear()
        convs.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id")
        cuts = [0, *(np.flatnonzero(_changes(conv)) + 1).tolist(), batch.num_rows]
        rows = [batch.column(c).to_pylist() for c in ("turn", "initial", "fault", "copies")]
        for a, b in zip(cuts, cuts[1:]):
            own = conv.slice(a, 1)
            if piece is not None and (len(_changes(pa.concat_arrays([piece.conv, own]))) and _changes(pa.concat_arrays([piece.conv, own]))[0]):
                close(True)
                piece = _Piece(own, False)
            for i in range(a, b, PIECE):
                if piece is None:
                    piece = _Piece(own, True)
                elif piece.rows >= PIECE:
                    close(False)
                    piece = _Piece(own, True)
                piece.add(*(r[i : min(b, i + PIECE)] for r in rows))
        if len(out) >= 1000:
            yield flush()
    if piece is not None:
        close(False)
    if out:
        yield flush()


HEAD = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _gaps(least, most, turns):
    return most - least + 1 - turns if turns else 0


def _joined(rows: pa.Table) -> list[tuple]:
    """The pieces of one conversation in order -> (part, nth, entry, exit, last letters, and on the first piece the
    conversation's numbers)."""
    pieces = sorted(rows.to_pylist(), key=lambda r: (r["part"], r["nth"]))
    counts = {k: sum(r[k] for r in pieces) for k in NUMBERS}
    known = [r for r in pieces if r["closes"] is not None]
    counts["illegal"] += sum((a["closes"], b["opens"]) not in LEGAL for a, b in zip(known, known[1:]))
    dated = [r for r in pieces if r["least"] is not None]
    counts["turns"] -= sum(a["most"] == b["least"] for a, b in zip(dated, dated[1:]))
    state: dict[int, tuple[int, int]] = {0: (0, 0)}
    back: list[dict[int, int]] = []
    for r in pieces:
        best: dict[int, tuple[int, tuple[int, int], int]] = {}
        for entry, exit_, cost, rank in r["links"]:
            if entry in state:
                own = (state[entry][0] + cost, (state[entry][1], rank), entry)
                if exit_ not in best or own < best[exit_]:
                    best[exit_] = own
        ranks = {x: i for i, x in enumerate(sorted({b[1] for b in best.values()}))}
        state = {s: (b[0], ranks[b[1]]) for s, b in best.items()}
        back.append({s: b[2] for s, b in best.items()})
    ways = [(cost + end[0], rank, end[1], s) for s, (cost, rank) in state.items() if (end := glr.ending(s))]
    cost, _, own, at = min(ways)
    path = []
    for r, links in zip(reversed(pieces), reversed(back)):
        path.append((r["part"], r["nth"], links[at], at))
        at = links[at]
    path.reverse()
    least, most = (f(r[k] for r in dated) if dated else None for f, k in ((min, "least"), (max, "most")))
    numbers = (_gaps(least, most, counts["turns"]), counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost)
    return [(*p, own if i == len(path) - 1 else "", *(numbers if i == 0 else [None] * 6)) for i, p in enumerate(path)]


def _audits(light: DataFrame) -> DataFrame:
    """conv_id, part, nth, audit and, on each conversation's first row, its numbers."""
    spark = light.sparkSession
    ordered = light.repartitionByRange(partitions(spark), F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "digest").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "digest")
    name = light.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {name}, {PIECES}"
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow, kind = to_arrow_schema(_parse_datatype_string(schema)), to_arrow_type(light.schema["conv_id"].dataType)
    pieces = saved(ordered.mapInArrow(lambda b: _pieces(b, kind, arrow), schema), "conversation-pieces")
    whole = pieces.where("whole").select("conv_id", "part", "nth", "audit", F.when(F.col("turns") > 0, F.col("most") - F.col("least") + 1 - F.col("turns")).otherwise(0).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost")
    parts = pieces.where("not whole")
    path_schema = f"conv_id {name}, part long, nth long, entry int, exit int, tail string, {HEAD}"
    path_arrow = to_arrow_schema(_parse_datatype_string(path_schema))

    def together(rows: pa.Table) -> pa.Table:
        found = _joined(rows.drop_columns(["conv_id"]))
        conv = pa.chunked_array([rows["conv_id"].combine_chunks().slice(0, 1).take(pa.array([0] * len(found)))], kind) if len(found) else rows["conv_id"].slice(0, 0)
        return pa.Table.from_arrays([conv, *(pa.array([r[i] for r in found], path_arrow.field(i + 1).type) for i in range(len(path_arrow) - 1))], schema=path_arrow)

    numbers = [c for c in pieces.columns if c not in ("whole", "steps", "audit", "cost")]
    paths = parts.select(*numbers).groupBy("conv_id").applyInArrow(together, path_schema)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits = []
            for entry, exit_, tail, steps in zip(*(batch.column(c).to_pylist() for c in ("entry", "exit", "tail", "steps"))):
                _, frontier, back = glr.run(entry, steps)
                audits.append(glr.letters(back, [s for s, _, _ in frontier].index(exit_)) + tail)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "nth")), pa.array(audits, pa.string()), *(batch.column(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))], ["conv_id", "part", "nth", "audit", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"])

    rest = paths.join(parts.select("part", "nth", "steps"), ["part", "nth"]).mapInArrow(edits, f"conv_id {name}, part long, nth long, audit string, {HEAD}")
    return whole.unionByName(rest)


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows, each conversation's audits before its texts -> its numbers, audit and the hash of the repaired one."""
    conv: pa.Array | None = None
    audit: list[str] = []
    numbers: list = []
    letters, place, before, hasher = "", 0, "", None
    out: list[tuple] = []
    convs: list[pa.Array] = []

    def emit(role: str, text: str) -> None:
        nonlocal before
        hasher.update((("\n" if before else "") + role + ":" + text).encode())
        before = role[0]

    def made() -> str:
        return "assistant" if before == "u" else "user"

    def insertions() -> None:
        nonlocal place
        while letters[place : place + 1] == "I":
            emit(made(), "")
            place += 1

    def close() -> None:
        nonlocal letters
        letters = letters or "".join(audit)
        insertions()
        convs.append(conv)
        out.append((*numbers, letters, hasher.hexdigest()))

    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("conv_id")
        cuts = [0, *(np.flatnonzero(_changes(own)) + 1).tolist(), batch.num_rows]
        heads, audits, roles, texts, copies = (batch.column(c).to_pylist() for c in ("head", "audit", "role", "text", "copies"))
        first = [batch.column(c).to_pylist() for c in NAMES]
        for a, b in zip(cuts, cuts[1:]):
            now = own.slice(a, 1)
            if conv is None or _changes(pa.concat_arrays([conv, now]))[0]:
                if conv is not None:
                    close()
                conv, audit, numbers, letters, place, before, hasher = now, [], [], "", 0, "", hashlib.sha256()
            for i in range(a, b):
                if heads[i]:
                    if first[-1][i] is not None:
                        numbers = [c[i] for c in first]
                    audit.append(audits[i])
                    continue
                letters = letters or "".join(audit)
                for _ in range(copies[i]):
                    insertions()
                    edit, place = letters[place], place + 1
                    if edit != "D":
                        emit(roles[i] if edit == "K" else made(), texts[i])
        if len(out) >= 1000:
            yield _batch(convs, out, schema)
            convs, out = [], []
    if conv is not None:
        close()
        yield _batch(convs, out, schema)


def _batch(convs: list[pa.Array], out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(convs), *(pa.array([r[i] for r in out], schema.field(i + 1).type) for i in range(len(schema) - 1))], schema=schema)


def repaired(rows: DataFrame, damage: bool = True) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    Null roles and texts are one space, so they are blank and of no known role; a null conv_id is a conversation of its own;
    rows with a null turn come first. Rows of one turn follow each other by the SHA-256 of role and text; equal rows are the
    first of them and duplicates. A conversation without rows has zeros, an empty audit and the hash of nothing. Columns beyond
    conv_id, turn, role and text are not read; an empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = rows.sparkSession
    small_batches(spark)
    own = damaged(rows) if damage else intact(rows)
    audits = _audits(_judged(own))
    none = lambda kind: F.lit(None).cast(kind)
    texts = own.where("copies > 0").select("conv_id", F.lit(False).alias("head"), F.col("turn").alias("first"), _digest().alias("then"), "role", "text", "copies", none("string").alias("audit"), *(none("long").alias(c) for c in NAMES))
    order = F.encode(F.lpad(F.col("nth").cast("string"), 19, "0"), "utf-8")
    heads = audits.select("conv_id", F.lit(True).alias("head"), F.col("part").alias("first"), order.alias("then"), none("string").alias("role"), none("string").alias("text"), F.lit(0).alias("copies"), "audit", *NAMES)
    both = texts.unionByName(heads).repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", F.desc("head"), F.col("first").asc_nulls_first(), "then")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {HEAD}, audit string, repaired_sha256 string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return both.mapInArrow(lambda b: _hashed(b, arrow), schema)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
