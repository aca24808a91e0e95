"""Best-fit packing by length histogram.

Tasks tokenise the texts and return the pieces' lengths. The histogram of lengths (as many counts as the capacity, however
many documents there are) is planned on the driver by best-fit decreasing over counts: groups of equal sequences take as
many pieces of a length as fit, tightest groups first. The plan is a table of slots for ranges of ranks within a length;
pieces take theirs by joining on their rank within their length. Ranks are counted within (length, salt), with the salts'
totals added, so a length that a third of all documents share is dealt over many tasks.

Edge cases: a null or empty text is its end id alone, one piece of length 1; longer documents than the capacity are cut
into pieces of the capacity, the first of which may be shorter; repeated rows are packed like any others; a null id stays
null; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import saved
from .common import partitions, table, texts
from .text import slices, spread
from .tokens import crc, encoder, vocabulary, with_end

CAPACITY, END = 2048, 0
#: Plans of more ranges than this are joined by a shuffle.
BROADCAST_ROWS = 100_000
PLAN = "plan_length long, low long, high long, each long, first_sequence long, first_offset long"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end: int, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            for part, batch_texts in slices(batch):
                ids, counts = with_end(*tokens.encode(batch_texts), end)
                pieces = -(-counts // capacity)
                doc, piece = np.repeat(np.arange(len(counts)), pieces), spread(pieces)
                head = (counts - capacity * (pieces - 1))[doc]
                length = np.where(piece == 0, head, capacity)
                start = np.where(piece == 0, 0, head + capacity * (piece - 1))
                at = (np.cumsum(counts) - counts)[doc] + start
                own = [ids[a : a + n] for a, n in zip(at.tolist(), length.tolist())]
                made = [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([crc(x) for x in own], pa.int64())]
                made += [pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))] * keep_ids
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(made)])

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, each, first_sequence, first_offset): the pieces of a length with ranks low <= r < high lie `each`
    to a sequence, from first_sequence on, the first of a sequence at first_offset. Best-fit decreasing over counts."""
    open_groups: dict[int, list[tuple[int, int]]] = {}  # free room -> (first sequence, how many sequences)
    rooms: list[int] = []
    slots, next_sequence = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_groups:
                insort(rooms, room)
            open_groups.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_groups[room].pop()
                if not open_groups[room]:
                    del open_groups[room], rooms[k]
            else:
                room, first = capacity, next_sequence
                n = -(-left // (capacity // length))
                next_sequence += n
            each = room // length
            full, rest = (n, 0) if left >= n * each else divmod(left, each)
            placed = full * each + rest
            slots.append((length, rank, rank + placed, each, first, capacity - room))
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + placed, left - placed
    return slots


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, the ids of each piece."""
    spark = docs.sparkSession
    pieces = saved(texts(docs).mapInArrow(_pieces(path, capacity, end, keep_ids), PIECES + ", ids array<int>" * keep_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    slots = spark.createDataFrame(planned := plan(counts, capacity), PLAN)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(8 * partitions(spark))))
    below = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    totals = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("below"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(own) - 1).join(totals, ["length", "salt"]).withColumn("rank", F.col("nth") + F.col("below"))
    slots = F.broadcast(slots) if len(planned) <= BROADCAST_ROWS else slots
    placed = ranked.join(slots, (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    return placed.select(
        *pieces.columns[:5], (F.col("first_sequence") + F.expr("(rank - low) div each")).alias("sequence_id"),
        (F.col("first_offset") + F.col("length") * (step % F.col("each"))).alias("offset"), *pieces.columns[5:])


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, of pieces packed with keep_ids. A sequence holds `capacity` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
