"""Rows of a large table beside all rows of a smaller one, in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the smaller table in a block; one block of this size may be broadcast.
MOST = 1024


def beside(rows: DataFrame, small: DataFrame, value: Column, name: str, most: int = MOST) -> tuple[DataFrame, int]:
    """rows with `name`, an array of up to about `most` values of `small`, and how many blocks there are.

    The smaller table is counted first. If it is one block it is broadcast; otherwise every row is copied for each block
    and meets it in a join on the block's number, and the caller reduces its rows again.
    """
    blocks = max(1, -(-small.count() // most))
    packed = small.select(F.pmod(F.xxhash64(value), F.lit(blocks)).alias("_block"), value.alias("_value")).groupBy("_block").agg(F.sort_array(F.collect_list("_value")).alias(name))
    copied = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return copied.join(F.broadcast(packed) if blocks == 1 else packed, "_block").drop("_block"), blocks
