"""Incremental work: rows not yet processed, as a batch or as a file stream that starts where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import by_key, discard, saved


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def require_all(rows: DataFrame, done: DataFrame, keys: list[str]) -> None:
    """An error if rows are left that were not processed."""
    left = pending(rows, done, keys).count()
    if left:
        raise ValueError(f"{left} rows were not processed")


def unseen(rows: DataFrame, seen: DataFrame | None, keys: list[str]) -> DataFrame:
    """One row of each key that is not among those seen, whole; null is a key like any other. Rows and keys are dealt once."""
    rest = [c for c in rows.columns if c not in keys]
    met = rows.select(*keys, F.struct(F.lit(True).alias("_new"), *rest).alias("_row"))
    many = rows.count()
    if seen is not None:
        met, many = met.unionByName(seen.select(*keys), allowMissingColumns=True), many + seen.count()
    first = by_key(met, keys, many).groupBy(*keys).agg(F.first("_row", ignorenulls=True).alias("_row"), F.count_if(F.col("_row").isNull()).alias("_seen"))
    return first.where("_seen = 0").select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns))


def append_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df, keys: list[str] | None = None, remember: str | None = None) -> None:
    """Process the files that came since the last call and append the results; a repeated batch replaces its own part.

    With keys, a row whose key came before is left out, in the same file or in a later one. Keys are kept for good, in files
    beside the checkpoint, a part a batch, so that no executor holds them in memory; `work` gets the new rows from a table that
    is removed afterwards. `remember` (such as "7 days") makes the keys the stream's state instead, and bounds it: they are
    forgotten when files come that are so much newer than the key's own, by the files' times. Rows of one key should be alike,
    as any of those that come in one call may be taken.
    """
    met = f"{checkpoint.rstrip('/')}-keys"
    kept = keys and not remember

    def batch(df: DataFrame, number: int) -> None:
        if kept:
            seen = df.sparkSession.read.schema(df.select(*keys).schema.add("batch", "long")).parquet(met).where(F.col("batch") < number) if number else None
            df = saved(unseen(df, seen, keys), "unseen")
            df.select(*keys).write.mode("overwrite").parquet(f"{met}/batch={number}")
        work(df).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if kept:
            discard(df)

    rows = spark.readStream.schema(schema).parquet(source)
    if keys and remember:
        rows = rows.select("*", F.col("_metadata.file_modification_time").alias("_came")).withWatermark("_came", remember).dropDuplicatesWithinWatermark(keys).drop("_came")
    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start().awaitTermination()
