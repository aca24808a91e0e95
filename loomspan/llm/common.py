"""Reading the input's columns, and the folds of the labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the labelled rows."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")), F.lit(n))


#: Texts that are handed to a Python worker at once; both sides hold several copies of them.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) alone, so that no other column of the input can clash or be read."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: Rows of a few longs that may be sent to every task.
SMALL_ROWS = 2_000_000


def small(rows: DataFrame) -> DataFrame:
    """A stored table of a few longs a row, to be broadcast if it has at most SMALL_ROWS rows; else the join shuffles. That
    changes the plan, not the result."""
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows
