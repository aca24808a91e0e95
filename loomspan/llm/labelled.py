"""A bounded sample of labelled rows outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, texts


def sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, rows: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most `rows` labelled ids, the first ones by a hash of the id.

    Rows with a null id or label, or another label, are left out. Of an id's several labels the greatest holds, of its
    several texts the least.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    own = own.where((fold("doc_id", folds) != held) & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # so few that they may be broadcast
    return texts(docs).join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
