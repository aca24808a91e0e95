"""A corpus pipeline of five stages, each of which calls one operator of loomspan.llm on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet to the shared folder and
read again as the next one's docs. All but the last return the columns of documents.

Edge cases, in every stage: columns beyond doc_id and text are carried along, whatever their names; an empty table gives an
empty one; a null doc_id is kept. Each stage's docstring says what becomes of null and empty texts and of repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import copies, decontaminate, packing, pii, simhash, toxicity
from loomspan.llm.common import table
from loomspan.llm.tokens import vocabulary
from loomspan.shared import saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, scores below its threshold. Null and empty texts score 0
    and stay; repeated rows share one decision; without labels of both kinds all documents stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies (five-word Jaccard similarity 0.8 or more).

    Null, empty and white-space texts are copies of each other; null ids come after all others; of repeated rows one stays."""
    return simhash.keep_one(docs, copies.mark)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts hold none; repeated rows share one decision."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its kind in place of each piece of personal data. Null texts stay null; all rows stay."""
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens. Null and empty texts are one end id; repeated rows
    are packed each."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Trained models decide in the first and fourth stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
