"""Token counts of whole texts and of every prefix, and answers to truncation and budget questions from the stored counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts
from .prefix_counts import counter
from .text import slices
from .tokens import vocabulary

LIMIT = 4096


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_kept, the characters of the longest prefix of at most `limit` tokens.

    Null and empty texts have no token; every row is counted, repeated ones and those with a null id too; columns beyond
    doc_id and text are not read. A longer prefix may have fewer tokens than a shorter one; the longest one counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part, some in slices(batch):
                units = own.batch(some)
                tokens = units.counts()
                starts = np.append(0, np.cumsum((some.data & 0xC0) != 0x80))
                kept = starts[some.offsets[1:]] - starts[some.offsets[:-1]]
                for i in np.flatnonzero(tokens > limit).tolist():
                    kept[i] = np.flatnonzero(units.prefixes(i) <= limit)[-1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(some.offsets)), pa.array(tokens), pa.array(tokens > limit), pa.array(kept)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_kept"])

    return texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_kept long")


def prefix_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and prefix_tokens, an array: element k (from 0) is the number of tokens of the text's first k characters.

    Null and empty texts have the one element 0. Stored, it answers tokens_within and longest_within without the text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part, some in slices(batch):
                units = own.batch(some)
                every = [units.prefixes(i) for i in range(len(some))]
                values = np.concatenate(every).astype(np.int32) if every else np.zeros(0, np.int32)
                offsets = np.append(0, np.cumsum([len(x) for x in every])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "prefix_tokens"])

    return texts(docs).mapInArrow(count, "doc_id long, prefix_tokens array<int>")


def tokens_within(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first `chars` characters; of all, if there are fewer."""
    at = F.greatest(F.lit(0), F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts) - 1))
    return F.get(counts, at.cast("int"))


def longest_within(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens; null for a budget below zero."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.filter(F.sequence(F.lit(0), F.size(counts) - 1), lambda i: F.get(counts, i) <= most))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
