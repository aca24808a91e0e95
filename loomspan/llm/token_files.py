"""Token files: ids of whole texts in ascending doc_id order, in checksummed blocks of the adaptive range coder.

Documents are dealt by range of doc_id (rows repeated under one id are told apart by their texts' hashes, so that no range
is one id), sorted within their range, tokenised and coded. A file is a Parquet table of records; a record is the binary
that coder.write_record defines: some whole documents, and blocks of up to 2^22 ids that can be decoded on their own. Records
hold starts within their range; the ranges' totals, one number each, are added when the files are read.

Edge cases: a null or empty text is its end id alone; a null doc_id comes first and stays null; repeated rows are written
each; an empty table gives an empty file; a very long text fills many blocks; extra columns are not read. A damaged block
raises an error at reading.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path
from .coder import read_record, write_record
from .common import partitions, table, texts
from .text import slices
from .tokens import crc, encoder, vocabulary, with_end

ALPHABET, END = 49408, 1
RECORD_BYTES = 16_000_000
RECORDS = "part int, number int, n_tokens long, record binary"


def _records(path: str, end: int, alphabet: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, number, start = encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for rows, _ in slices(batch, most=RECORD_BYTES):  # many blocks side by side, tokenised a part at a time
                ids, counts = map(np.concatenate, zip(*(with_end(*tokens.encode(part), end) for _, part in slices(rows))))
                doc_ids = rows.column("doc_id")
                record = write_record(doc_ids.fill_null(0).to_numpy(), doc_ids.is_valid().to_numpy(zero_copy_only=False), counts, ids, start, alphabet)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([record], pa.binary())], ["part", "number", "n_tokens", "record"])
                number, start = number + 1, start + len(ids)

    return run


def write(docs: DataFrame, at: str, path: str, end: int = END, alphabet: int = ALPHABET) -> None:
    ordered = texts(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie")
    ordered = ordered.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(_records(path, end, alphabet), RECORDS).write.parquet(at)


def _documents(keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record, before in zip(batch.column("record"), batch.column("before").to_pylist()):
                doc_ids, known, counts, ids, start = read_record(record.as_py())
                ends = np.cumsum(counts)
                own = [ids[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist())]
                made = [pa.array(doc_ids, pa.int64(), mask=~known), pa.array(before + start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([crc(x) for x in own], pa.int64())]
                made += [pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))] * keep_ids
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(made)])

    return run


def read(spark: SparkSession, at: str, keep_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids."""
    records = spark.read.schema(RECORDS).parquet(at)
    total, before = 0, []
    for row in records.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row for each range
        before.append((row.part, total))
        total += row.n
    before = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    return records.join(before, "part").select("record", "before").mapInArrow(_documents(keep_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), at, vocabulary("word_bpe_49k.json"))
    return read(spark, at)
