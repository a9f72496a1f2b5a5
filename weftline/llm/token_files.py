"""Token ids as Parquet list columns, with chosen encodings, row groups and page indexes, in ascending id order.

A table of tokens is a folder of Parquet files written by Spark. `ids` is a list of integers, dictionary-encoded where the vocabulary
is small enough and plain or delta-encoded beyond it; row groups are small enough to be skipped by the minima and maxima of `doc_id`,
and every column chunk has its page index, so a reader of a few documents, or of the columns without ids, touches only their pages.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import shared_path, task_count, text_or_empty
from weftline.llm.wordbpe import tokenizer_path, word_bpe

SCHEMA = "doc_id long, run int, start_in_run long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int | None):
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, number, before = word_bpe(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # so that one batch's ids stay small
                part = batch.slice(at, 512)
                coded = [words.ids(t) + tail for t in part.column(1).cast(pa.binary()).to_pylist()]
                n = np.array([len(c) // 4 for c in coded], "i8")
                ends = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(n), number, "i4")), pa.array(before + ends[:-1]), pa.array(n), lists], ["doc_id", "run", "start_in_run", "n_tokens", "ids"])
                before += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text", runs: int | None = None, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, encoding: str = "dictionary") -> None:
    """Encode every whole text and write its ids under `path` in ascending order of `doc_id`.

    The texts are range-partitioned by id once and encoded in their final order inside the writing tasks. A row keeps the number of
    its run and its place in it, so that the place among all ids follows from one number per run. `encoding`: "dictionary", or
    "delta" for the delta-encoded pages of version 2 without dictionaries.

    Defined results: a null text is empty (its ids are the end id alone); null ids come first; rows with equal ids are ordered by
    their text's hash; an empty table gives files without rows; other columns are ignored.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    dealt = rows.repartitionByRange(runs or task_count(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    coded = dealt.mapInArrow(_encode(tokenizer or tokenizer_path(), end_id), SCHEMA)
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "v1" if encoding == "dictionary" else "v2"}
    coded.write.options(**options).parquet(path)


def run_starts(tokens: DataFrame) -> DataFrame:
    """run -> ids before it: one row per file, from the column chunks of `run` and `n_tokens` alone."""
    size = tokens.groupBy("run").agg(F.sum("n_tokens").alias("_n"))
    return size.select("run", (F.sum("_n").over(Window.orderBy("run")) - F.col("_n")).alias("run_start"))


def with_starts(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows with their run and place in it -> the same with `start`, the ids of all documents before; one number per run is joined."""
    return rows.join(run_starts(tokens), "run").withColumn("start", F.col("run_start") + F.col("start_in_run"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, read from the files; columns that are not used are not read."""
    tokens = spark.read.schema(SCHEMA).parquet(path)
    return with_starts(tokens, tokens).select("doc_id", "start", "n_tokens", "ids")


def crc32_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored rows -> the same with ids_crc32 in place of the ids."""
    for batch in batches:
        lists = batch.column(4)
        ends, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["doc_id", "run", "start_in_run", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, **options) -> DataFrame:
    """Write token files to the shared folder, read them back, and digest each document's ids where they are read: only the narrow
    rows meet the starts of the runs."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    tokens = spark.read.schema(SCHEMA).parquet(path)
    narrow = tokens.mapInArrow(crc32_of_ids, "doc_id long, run int, start_in_run long, n_tokens long, ids_crc32 long")
    return with_starts(narrow, tokens).select("doc_id", "start", "n_tokens", "ids_crc32")
