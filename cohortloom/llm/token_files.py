"""Token ids as Parquet list columns: delta-encoded offsets, dictionary-encoded ids, small row groups, page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.arrow_text import portions
from cohortloom.llm.common import whole_text
from cohortloom.llm.tokenizer_cache import BATCH_BYTES, encoder
from cohortloom.session import scratch_dir

#: Writer settings: version 2 pages delta-encode the integers that are no dictionary, row groups of 16 MB let a
#: reader skip to a range of doc_id, and column indexes (always written) to the pages in it.
WRITER = {"parquet.writer.version": "v2", "parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10),
          "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "compression": "snappy"}


def encode_rows(texts: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, part, at (ids before it in its part), n_tokens, ids for a frame of (doc_id, text), order kept."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, part, at = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, data, texts_at in portions(batch.column("text"), BATCH_BYTES):
                flat, counts = worker.ids(data, texts_at)
                # The end id goes behind each document's ids.
                flat = np.insert(flat, np.cumsum(counts), end_id).astype(np.int32)
                ends = np.cumsum(counts + 1)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(counts)), pa.array(np.full(len(counts), part, np.int32)),
                     pa.array(at + ends - counts - 1), pa.array(counts + 1), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                    ["doc_id", "part", "at", "n_tokens", "ids"])
                at += int(ends[-1])

    return texts.mapInArrow(encode, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, part int, at long, n_tokens long, ids array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write the ids of every document, in ascending doc_id order over the files and inside each.

    Rows are dealt by ranges of doc_id, and of a hash of the text within one doc_id, so that no id is too large
    for one task. A null doc_id comes first.
    """
    tie = F.xxhash64("text")
    ordered = (docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs).cast("binary").alias("text"))
               .repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie))
    encode_rows(ordered, tokenizer_path, end_id).write.options(**WRITER).parquet(path)


def read_token_index(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    Ids are summed up where they are read; only part totals (one row per file) are put in a running order.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
            edges = 4 * lists.offsets.to_numpy().astype(np.int64)
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("at"), pa.array(np.diff(edges) // 4), pa.array(sums, pa.int64())],
                ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(path)
    kind = files.schema["doc_id"].dataType.simpleString()
    # A selective read: the id columns are skipped.
    last = files.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("total"))
    before = [(r["part"], r["total"]) for r in last.orderBy("part").collect()]
    starts, run = [], 0
    for part, total in before:
        starts.append((part, run))
        run += total
    base = spark.createDataFrame(starts, "part int, base long")
    rows = files.mapInArrow(digest, f"doc_id {kind}, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the token files and describe every document from them: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone. Rows that repeat a doc_id follow each other. An empty table gives
    files without rows and an empty result. Other columns are not read.
    """
    path = path or scratch_dir(docs.sparkSession)
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_index(docs.sparkSession, path)
