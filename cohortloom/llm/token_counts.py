"""Token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.arrow_text import portions
from cohortloom.llm.common import whole_text
from cohortloom.llm.tokenizer_cache import BATCH_BYTES, encoder


def token_lengths(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """``n_tokens`` beside doc_id and n_bytes, for a frame of (doc_id, text, n_bytes). Texts stay in the task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(tokenizer_path)
        for batch in batches:
            rows = [worker.counts(data, offsets) for _, data, offsets in portions(batch.column("text"), BATCH_BYTES)]
            total = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(total, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    return texts.mapInArrow(count, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; null and empty texts have 0 of both.

    Long texts are cut at safe places, so a text is never one huge call; memory is bounded by the batch and the
    remembered pieces. Rows that repeat are counted each; other columns are not read.
    """
    text = whole_text(docs)
    sent = docs.select(docs["doc_id"].alias("doc_id"), text.cast("binary").alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return token_lengths(sent, tokenizer_path).withColumn("over_limit", F.col("n_tokens") > limit)
