"""Importance resampling towards a target: hashed n-gram weights from arrays, Gumbel scores, ranks by a radix sort."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import materialize, numbered, whole_text
from cohortloom.llm.radix_sort import BLOCK, radix_ranks

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Every byte as it is read: small ASCII letters, digits and bytes beyond ASCII stand for themselves, others part words.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: Bytes of a text whose words are held at a time.
CHUNK = 1 << 20


# Features

def buckets(text: bytes, size: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the runs of one and two words, in portions; the last word of a portion begins the next pair."""
    text, at, last = text.translate(_PLAIN), 0, None
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        at = end
        if not words:
            continue
        single = list(map(crc32, words))
        firsts, seconds = (single[:-1], words[1:]) if last is None else ([last, *single[:-1]], words)
        # The sum over "a b" goes on from that over "a".
        pairs = map(crc32, seconds, map(crc32, repeat(b" "), firsts))
        yield np.fromiter(chain(single, pairs), np.int64, len(single) + len(firsts)) % size
        last = single[-1]


def bucket_counts(texts: DataFrame, size: int = BUCKETS) -> DataFrame:
    """bucket, n over all rows of ``texts`` (text binary): one array for each task, summed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for some in buckets(text.as_py(), size):
                    total += np.bincount(some, minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket: a thousand times the log of its smoothed share in the target over that in the corpus.

    Counts are those of all rows; what reaches the driver is one number for each bucket and table.
    """
    counts = np.zeros((2, size), np.int64)
    for row, table in enumerate((docs, target)):
        for r in bucket_counts(table.select(whole_text(table).cast("binary").alias("text")), size).collect():
            counts[row, r["bucket"]] = r["n"]
    s_all, t_all = (float(c.sum() + size) for c in counts)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in counts.T.astype(float).tolist()], np.int64)


# Scores

def draw(doc_id: Column, seed: int) -> Column:
    """Unsigned 32-bit number from the digest of seed and doc_id; a null doc_id reads ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def gumbel(h: int) -> int:
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """row_id, doc_id, n_features, weight, score of every row, in one pass and without a shuffle."""
    rows = numbered(docs, whole_text(docs).cast("binary").alias("text"), draw(docs["doc_id"], seed).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros((2, batch.num_rows), np.int64)
            for k, text in enumerate(batch.column("text")):
                total = 0
                for some in buckets(text.as_py(), len(gains)):
                    n[k] += len(some)
                    total += int(gains[some].sum())
                weight[k] = total // int(n[k]) if n[k] else 0
            noise = np.array([gumbel(h) for h in batch.column("h").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(n), pa.array(weight), pa.array(weight + noise)],
                                             ["row_id", "doc_id", "n_features", "weight", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row_id long, doc_id {kind}, n_features long, weight long, score long")


# The operator

def ranked(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """row_id and rank of ``rows`` by score from the highest, then by doc_id, a missing one last.

    Both keys are shifted to begin at zero, so that digits are sorted only as far as the values reach.
    """
    span = rows.agg(F.max("score").alias("top"), F.min("score").alias("bottom"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).first()
    if span["top"] is None:
        return rows.select("row_id", F.lit(1).cast("long").alias("rank")).limit(0)
    first, last, id_ = span["first"] or 0, span["last"] or 0, F.col("doc_id").cast("long")
    if last - first < (1 << 63) - 1:
        low, bits = F.coalesce(id_ - F.lit(first), F.lit(last - first + 1)), (last - first + 1).bit_length()
    else:  # ids over the whole range of a long: the sign turned round, as unsigned numbers
        low, bits = F.coalesce(id_.bitwiseXOR(F.lit(-(1 << 63))), F.lit(-1)), 64
    keyed = rows.select("row_id", low.alias("low"), (F.lit(span["top"]) - F.col("score")).alias("high"))
    return radix_ranks(keyed, bits, (span["top"] - span["bottom"]).bit_length(), block_rows)


def importance_sample(docs: DataFrame, target: DataFrame, size: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
                      block_rows: int = BLOCK) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs``; ``rank`` is null where a row is not drawn.

    ``docs`` has an integer doc_id and text, ``target`` text; other columns are not read, null texts have no words.
    Drawn are the ``percent`` per cent (rounded down) of highest score among rows of ``min_words`` words or more; of equal
    scores the smaller doc_id, then the row read first. An empty target or corpus gives smoothed shares alone.
    """
    rows = materialize(scored(docs, bucket_gains(docs, target, size), seed))
    # n words have 2n - 1 runs.
    fit = rows.filter(F.col("n_features") >= 2 * min_words - 1)
    drawn = fit.count() * percent // 100
    ranks = ranked(fit.select("row_id", "doc_id", "score"), block_rows).filter(F.col("rank") <= drawn)
    return rows.join(ranks, "row_id", "left").select("doc_id", "n_features", "weight", "score", "rank")
