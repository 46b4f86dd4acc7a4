"""Packing into sequences along a space-filling curve: hashed document vectors, a Hilbert key, a range sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.arrow_text import portions
from cohortloom.llm.common import materialize, numbered, whole_text
from cohortloom.llm.hilbert import hilbert_key
from cohortloom.llm.rank_encoder import rank_encoder
from cohortloom.llm.tokenizer_cache import BATCH_BYTES

LENGTH, END_ID, PAD_ID = 2048, 1, 0
#: Dimensions of the hashed vectors and of their projection, bits of a cell in each, parts of one in a projected number.
HASHED, DIMS, BITS, UNIT = 512, 4, 12, 1 << 20


# Document vectors

def _mixed(values: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of whole numbers: two rounds of multiplying and folding."""
    out = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for _ in range(2):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def token_directions(n_ids: int) -> np.ndarray:
    """What one occurrence of each id adds in DIMS dimensions: its sign times the direction of its hashed dimension.

    A vector of HASHED signed counts times a matrix of signs, without building the vector.
    """
    hashed = _mixed(np.arange(n_ids))
    matrix = (_mixed(np.arange(HASHED * DIMS) + (1 << 32)) >> np.uint64(63)).astype(np.int64).reshape(HASHED, DIMS) * 2 - 1
    sign = (hashed >> np.uint64(63)).astype(np.int64) * 2 - 1
    return (matrix[(hashed % np.uint64(HASHED)).astype(np.int64)] * sign[:, None]).T.astype(np.int8)


def project(flat: np.ndarray, counts: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """(documents, DIMS) whole numbers: the mean direction of each document's ids, in parts of UNIT; zero for none."""
    out = np.zeros((len(counts), DIMS), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        first = (np.cumsum(counts) - counts)[some]
        for d in range(DIMS):
            out[some, d] = np.add.reduceat(directions[d][flat], first, dtype=np.int64) * UNIT // counts[some]
    return out


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """row_id, doc_id, n_tokens, ids (with the end id) and point (DIMS whole numbers) of every row."""
    rows = numbered(docs, whole_text(docs).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, directions = rank_encoder(tokenizer_path), None
        for batch in batches:
            for row, data, at in portions(batch.column("text"), BATCH_BYTES):
                flat, counts = worker.ids(data, at)
                if directions is None:
                    directions = token_directions(worker.size())
                points = project(flat, counts, directions)
                flat = np.insert(flat, np.cumsum(counts), end_id).astype(np.int32)
                offsets = np.append(0, np.cumsum(counts + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id").slice(row, len(counts)), batch.column("doc_id").slice(row, len(counts)), pa.array(counts + 1),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, points.size + 1, DIMS, np.int32)), pa.array(points.ravel()))],
                    ["row_id", "doc_id", "n_tokens", "ids", "point"])

    return rows.mapInArrow(run, f"row_id long, doc_id {kind}, n_tokens long, ids array<int>, point array<long>")


# The curve

def _spread(rows: DataFrame) -> list[tuple[int, int]]:
    """Mean and mean distance from it in every dimension, over all rows; whole numbers, so that reruns agree."""
    means = rows.agg(*[F.expr(f"sum(point[{d}]) div count(1)") for d in range(DIMS)]).first()
    if means[0] is None:
        return [(0, 1)] * DIMS
    far = rows.agg(*[F.expr(f"sum(abs(point[{d}] - {m}L)) div count(1)") for d, m in enumerate(means)]).first()
    return [(m, max(1, w)) for m, w in zip(means, far)]


def curve_keys(rows: DataFrame) -> DataFrame:
    """row_id, doc_id, n_tokens and key, the place of each row's point on the curve, from a frame with ``point``.

    A dimension is cut into cells by distance from the mean over all rows, finely near it: u = z / (1 + |z|).
    """
    spread = np.array(_spread(rows), np.float64)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (batch.column("point").flatten().to_numpy().reshape(-1, DIMS) - spread[:, 0]) / spread[:, 1]
            cells = ((1 + z / (1 + np.abs(z))) * (1 << (BITS - 1))).astype(np.int64)
            key = hilbert_key(np.clip(cells, 0, (1 << BITS) - 1), BITS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "doc_id", "n_tokens")), pa.array(key)], ["row_id", "doc_id", "n_tokens", "key"])

    return rows.select("row_id", "doc_id", "n_tokens", "point").mapInArrow(run, f"row_id long, doc_id {kind}, n_tokens long, key long")


def positions(keys: DataFrame) -> DataFrame:
    """row_id and position: the number of ids before each document along the curve.

    Rows are dealt by ranges of (key, doc_id, row_id), so equal points, as copies have, spread over tasks. Each task adds up
    its own rows; only its total, one number a task, is put in a running order.
    """
    ordered = keys.repartitionByRange("key", "doc_id", "row_id").sortWithinPartitions("key", "doc_id", "row_id").select("row_id", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            upto = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(upto - n), pa.array(upto)],
                                             ["row_id", "part", "at", "upto"])
            at = int(upto[-1]) if len(n) else at

    placed = materialize(ordered.mapInArrow(run, "row_id long, part int, at long, upto long"))
    base, run_ = [], 0
    for part, total in placed.groupBy("part").agg(F.max("upto")).orderBy("part").collect():
        base.append((part, run_))
        run_ += total
    starts = keys.sparkSession.createDataFrame(base, "part int, base long")
    return placed.join(F.broadcast(starts), "part").select("row_id", (F.col("base") + F.col("at")).alias("position"))


# Pieces and sequences

def cut(rows: DataFrame, length: int) -> DataFrame:
    """Documents with ids and position, cut where a sequence is full; pieces share their batch's ids."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column("position").to_numpy(), batch.column("n_tokens").to_numpy()
            pieces = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = at[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(sequence * length, at[row])
            size = np.minimum((sequence + 1) * length, (at + n)[row]) - begin
            raw = batch.column("ids").flatten().to_numpy().astype("<u4")
            ends = np.append(0, np.cumsum(size)) * 4
            ids = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(begin - at[row]), pa.array(size), ids.cast(pa.binary()), pa.array(n[row]),
                 pa.array(sequence), pa.array(begin - sequence * length)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return rows.select("doc_id", "n_tokens", "ids", "position").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents in sequences of ``length`` ids, neighbours along the curve together.

    Per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit numbers),
    doc_tokens, sequence_id, offset. A document is cut only where a sequence is full, so each sequence but the last is
    full. A null or empty text is the end id alone; rows that repeat a doc_id are packed each on its own, a missing
    doc_id first among equal points; an empty table has no pieces. Other columns are not read.

    Texts are read once. Ids are written once and moved once, when they meet their positions by row; what the curve
    sorts are thin rows.
    """
    rows = materialize(encoded(docs, tokenizer_path, end_id))
    return cut(rows.join(positions(curve_keys(rows)), "row_id"), length)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = PAD_ID) -> DataFrame:
    """sequence_id, ids (binary), n_tokens, doc_ids: whole sequences from their pieces.

    The last one is padded to ``length`` unless its length is a power of two.
    """
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = pieces.groupBy("sequence_id").agg(inside.alias("inside"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("inside", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    padded = F.rpad(joined, length * 4, pad_id.to_bytes(4, "little"))
    whole = F.bit_count("n_tokens") == 1
    return rows.select("sequence_id", F.when(whole, joined).otherwise(padded).alias("ids"), "n_tokens", F.col("inside.doc_id").alias("doc_ids"))


def packed_pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The pieces of ``pack`` with a checksum in place of their ids."""
    return pack(docs, tokenizer_path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
