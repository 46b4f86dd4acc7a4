"""A distributed radix sort: stable counting-sort passes over the digits of whole-number keys, lowest digit first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import materialize

#: Rows of a block, which one task sorts at a time, and bits of a digit.
BLOCK, DIGIT = 1 << 18, 11
#: The sorted columns: an id and two keys, read as unsigned 64-bit numbers.
COLUMNS = ("row_id", "low", "high")
ARRAYS = ", ".join(f"{c} array<long>" for c in COLUMNS)


def digits(low_bits: int, high_bits: int, width: int = DIGIT) -> list[tuple[str, int, int]]:
    """(column, shift, bits) of the passes: both keys cut into equal digits of at most ``width`` bits."""
    out = []
    for column, bits in (("low", low_bits), ("high", high_bits)):
        passes = -(-bits // width)
        edges = [bits * k // passes for k in range(passes + 1)] if passes else []
        out += [(column, a, b - a) for a, b in zip(edges, edges[1:])]
    return out


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values))


def _runs(block: int, rows: list[np.ndarray], digit: tuple[str, int, int]) -> pa.RecordBatch:
    """The rows of a block, stably by digit: one run for each digit that occurs."""
    column, shift, bits = digit
    value = (rows[COLUMNS.index(column)].view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
    order = np.argsort(value, kind="stable")
    counts = np.bincount(value)
    found = np.flatnonzero(counts)
    ends = np.cumsum(counts[found])
    return pa.RecordBatch.from_arrays(
        [pa.array(found.astype(np.int32)), pa.array(np.full(len(found), block)), pa.array(counts[found]), *[_lists(ends, r[order]) for r in rows]],
        ["digit", "block", "n", *COLUMNS])


RUNS = f"digit int, block long, n long, {ARRAYS}"


def _first_runs(rows: DataFrame, digit, block_rows: int) -> DataFrame:
    """Blocks of the rows as they are read: a block's number holds its partition and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        held, n, block = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = [batch.column(c).slice(at, block_rows).to_numpy() for c in COLUMNS]
                if held and n + len(part[0]) > block_rows:
                    yield _runs(block, [np.concatenate(x) for x in zip(*held)], digit)
                    held, n, block = [], 0, block + 1
                held.append(part)
                n += len(part[0])
        if n:
            yield _runs(block, [np.concatenate(x) for x in zip(*held)], digit)

    return rows.select(*COLUMNS).mapInArrow(run, RUNS)


def _sorted_runs(pieces: DataFrame, digit) -> DataFrame:
    """Whole blocks from their pieces, sorted by the next digit. A block has at most ``block_rows`` rows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at").combine_chunks()
        rows = [np.concatenate([np.zeros(0, np.int64), table.column(c).combine_chunks().flatten().to_numpy()]) for c in COLUMNS]
        return pa.Table.from_batches([_runs(table.column("block")[0].as_py(), rows, digit)])

    return pieces.groupBy("block").applyInArrow(run, RUNS)


def _destinations(runs: DataFrame) -> DataFrame:
    """digit, block, start: where each run begins in the order by digit, then block.

    A digit's runs are one for each block, and digits are at most 2**DIGIT, so both running sums are over thin rows
    that a task can hold: with 1e10 rows, some 40,000 blocks.
    """
    thin = runs.select("digit", "block", "n")
    before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    base = thin.groupBy("digit").agg(F.sum("n").alias("total")).select("digit", F.coalesce(F.sum("total").over(smaller), F.lit(0)).alias("base"))
    inside = thin.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return inside.join(base, "digit").select("digit", "block", (F.col("base") + F.col("before")).alias("start"))


def _moved(runs: DataFrame, block_rows: int) -> DataFrame:
    """block, at and arrays: the runs at their places in the new order, cut where a block ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, n = batch.column("start").to_numpy(), batch.column("n").to_numpy()
            if not len(n):
                continue
            pieces = (start + n - 1) // block_rows - start // block_rows + 1
            which = np.repeat(np.arange(len(n)), pieces)
            block = start[which] // block_rows + np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(block * block_rows, start[which])
            ends = np.cumsum(np.minimum((block + 1) * block_rows, (start + n)[which]) - begin)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(begin % block_rows), *[_lists(ends, batch.column(c).flatten().to_numpy()) for c in COLUMNS]],
                ["block", "at", *COLUMNS])

    placed = runs.join(_destinations(runs), ["digit", "block"])
    return placed.select("start", "n", *COLUMNS).mapInArrow(run, f"block long, at long, {ARRAYS}")


def radix_ranks(rows: DataFrame, low_bits: int, high_bits: int, block_rows: int = BLOCK, width: int = DIGIT) -> DataFrame:
    """``row_id`` and ``rank`` (1, 2, 3...) of every row by (high, low), both unsigned numbers of so many bits.

    ``rows`` has row_id, low and high (long). Rows with equal keys stay in the order in which they are read. Each pass
    sorts blocks on their own, adds up how many rows of smaller digits and earlier blocks there are, and moves
    each run to its place; runs are written to the shared folder once a pass, so a lost executor costs one pass. Equal
    keys spread over blocks like any others.
    """
    plan = digits(low_bits, high_bits, width) or [("low", 0, 1)]
    pieces = None
    for digit in plan:
        runs = materialize(_first_runs(rows, digit, block_rows) if pieces is None else _sorted_runs(pieces, digit))
        pieces = _moved(runs, block_rows)
    place = F.posexplode("row_id").alias("k", "row_id")
    return pieces.select("block", "at", place).select("row_id", (F.col("block") * block_rows + F.col("at") + F.col("k") + 1).alias("rank"))
