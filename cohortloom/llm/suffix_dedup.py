"""Removal of repeated strings by suffix arrays over the places that repeat.

A string of LENGTH bytes holds at least one anchor: the least of its K-byte hashes. Equal strings have their anchor at
the same place, so strings are compared among equal anchors only. Equal surroundings of an anchor are settled by
their hashes; only anchors that stand in different surroundings (near the edges of repeated passages) are sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.arrow_text import joined, portions
from cohortloom.llm.common import materialize, whole_text
from cohortloom.llm.lyndon import suffix_order

LENGTH, K = 100, 32
#: An anchor is the least hash of SPAN neighbouring ones; it may stand up to SPAN - 1 bytes behind the string's start.
SPAN = LENGTH - K + 1
WIDTH = SPAN - 1 + LENGTH
BATCH_BYTES, SORT_ROWS = 1 << 20, 512
_ODD = 0x5851F42D4C957F2D
_MIX = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(100).integers(0, 1 << 64, 256, dtype=np.uint64)


def ordered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text: ``row`` is unique and ascends with doc_id (null last); it is the doc_id itself if that is unique."""
    text = whole_text(docs).cast("binary")
    one = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.count_distinct("doc_id").alias("different")).first()
    if one["n"] == one["ids"] == one["different"] and docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        row = docs["doc_id"].cast("long")
        # The filter keeps all rows. It makes the text's two joins by row ask for the same exchange.
        return docs.select(row.alias("row"), text.alias("text")).filter("row is not null")
    return _numbered(docs, text)


def _numbered(docs: DataFrame, text) -> DataFrame:
    """Rows that repeat a doc_id, or have none, in an order of their own: by text digest, then as read."""
    raw = materialize(docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("digest"),
                                  F.monotonically_increasing_id().alias("read")))
    keys = [F.col("doc_id").asc_nulls_last(), "digest", "read"]
    parts = materialize(raw.select("doc_id", "digest", "read").repartitionByRange(*keys).sortWithinPartitions(*keys)
                        .withColumn("place", F.monotonically_increasing_id()))
    # The upper bits of the number are the range it comes from, so numbers ascend with the order.
    return raw.join(parts.select("read", F.col("place").alias("row")), "read").select("row", "doc_id", "text")


# Anchors

def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place on (K a power of two); the last K - 1 places are void."""
    out, size = _TABLE[data], 1
    while size < K:
        out[:-size] = out[:-size] * np.uint64(pow(_MIX, size, 1 << 64)) + out[size:] if len(out) > size else out[:-size]
        size *= 2
    return out ^ (out >> np.uint64(31))


def _slide(values: np.ndarray, best, forward: bool) -> np.ndarray:
    """``best`` of SPAN neighbours from (or up to) each place, by doubling."""
    out, size = values.copy(), 1
    while size < SPAN:
        step = min(size, SPAN - size)
        if forward:
            out[:-step] = best(out[:-step], out[step:])
        else:
            out[step:] = best(out[step:], out[:-step])
        size += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Places of the anchors in joined texts, their texts, their hashes, and a hash of their surroundings."""
    n = len(data)
    nothing = np.zeros(0, np.int64)
    if n < LENGTH:
        return nothing, nothing, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    value = _hashes(data)
    end = np.repeat(offsets[1:], np.diff(offsets))
    whole = np.arange(n) + LENGTH <= end  # a string begins here
    least = np.where(whole, _slide(value, np.minimum, True), np.uint64(0))
    place = np.flatnonzero(_slide(least, np.maximum, False) == value)
    place = place[place + K <= end[place]]
    text = np.searchsorted(offsets, place, "right") - 1
    left = np.minimum(place - offsets[text], SPAN - 1)
    right = np.minimum(offsets[text + 1] - place, LENGTH)
    keep = left + right >= LENGTH
    place, text, left, right = place[keep], text[keep], left[keep], right[keep]
    mixed = (left * LENGTH + right).astype(np.uint64)
    begin, stop = place - left, place + right - K
    for step in (*range(0, WIDTH - K, K), WIDTH - K):  # covers every byte of the surroundings
        mixed = (mixed ^ value[np.minimum(begin + step, stop)]) * np.uint64(_MIX)
        mixed ^= mixed >> np.uint64(29)
    return place - offsets[text], text, value[place], mixed


def find_anchors(texts: DataFrame) -> DataFrame:
    """Anchors (klass, around, row, pos, stop = -1), and spans (row, pos, stop) already known to repeat.

    Of equal anchors in equal surroundings within a batch only the first is sent on; the others repeat it. So the
    rows of a hot passage are as many as batches, not documents. Spans take any class, to travel with the anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in portions(batch.column("text"), BATCH_BYTES):
                rows = batch.column("row").slice(first, len(offsets) - 1).to_numpy()
                pos, text, klass, around = anchors(data, offsets)
                row = rows[text]
                order = np.lexsort((pos, row, around, klass))
                pos, row, klass, around, text = (x[order] for x in (pos, row, klass, around, text))
                again = np.append(False, (klass[1:] == klass[:-1]) & (around[1:] == around[:-1]))[:len(pos)]
                size = (offsets[1:] - offsets[:-1])[text]
                span_row, begin, stop = merged_spans(row[again], np.maximum(pos[again] - SPAN + 1, 0), np.minimum(pos[again] + LENGTH, size[again]))
                fresh, none = ~again, np.zeros(len(stop), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in ((klass[fresh].view(np.int64), span_row * np.int64(_ODD) + begin),
                                                           (around[fresh].view(np.int64), none), (row[fresh], span_row),
                                                           (pos[fresh], begin), (np.full(int(fresh.sum()), -1), stop))],
                    ["klass", "around", "row", "pos", "stop"])

    return texts.select("row", "text").mapInArrow(run, "klass long, around long, row long, pos long, stop long")


# Classes of equal anchors

def _runs(change: np.ndarray) -> np.ndarray:
    return np.cumsum(np.append(True, change)) - 1


def settle(found: DataFrame) -> DataFrame:
    """Anchors by class, in order: spans that repeat (stop > 0), and the first anchor of each of several surroundings
    (stop = -1), which have to be compared byte by byte. A batch goes on until its last class is whole."""
    dealt = found.repartition("klass").sortWithinPartitions("klass", "around", "row", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("klass", "around", "row", "pos", "stop")
        for now in whole_classes([b.column(c).to_numpy() for c in names] for b in batches):
            span = now[4] > 0
            if span.any():
                yield pa.RecordBatch.from_arrays([pa.array(now[k][span]) for k in (0, 2, 3, 4)], ["klass", "row", "pos", "stop"])
            klass, around, row, pos, _ = (x[~span] for x in now)
            if not len(klass):
                continue
            kin = _runs(klass[1:] != klass[:-1])
            same = _runs((klass[1:] != klass[:-1]) | (around[1:] != around[:-1]))
            first = np.append(True, same[1:] != same[:-1])
            kinds = np.bincount(kin[first])[kin]
            asked = first & (kinds > 1)
            out = ~first | asked
            begin = np.where(first, pos, np.maximum(pos - SPAN + 1, 0))[out]
            # The end of the text is not known here; spans are cut to it when they are applied.
            stop = np.where(first, -1, pos + LENGTH)[out]
            yield pa.RecordBatch.from_arrays([pa.array(klass[out]), pa.array(row[out]), pa.array(begin), pa.array(stop)], ["klass", "row", "pos", "stop"])

    return dealt.mapInArrow(run, "klass long, row long, pos long, stop long")


def whole_classes(batches):
    """Lists of arrays, cut where the first array changes; what is held over is the last class."""
    held = None
    for now in batches:
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        change = np.flatnonzero(held[0][1:] != held[0][:-1])
        if len(change):
            cut = change[-1] + 1
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def surroundings(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """klass, row, begin and the bytes around each asked-for anchor."""
    wanted = asked.groupBy("row").agg(F.collect_list(F.struct("klass", "pos")).alias("wanted"))  # anchors of one text
    both = texts.select("row", "text").join(wanted, "row")
    begin = F.greatest(F.col("w.pos") - (SPAN - 1), F.lit(0))
    return (both.select("row", "text", F.explode("wanted").alias("w"))
            .select("w.klass", "row", begin.alias("begin"),
                    F.substring("text", (begin + 1).cast("int"), (F.col("w.pos") + LENGTH - begin).cast("int")).alias("bytes")))


def compare(around: DataFrame) -> DataFrame:
    """Spans (row, pos, stop) of strings that also start earlier, by a suffix array over each class's surroundings."""
    dealt = around.repartition("klass").sortWithinPartitions("klass", "row", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays():
            for b in batches:
                data, offsets = joined(b.column("bytes"))
                size = np.diff(offsets)
                matrix = np.zeros((b.num_rows, WIDTH + 16), np.uint8)
                matrix[np.arange(WIDTH + 16) < size[:, None]] = data
                yield [b.column("klass").to_numpy(), b.column("row").to_numpy(), b.column("begin").to_numpy(), size, matrix]

        for klass, row, begin, size, matrix in whole_classes(arrays()):
            starts = np.append(np.flatnonzero(np.append(True, klass[1:] != klass[:-1])), len(klass))
            at = 0
            while at < len(starts) - 1:
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + SORT_ROWS, "right")) - 1)
                some = slice(starts[at], starts[to])
                yield _repeats(row[some], begin[some], size[some], matrix[some])
                at = to

    return dealt.mapInArrow(run, "row long, pos long, stop long")


def _repeats(row: np.ndarray, begin: np.ndarray, size: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    width = matrix.shape[1]
    starts = np.flatnonzero((np.arange(width) + LENGTH <= size[:, None]).ravel())
    place, same = suffix_order(matrix, size, LENGTH, starts)
    context = place // width
    rows, at = row[context], begin[context] + place % width
    group = np.cumsum(~same)
    order = np.lexsort((at, rows, group))
    group, rows, at = group[order], rows[order], at[order]
    later = np.append(False, group[1:] == group[:-1])[:len(group)]
    # The same place seen from two anchors is no repetition.
    first = np.flatnonzero(~later)
    origin = first[np.cumsum(~later) - 1] if len(first) else first
    later &= (rows != rows[origin]) | (at != at[origin])
    spans = merged_spans(rows[later], at[later], at[later] + LENGTH)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in spans], ["row", "pos", "stop"])


def merged_spans(row: np.ndarray, pos: np.ndarray, stop: np.ndarray):
    """Spans that overlap or touch become one."""
    order = np.lexsort((pos, row))
    row, pos, stop = row[order], pos[order], stop[order]
    if not len(row):
        return row, pos, stop
    # Within a row the furthest end so far; rows are kept apart by adding more than any place.
    wide = int(stop.max()) + 1
    number = _runs(row[1:] != row[:-1])
    reach = np.maximum.accumulate(stop + number * wide)
    first = np.append(True, (pos + number * wide)[1:] > reach[:-1])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(row) - 1)
    return row[first], pos[first], reach[last] - number[last] * wide


# The operator

def repeated_spans(texts: DataFrame) -> DataFrame:
    """row, spans: for each row the stretches to remove."""
    settled = materialize(settle(find_anchors(texts)))
    sorted_ = compare(surroundings(texts, settled.filter("stop < 0").select("klass", "row", "pos")))
    spans = settled.filter("stop > 0").select("row", "pos", "stop").unionByName(sorted_)
    return spans.groupBy("row").agg(F.collect_list(F.struct("pos", "stop")).alias("spans"))  # those of one text


def cut_out(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """row, n_bytes, n_removed, n_spans, kept_sha256 after the spans are taken from each text."""
    both = texts.select("row", "text").join(spans, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = joined(batch.column("text"))
            removed, count, digest = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            lists = batch.column("spans")
            edges = lists.offsets.to_numpy()
            pos, stop = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            full = lists.is_valid().to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                text = data[offsets[k]:offsets[k + 1]]
                if full[k] and edges[k + 1] > edges[k]:
                    p, s = pos[edges[k]:edges[k + 1]], np.minimum(stop[edges[k]:edges[k + 1]], len(text))
                    _, p, s = merged_spans(np.zeros(len(p), np.int64), p, s)
                    removed[k], count[k] = (s - p).sum(), len(p)
                    kept = hashlib.sha256()
                    for a, b in zip(np.append(0, s), np.append(p, len(text))):
                        kept.update(text[a:b])
                    digest.append(kept.hexdigest())
                else:
                    digest.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(count), pa.array(digest)],
                                             ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.select("row", "text", "spans").mapInArrow(run, "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Strings are judged on the input. Null and empty texts, and texts under LENGTH bytes, lose nothing. Rows that repeat
    a doc_id, or have none (they come last), are ordered by the digest of their text; other columns are ignored.
    """
    texts = ordered(docs)
    if "doc_id" not in texts.columns:
        kind = docs.schema["doc_id"].dataType
        return cut_out(texts, repeated_spans(texts)).select(F.col("row").cast(kind).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    texts = materialize(texts)
    names = texts.select(F.col("row").alias("_row"), "doc_id")
    return (cut_out(texts, repeated_spans(texts)).join(names, F.col("row") == F.col("_row"))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
