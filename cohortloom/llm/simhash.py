"""SimHash near-duplicates: fingerprints linked through Gray-ordered hierarchical indexes of masked bit patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import keep_rows, materialize, numbered, text_key, whole_text
from cohortloom.llm.components import components
from cohortloom.llm.tokenizer_cache import balanced

WORDS, SEED, MAX_BITS = 3, 42, 2
BATCH_CHARS = 1 << 19
#: Fingerprints of a group that one task indexes; a larger group is divided by the next bits, never cut.
GROUP = 4096
FAN = 16


# Fingerprints

def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of every run of ``words`` words; bytes.lower and bytes.split know ASCII letters and white space only."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if len(w) < words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else []
    return [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*[w[i:] for i in range(words)]))]


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bit is set if it is in more than half of a text's hashes; zero for none."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        first = (np.cumsum(counts) - counts)[some]
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        set_ = 2 * ones.astype(np.int64) > counts[some][:, None]
        out[some] = np.packbits(set_, axis=1).view(">u8").ravel()
    return out


def fingerprinted(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``fp``, the 64 bits as a long, for a frame of (row_id, doc_id, text_key, text)."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for some in balanced(batch.column("text").to_pylist(), BATCH_CHARS):
                lists = [shingle_hashes(t, words) for t in some]
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                parts.append(fingerprints(np.array([h for one in lists for h in one], np.uint64), counts))
            fp = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "doc_id", "text_key")), pa.array(fp)], ["row_id", "doc_id", "text_key", "fp"])

    return texts.mapInArrow(run, f"row_id long, doc_id {kind}, text_key string, fp long")


# The index

def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray sequence."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _node(pattern: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes over FAN neighbours each: the bits that all of them share, and their values."""
    at = np.arange(0, len(pattern), FAN)
    both_one = np.bitwise_and.reduceat(pattern & mask, at)
    both_zero = np.bitwise_and.reduceat(~pattern & mask, at)
    return both_one, both_one | both_zero


def linked_pairs(values: np.ndarray, group: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of distinct values of one group that differ in at most ``max_bits`` bits.

    ``values`` are sorted by group and Gray rank. Levels of nodes hold the bits that everything below shares; a pair
    of nodes is dropped with all below it once the differences of the shared bits add up to more than allowed.
    Nodes never cross groups: each group's leaves start at a node of their own.
    """
    size = np.diff(np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)))
    first = np.cumsum(size) - size
    big = size > 1
    size, first = size[big], first[big]
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, reach = 0, 1
    while reach < size.max():
        depth, reach = depth + 1, reach * FAN
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for low, high in [(FAN ** d if d else 1, FAN ** (d + 1)) for d in range(depth)]:
        some = (size > low) & (size <= high)
        for start in range(0, int(some.sum()), max(1, (1 << 17) // high)):
            stop = start + max(1, (1 << 17) // high)
            found += _search(values, first[some][start:stop], size[some][start:stop], high, max_bits)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _search(values, first, size, width, max_bits):
    """Groups of up to ``width`` members, padded to it by their last member; nodes of padding alone are not real."""
    if not len(first):
        return []
    place = first[:, None] + np.minimum(np.arange(width), size[:, None] - 1)
    levels = [(values[place.ravel()], np.full(place.size, ~np.uint64(0)), (np.arange(width) < size[:, None]).ravel())]
    while len(levels[-1][0]) > len(first):
        pattern, mask, real = levels[-1]
        levels.append((*_node(pattern, mask), real[::FAN]))
    a = b = np.arange(len(first))
    fan = np.arange(FAN)
    for level, (pattern, mask, real) in reversed(list(enumerate(levels[:-1]))):
        keep_a, keep_b = [], []
        for s in range(0, len(a), 1 << 13):
            x = (a[s:s + (1 << 13), None, None] * FAN + fan[None, :, None])
            y = (b[s:s + (1 << 13), None, None] * FAN + fan[None, None, :])
            x, y = (z.ravel() for z in np.broadcast_arrays(x, y))
            ok = ((y > x) | ((y == x) & (level > 0))) & real[y] & real[x]
            x, y = x[ok], y[ok]
            near = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= max_bits
            keep_a.append(x[near])
            keep_b.append(y[near])
        a, b = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (keep_a, keep_b))
    flat = place.ravel()
    return [(flat[a], flat[b])]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest place reachable for each of ``n`` places, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(nxt := root[root], root):
            root = nxt
        if np.array_equal(root, before):
            return root


def reach(values: np.ndarray, max_bits: int) -> np.ndarray:
    """The same for all pairs of one large group, in memory of the group's size: what a member reaches is settled at
    once, and each member is compared only with those not yet reached."""
    root = np.arange(len(values))
    open_ = np.arange(len(values))
    while len(open_):
        head, open_ = open_[0], open_[1:]
        queue = [head]
        while queue and len(open_):
            near = np.bitwise_count(values[open_] ^ values[queue.pop()]) <= max_bits
            got = open_[near]
            root[got] = head
            queue.extend(got.tolist())
            open_ = open_[~near]
    return root


# Dealing out

def _blocks(free: list[int]) -> list[list[int]]:
    """MAX_BITS + 1 blocks of the free bit places: of two values that link, one block at least is equal."""
    return [free[k * len(free) // (MAX_BITS + 1):(k + 1) * len(free) // (MAX_BITS + 1)] for k in range(MAX_BITS + 1)]


def _paths(path: tuple[int, ...]) -> tuple[list[int], list[list[int]]]:
    """The free bits after taking blocks along a path, and the blocks to take next."""
    free = list(range(64))
    for k in path:
        block = _blocks(free)[k]
        free = [i for i in free if i not in block]
    return free, _blocks(free)


def _signed(places: list[int]) -> int:
    mask = sum(1 << i for i in places)
    return mask - (1 << 64) if mask >> 63 else mask


def _divide(rows: DataFrame, depth: int) -> DataFrame:
    """Each (path, fp) goes to the three groups that share one more block: the path as a number, the shared bits as key."""
    def taken(path: int) -> tuple[int, ...]:
        return tuple(path // 3 ** d % 3 for d in range(depth))

    routes = []
    for path in range(3 ** depth):
        free, blocks = _paths(taken(path))
        shared = [i for i in range(64) if i not in free]
        for k, block in enumerate(blocks):
            routes.append((path, path + k * 3 ** depth, _signed(shared + block)))
    mask = F.create_map(*[x for p in range(3 ** depth) for x in (F.lit(p), F.array(*[F.struct(F.lit(q).alias("path"), F.lit(m).alias("mask")) for r, q, m in routes if r == p]))])
    return (rows.select("fp", F.explode(F.element_at(mask, F.col("path"))).alias("r"))
            .select(F.col("r.path").alias("path"), F.col("fp").bitwiseAND(F.col("r.mask")).alias("key"), "fp"))


def _index_groups(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) of a spanning forest of every group; rows of a group meet in one task, sorted by Gray rank."""
    gray = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, shift))
    # The unsigned order of the rank: flip its highest bit.
    ordered = (rows.repartition("path", "key").withColumn("gray", gray.bitwiseXOR(F.lit(-(1 << 63))))
               .sortWithinPartitions("path", "key", "gray"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            now = None if batch is None else [batch.column(c).to_numpy() for c in ("path", "key", "fp")]
            if now is not None and held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            ready, held = _whole_groups(held if now is None else now, last=now is None)
            if ready is None:
                continue
            path, key, fp = ready
            group = np.cumsum(np.append(False, (path[1:] != path[:-1]) | (key[1:] != key[:-1])))
            root = roots(fp.view(np.uint64), group, max_bits)
            child = np.flatnonzero(root != np.arange(len(root)))
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root[child]])], ["a", "b"])

    return ordered.select("path", "key", "fp").mapInArrow(search, "a long, b long")


def roots(values: np.ndarray, group: np.ndarray, max_bits: int) -> np.ndarray:
    """For sorted members of groups, a member each is linked to, directly or over others of its group."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(start, len(group)))
    root = np.arange(len(values))
    usual = np.repeat(size <= GROUP, size)
    place = np.flatnonzero(usual)
    a, b = linked_pairs(values[usual], group[usual], max_bits)
    root[place] = place[forest(a, b, len(place))]
    for s, n in zip(start[size > GROUP], size[size > GROUP]):
        root[s:s + n] = s + reach(values[s:s + n], max_bits)
    return root


def _with_end(batches):
    yield from batches
    yield None


def _whole_groups(rows, last: bool):
    """The rows up to the last change of group, and the rest, whose group may go on."""
    if rows is None or not len(rows[0]):
        return None, None
    if last:
        return rows, None
    path, key = rows[:2]
    change = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1]))
    if not len(change):
        return None, rows
    cut = change[-1] + 1
    return [x[:cut] for x in rows], [x[cut:] for x in rows]


def links(values: DataFrame, group: int = GROUP) -> DataFrame:
    """Links between distinct fingerprints (``fp``) such that components are those of all pairs within MAX_BITS bits.

    Of two values within the limit, one of three blocks of bits is equal, so they meet in a group that shares it. A
    group of more than ``group`` values is divided again by three blocks of its other bits, and so on; after four
    times at most 2**13 values share all taken bits, so a task's share is bounded without leaving out anything.
    """
    made = None
    rows = values.select(F.lit(0).alias("path"), "fp")
    for depth in range(4):
        dealt = materialize(_divide(rows, depth))
        large = dealt.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select("path", "key")
        large = materialize(large)
        done = depth == 3 or large.isEmpty()
        small = dealt if done else dealt.join(large, ["path", "key"], "left_anti")
        found = materialize(_index_groups(small))
        made = found if made is None else made.unionByName(found)
        if done:
            return made
        rows = dealt.join(large, ["path", "key"], "left_semi").select("path", "fp").distinct()
    return made


# The operator

def simhash_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """row_id, doc_id, text_key, fp of every row, written once."""
    return materialize(fingerprinted(numbered(docs, text_key(docs).alias("text_key"), whole_text(docs).alias("text")), words))


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row_id").alias("c"), F.col("text_key").alias("d"))


def classes(rows: DataFrame) -> DataFrame:
    """``fp`` and the first row of its component, for every distinct fingerprint."""
    values = materialize(rows.groupBy("fp").agg(F.min(_first()).alias("first")))
    rooted = components(links(values.select("fp")))
    joined = values.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined)
    best = joined.groupBy("root").agg(F.min("first").alias("best"))
    return joined.join(best, "root").select("fp", "best")


def simhash(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row.

    Null and blank texts have fingerprint zero and link like any other. A component without any doc_id has a null
    component_id. Rows that repeat share fingerprint and component; other columns are ignored.
    """
    rows = simhash_rows(docs, words)
    return rows.join(classes(rows), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                                F.col("best.b").alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of each component of ``simhash``, that of the smallest doc_id, with all columns."""
    rows = simhash_rows(docs, words)
    best = materialize(classes(rows).select(F.col("best.b").alias("doc_id"), F.col("best.d").alias("text_key")).distinct())
    return keep_rows(docs, best, rows)
