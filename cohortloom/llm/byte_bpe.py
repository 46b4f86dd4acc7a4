"""Byte-level BPE: pre-tokens by a scan over transition functions, cached pair merging, decoding by offsets."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortloom.llm.common import whole_text
from cohortloom.llm.piece_store import PieceStore, spread, sums
from cohortloom.llm.tokenizer_cache import balanced

#: Characters worked on at a time, pre-tokens remembered.
BATCH_CHARS, MEMORY = 1 << 19, 600_000
#: Between texts of a batch; no character has this number.
END = 0x110000

# Symbols of the scan. A codepoint class alone, or with what stands next to it.
LETTER, NUMBER, OTHER, SPACE, JOIN, ALONE, SHORT, LONG, STOP = range(9)
# States: what the last character is part of.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, LED, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8
#: White space as the pattern's \s has it, where Python's isspace differs.
NOT_SPACE = {0x1C, 0x1D, 0x1E, 0x1F}
#: Endings that the pattern takes with an apostrophe (fixed values).
SHORT_ENDS, LONG_ENDS = ("s", "t", "m", "d"), ("re", "ve", "ll")


@functools.cache
def classes() -> np.ndarray:
    """Class of every codepoint, from the general categories that the pattern names."""
    table = np.full(END + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
        elif chr(c).isspace() and c not in NOT_SPACE:
            table[c] = SPACE
    table[END] = STOP
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether the character begins a pre-token."""
    if symbol == STOP:
        return START, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return START, False
    if symbol in (LETTER, NUMBER, OTHER):
        run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}[symbol]
        return run, state not in (run, LED)
    if symbol in (SHORT, LONG):  # an apostrophe with an ending: taken only where a match begins
        if state in (IN_OTHERS, LED):
            return IN_OTHERS, False
        return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    if symbol == SPACE:
        return IN_SPACE, state != IN_SPACE
    if symbol == JOIN:  # the last blank before a word goes with the word
        return LED, True
    return START, True  # ALONE: other white space before a word stands for itself


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the symbols' transition functions, by number: symbol -> function, product, image of START
    under a function after a carried state, and where a symbol begins a pre-token in a state."""
    single = [tuple(_step(q, s)[0] for q in range(STATES)) for s in range(9)]
    known: dict[tuple, int] = {}
    order = [tuple(range(STATES))]
    known[order[0]] = 0
    for f in order:  # grows while it is read
        for g in single:
            h = tuple(g[q] for q in f)
            if h not in known:
                known[h] = len(order)
                order.append(h)
    product = np.array([[known[tuple(g[q] for q in f)] for g in order] for f in order], np.int32)
    begins = np.array([[_step(q, s)[1] for s in range(9)] for q in range(STATES)])
    return np.array([known[f] for f in single], np.int32), product, np.array(order, np.uint8), begins


def scan(functions: np.ndarray, width: int = 64) -> np.ndarray:
    """Number of the composition of functions[0..i] for every i: an inclusive scan in blocks, then over the blocks."""
    _, product, _, _ = monoid()
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], functions[i]]
        return out
    rows = -(-n // width)
    block = np.zeros((width, rows), np.int32)  # 0 is the identity
    padded = np.zeros(rows * width, np.int32)
    padded[:n] = functions
    block[:] = padded.reshape(rows, width).T
    flat, size = product.ravel(), len(product)
    for k in range(1, width):
        block[k] = flat[block[k - 1] * size + block[k]]
    carried = np.concatenate([[0], scan(block[-1])[:-1]]).astype(np.int32)
    return flat[carried * size + block].T.ravel()[:n]


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbol of every codepoint; texts are closed by END."""
    kind = classes()[points]
    out = kind.copy()
    space = kind == SPACE
    after = np.append(kind[1:], STOP)
    last = space & (after != SPACE) & (after != STOP)
    out[last] = ALONE
    out[last & (points == 0x20)] = JOIN
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        padded = np.append(points, [END, END])
        one, two = padded[marks + 1], padded[marks + 2]
        out[marks[np.isin(one, [ord(c) for c in SHORT_ENDS])]] = SHORT
        long = np.zeros(len(marks), bool)
        for a, b in LONG_ENDS:
            long |= (one == ord(a)) & (two == ord(b))
        out[marks[long]] = LONG
    return out


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin (END counts as one)."""
    of_symbol, _, image, begins = monoid()
    symbol = symbols(points)
    state = image[scan(of_symbol[symbol]), START]
    before = np.concatenate([[START], state[:-1]])
    return np.flatnonzero(begins[before, symbol])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always merge the leftmost pair of lowest rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 200:
        return _merge_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    none = 1 << 60
    get = ranks.get
    pairs = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and linked neighbours, n log n for a text without white space."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(piece[i:end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Merger:
    """Pair merging for many pre-tokens at once: in each round every one of them merges its best pair.

    Pre-tokens are rows of a matrix by length; a row is done when no pair of it has a rank. The ranks of pairs of ids
    are a sorted table with every split of every word into two words.
    """

    WIDTHS = (4, 8, 16, 32)
    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = sorted((a << 32 | b, rank) for word, rank in ranks.items() for i in range(1, len(word))
                       if (a := ranks.get(word[:i])) is not None and (b := ranks.get(word[i:])) is not None)
        table = np.array(pairs, np.int64).reshape(-1, 2)
        self.keys, self.rank = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1], self.NONE)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], self.NONE)

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        get = self.ranks.get
        out: list = [None if (whole := get(p)) is None else [whole] for p in pieces]
        low = 0
        for width in self.WIDTHS:
            rows = [k for k, p in enumerate(pieces) if out[k] is None and low < len(p) <= width]
            if rows:
                for k, ids in zip(rows, self._rows([pieces[k] for k in rows], width)):
                    out[k] = ids
            low = width
        return [merge(p, self.ranks) if ids is None else ids for p, ids in zip(pieces, out)]

    def _rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        column = np.arange(width)
        done = np.full((len(pieces), width + 1), -1, np.int64)  # one column more: what lies behind the last
        done[:, :width] = np.where(column < size[:, None], self.single[raw], -1)
        ids, rank, rows = done.copy(), self._pairs(done[:, :-1], done[:, 1:]), np.arange(len(pieces))
        while len(rows):
            at = rank.argmin(axis=1)
            here = np.arange(len(rows))
            best = rank[here, at]
            more = best < self.NONE
            if not more.all():
                done[rows[~more]] = ids[~more]
                ids, rank, rows, at, best = ids[more], rank[more], rows[more], at[more], best[more]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            after = column > at[:, None]
            ids[:, :width] = np.where(after, ids[:, 1:], ids[:, :width])
            ids[:, width] = -1
            ids[here, at] = best
            rank[:, :-1] = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = self.NONE
            rank[here, at] = self._pairs(best, ids[here, at + 1])
            left = np.maximum(at - 1, 0)
            rank[here, left] = np.where(at > 0, self._pairs(ids[here, left], ids[here, left + 1]), rank[here, left])
        return [row[:row.index(-1)] for row in done.tolist()]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, path: str):
        self.ranks = ranks = load_ranks(path)
        merger = Merger(ranks)
        self.store = PieceStore(lambda pieces: merger([p.encode("utf-8", "surrogatepass") for p in pieces]), MEMORY)
        width = max(ranks.values()) + 1
        words = [b""] * width
        for word, rank in ranks.items():
            words[rank] = word
        self.size = np.fromiter(map(len, words), np.int64, width)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other and the number of ids of each text."""
        joined = "".join(texts)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.full(len(joined) + len(texts), END, np.int64)
        ends = np.cumsum(length + 1) - 1
        inside = np.ones(len(points), bool)
        inside[ends] = False
        points[inside] = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        begin = boundaries(points)
        stops = np.searchsorted(begin, ends)  # END begins a pre-token, too: those are left out
        text_of = np.searchsorted(ends, begin)
        real = np.ones(len(begin), bool)
        real[stops] = False
        at = begin - text_of  # place in the joined text
        first, last = at[real], np.append(at[1:], len(joined))[real]
        pieces = [joined[a:b] for a, b in zip(first.tolist(), last.tolist())]
        self.store.forget()
        number = self.store.number(pieces)
        counts = np.bincount(text_of[real], minlength=len(texts))
        return self.store.ids(number), sums(self.store.lengths[number], counts)

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids and where each id's bytes end."""
        size = self.size[ids]
        return self.bytes[spread(self.start[ids], size)].tobytes(), np.cumsum(size)


@functools.cache
def worker_codec(path: str) -> Codec:
    """One for each Python worker: what a task has learnt serves the next."""
    return Codec(path)


def coded(texts: DataFrame, ranks_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) for a frame of (doc_id, text)."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(ranks_path)
        for batch in batches:
            row = 0
            for some in balanced(batch.column("text").to_pylist(), BATCH_CHARS):
                ids, counts = codec.encode(some)
                ends = np.cumsum(counts)
                raw, byte_ends = codec.decode(ids)
                byte_at = np.concatenate([[0], byte_ends])
                number = list(map(str, ids.tolist()))
                named, back = [], []
                for a, b in zip((ends - counts).tolist(), ends.tolist()):
                    named.append(hashlib.sha256(" ".join(number[a:b]).encode()).hexdigest())
                    back.append(hashlib.sha256(raw[byte_at[a]:byte_at[b]]).hexdigest())
                columns = [batch.column("doc_id").slice(row, len(some)), pa.array(counts, pa.int64()), pa.array(named), pa.array(back)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                row += len(some)

    return texts.mapInArrow(code, schema)


def byte_bpe(docs: DataFrame, ranks_path: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: doc_id, n_tokens, ids_sha256, decoded_sha256, on demand the ids.

    Null and empty texts have no ids; both digests are those of nothing. Special strings are ordinary text. Rows
    that repeat are coded each; other columns are not read.
    """
    return coded(docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs).alias("text")), ranks_path, keep_ids)
