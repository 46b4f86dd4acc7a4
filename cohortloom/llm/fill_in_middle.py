"""Fill-in-middle: texts cut at units found by arithmetic on eight bytes at a time, and put together in another order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.arrow_text import portions
from cohortloom.llm.common import whole_text

#: Marks before prefix, suffix and middle: an opening sign, a letter of its own, a closing sign.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per hundred: texts left plain, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 50, 80
SEED = 42
BATCH_BYTES = 1 << 20
FORMS = np.array(["plain", "psm", "spm"])

# One byte repeated in all eight of a word.
ONES = np.uint64(0x0101010101010101)
HIGH = ONES * np.uint64(0x80)
LOW = ONES * np.uint64(0x7F)


def _each(byte: int) -> np.uint64:
    return ONES * np.uint64(byte)


# Words of eight bytes

def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian words, filled up with zeros, and one word more."""
    out = np.zeros(len(data) // 8 + 2, "<u8")
    out.view(np.uint8)[:len(data)] = data
    return out


def space_marks(words: np.ndarray) -> np.ndarray:
    """The highest bit of every byte that is a blank or one of 9 to 13. No sum carries into the next byte."""
    low = words & LOW
    blank = ~(((words ^ _each(0x20)) & LOW) + LOW | words)
    from_nine, from_fourteen = low + _each(0x80 - 9), low + _each(0x80 - 14)
    return (blank | from_nine & ~from_fourteen & ~words) & HIGH


def end_marks(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The highest bit of every byte that ends a unit: no space before a space, or the last byte of a text (``ends``)."""
    space = space_marks(words)
    after = space >> np.uint64(8)
    after[:-1] |= space[1:] << np.uint64(56)
    marks = ~space & after & HIGH
    last = ends - 1
    np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << (last & 7).astype(np.uint64) * np.uint64(8))
    return marks


def start_marks(words: np.ndarray) -> np.ndarray:
    """The highest bit of every byte that does not go on a character."""
    return ~(words & ~(words << np.uint64(1))) & HIGH


class Marks:
    """Rank and select over marked bytes: counts by word, summed up once, resolved inside one word."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Marks in the bytes before each place."""
        word, byte = place >> 3, (place & 7).astype(np.uint64)
        below = (np.uint64(1) << byte * np.uint64(8)) - np.uint64(1)
        marks = self.marks[word]
        return self.upto[word] - np.bitwise_count(marks) + np.bitwise_count(marks & below)

    def select(self, number: np.ndarray) -> np.ndarray:
        """Place of the mark of each number, from 1."""
        word = np.searchsorted(self.upto, number)
        marks = self.marks[word]
        left = (number - self.upto[word] + np.bitwise_count(marks)).astype(np.uint64)
        # Byte k of the product is the number of marks up to byte k; those that reach ``left`` keep their high bit.
        running = (marks >> np.uint64(7)) * ONES
        reached = ((running | HIGH) - left * ONES) & HIGH
        return 8 * word + 8 - np.bitwise_count(reached)


def has_mark(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text contains one of the three marks."""
    at = np.flatnonzero(data == PREFIX[0])
    at = at[at + 2 < len(data)]
    letters = np.frombuffer(PREFIX[1:2] + SUFFIX[1:2] + MIDDLE[1:2], np.uint8)
    at = at[np.isin(data[at + 1], letters) & (data[at + 2] == PREFIX[2])]
    text = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[text[at + 3 <= offsets[text + 1]]] = True
    return out


def cut_texts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, ends of prefix and middle in ``data``, prefix_chars, middle_chars, for joined texts and two draws each."""
    words = as_words(data)
    begin, end = offsets[:-1], offsets[1:]
    units = Marks(end_marks(words, end[end > begin]))
    before = units.rank(begin)
    n = units.rank(end) - before
    chosen = np.sort(draws % (n + 1)[:, None], axis=1)
    places = np.repeat(begin[:, None], 2, axis=1)
    some = chosen > 0
    places[some] = units.select((before[:, None] + chosen)[some]) + 1
    characters = Marks(start_marks(words))
    at = [characters.rank(p) for p in (begin, places[:, 0], places[:, 1])]
    return n, places[:, 0], places[:, 1], at[1] - at[0], at[2] - at[1]


def assemble(raw: bytes, begin: int, first: int, second: int, end: int, form: str) -> bytes:
    prefix, middle, suffix = raw[begin:first], raw[first:second], raw[second:end]
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    if form == "spm":
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return raw[begin:end]


# The operator

def draws(doc_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers from the digest of seed and doc_id, equal at every run; a null doc_id reads ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output (the text in its new order) for every row.

    A unit is a word with the white space before it; white space at the end is a unit. Texts that are empty, null
    (counts as empty) or contain a mark stay plain, with null lengths. Forms and cuts hang on seed and doc_id only, so
    rows that repeat a doc_id with equal text give equal rows. A text is never divided over batches; memory follows
    the longest one. No shuffle; other columns are not read.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs).cast("binary").alias("text"), draws(docs["doc_id"], seed).alias("draws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = batch.column("draws").flatten().to_numpy().reshape(-1, 4)
            for row, data, offsets in portions(batch.column("text"), BATCH_BYTES):
                h = drawn[row:row + len(offsets) - 1]
                n, first, second, prefix, middle = cut_texts(data, offsets, h[:, :2])
                left = (np.diff(offsets) == 0) | has_mark(data, offsets) | (h[:, 2] % 100 >= 100 - plain)
                form = FORMS[np.where(left, 0, np.where(h[:, 3] % 100 < suffix_first, 2, 1))]
                raw = data.tobytes()
                output = [assemble(raw, *cut) for cut in zip(*(x.tolist() for x in (offsets[:-1], first, second, offsets[1:], form)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(n)), pa.array(n), pa.array(form), pa.array(prefix, mask=left), pa.array(middle, mask=left),
                     pa.array(output, pa.binary())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text again. The marks stand in no text that is not plain, so they tell the three parts apart."""
    letters = b"".join(mark[1:2] for mark in (PREFIX, SUFFIX, MIDDLE)).decode()
    parts = F.split(output, f"<[{letters}]>", -1)
    first, second, middle = (F.get(parts, k) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with digests in place of texts: of the output, and of the text rebuilt from it."""
    made = fill_in_middle(docs)
    sha = [F.sha2(c.cast("binary"), 256) for c in (F.col("output"), restored(F.col("output"), F.col("form")))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha[0].alias("output_sha256"), sha[1].alias("restored_sha256"))
