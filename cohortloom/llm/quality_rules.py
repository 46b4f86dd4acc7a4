"""Quality rules with cross-document line frequency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import SPACE, apart, materialize, numbered, text_key, whole_text, word_array

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A line above LINE_DOCS different documents of a host is removed; what keeps less than MIN_LEFT of its characters is rejected.
LINE_DOCS, MIN_LEFT = 50, 0.1


def _window_hashes(hashed: Column) -> Column:
    """Hash of each run of WINDOW words, from the words' hashes."""
    count = F.greatest(F.size(hashed) - (WINDOW - 1), F.lit(0))
    return F.transform(F.slice(hashed, 1, count), lambda first, i: F.xxhash64(first, *[F.get(hashed, i + k) for k in range(1, WINDOW)]))


def _by_hash(windows: Column) -> Column:
    """The windows as (hash, place), sorted."""
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated_places(ordered: Column) -> Column:
    """Sorted places of the windows found twice or more: those with an equal neighbour in the order of hashes.

    ``ordered`` is looked into for every element, so it has to be a computed column.
    """

    def twice(s: Column, k: Column) -> Column:
        # Past either end there is nothing to be equal to.
        before = F.when(k > 0, F.get(ordered, k - 1)["h"] == s["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == s["h"], F.lit(False))

    return F.sort_array(F.transform(F.filter(ordered, twice), lambda s: s["i"]))


def _cover(at: Column) -> Column:
    """Words covered by windows that begin at the sorted places."""
    steps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def normal_line(line: Column) -> Column:
    """Lower case, single blanks, digits as 0."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(line, F.lit(" \t\r\x0b\x0c"))), "[0-9]", "0"), SPACE + "+", " ")


def measured(docs: DataFrame) -> DataFrame:
    """One row per document with the base counts and its lines as (hash, characters), written once."""
    text = whole_text(docs)
    raw = numbered(docs, docs["source"].cast("string").alias("host"), text_key(docs).alias("text_key"), text.alias("_text"), word_array(text).alias("_words"))
    words = F.col("_words")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = raw.withColumn("_lines", lines).withColumn("_normal", F.transform("_lines", normal_line))
    step = step.withColumn("_hashed", F.transform(words, lambda w: F.xxhash64(w)))
    step = step.withColumn("_windows", _window_hashes(F.col("_hashed")))
    # Most texts repeat no window; only the others are sorted.
    step = step.withColumn("_ordered", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _by_hash(F.col("_windows"))))
    step = step.withColumn("_at", _repeated_places(F.col("_ordered")))
    return materialize(step.select(
        "row_id", "doc_id", "text_key", "host", F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_cover(F.col("_at")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.unhex(F.md5(F.array_join("_normal", "\n").cast("binary"))).alias("digest"),
        F.transform("_lines", lambda x, i: F.struct(F.xxhash64(F.get("_normal", i)).alias("h"), F.length(x).alias("chars"))).alias("lines")))


def common_lines(made: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """host, h of the lines above the limit.

    Documents are told apart by a digest of their whole text, line by line in the form in which lines are compared, so
    copies count once: also those that differ in nothing but digits, case and blanks. A hot line of a hot host, and a
    line of many copies, is summed on the map side.
    """
    hashes = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    seen = made.select("host", "digest", F.explode(hashes).alias("h")).distinct()
    return seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > line_docs).select("host", "h")


def judged(made: DataFrame, line_docs: int = LINE_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """``base_failed`` and ``kept`` beside the columns of ``measured``."""
    common = materialize(common_lines(made, line_docs)).select(F.col("host").alias("_host"), F.col("h").alias("_h"))
    flat = made.select("row_id", "host", F.explode("lines").alias("x")).select("row_id", "host", "x.h", "x.chars")
    hit = flat.join(common, F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h")), "left_semi")
    lost = hit.groupBy("row_id").agg(F.sum("chars").alias("lost"))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda total, x: total + x["chars"])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = chars - F.coalesce("lost", F.lit(0))
    return (made.join(lost, "row_id", "left").withColumn("base_failed", base)
            .withColumn("kept", ~base & (left >= min_left * chars)))


def quality_rules(docs: DataFrame, line_docs: int = LINE_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row.

    Null and blank texts have no words and fail the base rule. A null source is a host of its own. Rows that repeat
    are judged each; other columns are ignored. Windows are compared by 64-bit hashes within a document.
    """
    return judged(measured(docs), line_docs, min_left).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with all columns; rows equal in doc_id, text and source share their verdict."""
    id_, key, host = apart(docs, "o_id", "o_key", "o_host")
    out = materialize(judged(measured(docs)).filter("not kept").select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("host").alias(host)).distinct())
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & text_key(docs).eqNullSafe(F.col(key)) & docs["source"].cast("string").eqNullSafe(F.col(host))
    return docs.join(out, same, "left_anti")
