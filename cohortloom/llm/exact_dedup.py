"""Exact deduplication by recipes of content-defined chunks; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import SPACES, keep_rows, materialize, numbered, text_key, whole_text

#: A chunk ends after a cut (three letters of these classes) but not before MIN_CHUNK characters, and at MAX_CHUNK.
CUT = "[aeiou][nrst][aeiou]"
MIN_CHUNK, MAX_CHUNK = 512, 4096


def normalised(text: Column) -> Column:
    """The text without ASCII white space. Blanks and line feeds go by byte search; the rest only where there is any."""
    plain = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    odd = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")
    return F.when(odd, F.translate(text, SPACES, "")).otherwise(plain)


def chunks(text: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """Consecutive pieces that add up to the text; cuts depend on the characters around them only."""
    rule = f"(?s).{{{min_chunk},{max_chunk - 1}}}?{CUT}|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def recipes(docs: DataFrame, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """One row per document with its ordered list of verified chunk identifiers (``recipe``), written once.

    A chunk's identifier is its 64-bit hash. It is verified by the chunk's SHA-256: hashes that stand for two
    digests are found over the whole corpus and their chunks get the digest's rank as a second part. The text
    is read once and never shuffled; only hashes and digests are, combined on the map side.
    """
    text = normalised(whole_text(docs))
    raw = numbered(docs, F.length(whole_text(docs)).alias("n_chars"), text_key(docs).alias("text_key"), text.alias("_norm"))
    cut = raw.withColumn("_chunks", chunks(F.col("_norm"), min_chunk, max_chunk))
    listed = materialize(cut.select(
        "row_id", "doc_id", "n_chars", "text_key", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
        F.transform("_chunks", lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("d"))).alias("pieces"),
    ))
    store = listed.select(F.explode("pieces").alias("p")).groupBy("p.h", "p.d").agg(F.count(F.lit(1)).alias("uses"))
    doubtful = store.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    clashes = materialize(store.join(doubtful, "h", "left_semi").select("h", "d"))
    if clashes.isEmpty():
        return listed.select("row_id", "doc_id", "n_chars", "text_key", "text_sha256",
                             F.transform("pieces", lambda p: p["h"]).alias("recipe"))
    return _separate(listed, clashes)


def _separate(listed: DataFrame, clashes: DataFrame) -> DataFrame:
    """Recipes in which chunks of one hash and several digests carry the digest too."""
    doubtful = clashes.select(F.col("h").alias("_h")).distinct()
    flat = listed.select("row_id", F.posexplode("pieces").alias("pos", "p")).select("row_id", "pos", "p.h", "p.d")
    marked = (flat.join(doubtful, F.col("h") == F.col("_h"), "left")
              .select("row_id", F.struct("pos", "h", F.when(F.col("_h").isNotNull(), F.col("d")).alias("d")).alias("p")))
    lists = marked.groupBy("row_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    exact = lists.select("row_id", F.transform("ps", lambda p: F.struct(p["h"], p["d"])).alias("recipe"))
    empty = F.array().cast(exact.schema["recipe"].dataType)
    return (listed.drop("pieces").join(exact, "row_id", "left")
            .withColumn("recipe", F.coalesce("recipe", empty)))


def _order() -> Column:
    """Smallest first: longest original, then smallest doc_id (null after all others), then first row."""
    return F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"),
                    F.col("row_id").alias("d"), F.col("text_key").alias("e"))


def groups(made: DataFrame) -> DataFrame:
    """Per recipe: the row that stays and the number of rows. A hot group is combined on the map side."""
    return made.groupBy("recipe").agg(F.min(_order()).alias("best"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when they are after removal of ASCII white space; null counts as empty, and empty texts
    form a group. Of rows that repeat a doc_id, still one of the group stays. Other columns are ignored.
    """
    made = recipes(docs, min_chunk, max_chunk)
    best = materialize(groups(made))  # so that the join is of two tables, and the rows of a hot group can be split
    return made.join(best, "recipe").select(
        "doc_id", F.col("best.c").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.d")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns."""
    made = recipes(docs)
    best = materialize(groups(made).select(F.col("best.c").alias("doc_id"), F.col("best.e").alias("text_key")))
    return keep_rows(docs, best, made)
