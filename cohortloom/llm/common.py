"""What the operators of this package share: reading documents, native text expressions, kept rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import materialize

#: ASCII white space as a Java regex class and as characters.
SPACE = "[\\x20\\x09-\\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(docs: DataFrame) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def apart(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``docs`` has it, in whatever case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """``row_id``, ``doc_id`` and the given expressions only, so that no other column can clash.

    ``row_id`` tells rows apart that repeat a doc_id. It depends on how the input was split, so callers
    write the frame once with ``materialize`` and read all later steps from there.
    """
    return docs.select(F.monotonically_increasing_id().alias("row_id"), docs["doc_id"].alias("doc_id"), *columns)


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def word_array(text: Column) -> Column:
    """The runs without ASCII white space, in order; an empty array for none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def text_key(docs: DataFrame) -> Column:
    """With the doc_id, what tells a row from others: the SHA-256 of its text, null for none."""
    return F.sha2(docs["text"].cast("binary"), 256)


def keep_rows(docs: DataFrame, winners: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``winners`` (doc_id, text_key), one for each, with all their columns.

    ``listed`` has doc_id and text_key of every row. Only if some rows share both are equal ones collapsed after
    the join. The text is moved once, by a key that no group of copies shares.
    """
    id_, key = apart(docs, "w_id", "w_key")
    winners = winners.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    repeats = not listed.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & text_key(docs).eqNullSafe(F.col(key))
    kept = docs.join(winners, same, "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if repeats else kept


__all__ = ["SPACE", "SPACES", "documents", "whole_text", "apart", "numbered", "word_count", "word_array", "text_key",
           "keep_rows", "materialize"]
