"""Many LIKE patterns at once: an index of short character runs (grams) instead of one test per pattern and text.

A pattern can only fit a text that holds all its literal characters, so each pattern is filed under one gram, the one that
the fewest texts hold, and is tested on the texts of that gram alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.skew import BROADCAST_ROWS, lookup_join
from cohortloom.session import materialize

#: Characters of a gram; patterns without so long a literal run are filed under a shorter one, those without any under "".
GRAM = 3


def _grams(text: Column, length: int) -> Column:
    """Distinct runs of ``length`` characters of a text."""
    if length == 0:
        return F.array(F.lit(""))
    letters = F.split(text, "")
    runs = F.transform(F.sequence(F.lit(0), F.length(text) - length),
                       lambda i: F.concat(*[F.get(letters, i + k) for k in range(length)]))
    return F.when(F.length(text) >= length, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _runs(pattern: Column) -> Column:
    """The literal runs of a pattern; an escaped character ends a run."""
    return F.split(pattern, r"\\.|[%_]")


def _pattern_grams(pattern: Column) -> Column:
    """The grams that every text of the pattern holds, as long as its literal runs allow."""
    runs = _runs(pattern)
    longest = F.array_max(F.transform(runs, F.length))
    out = _grams(pattern, 0)
    for length in range(1, GRAM + 1):
        found = F.array_distinct(F.flatten(F.transform(runs, lambda r: _grams(r, length))))
        out = F.when(longest >= length, found).otherwise(out)
    return out


def matching_texts(texts: DataFrame, text: str, patterns: DataFrame, pattern: str,
                   max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``_text`` (distinct, lower case) with every row of ``patterns`` whose LIKE pattern, given in lower case, fits it.

    Missing texts and patterns match nothing; rows that repeat a pattern are all returned. ``max_rows`` bounds what
    may be broadcast after measuring; larger indexes are joined by shuffle.
    """
    # Few bytes can mean many tests, so the texts are dealt to all tasks and not merged by size.
    spark = texts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = materialize(texts.select(F.lower(F.col(text)).alias("_text")).filter("_text is not null").distinct().repartition(tasks, "_text"))
    asked = materialize(patterns.select(F.col(pattern).alias("_pattern")).filter("_pattern is not null").distinct()
                        .select("_pattern", F.explode(_pattern_grams(F.col("_pattern"))).alias("_gram")))
    lengths = sorted(r[0] for r in asked.select(F.length("_gram")).distinct().collect())  # GRAM + 1 values at most
    if not lengths:
        lengths = [GRAM]
    held = words.select("_text", F.explode(F.flatten(F.array(*[_grams(F.col("_text"), n) for n in lengths]))).alias("_gram"))
    wanted = asked.select("_gram").distinct()
    counts = lookup_join(held.select("_gram"), wanted, ["_gram"], max_rows=max_rows).groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # A gram that no text holds settles its patterns: they fit nothing.
    filed = (asked.join(counts, "_gram", "left").groupBy("_pattern")
             .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_best"))
             .filter("_best.n > 0").select("_pattern", F.col("_best.gram").alias("_gram"), _runs(F.col("_pattern")).alias("_runs")))
    tried = lookup_join(held, materialize(filed), ["_gram"], max_rows=max_rows)
    # The runs are looked for first: a pattern from a column is compiled anew for each text.
    likely = F.forall("_runs", lambda r: F.contains(F.col("_text"), r))
    found = materialize(tried.filter(F.when(likely, F.like(F.col("_text"), F.col("_pattern"))).otherwise(False)).select("_text", "_pattern"))
    rows = patterns.withColumn("_pattern", F.col(pattern))
    return lookup_join(found, rows, ["_pattern"], max_rows=max_rows).drop("_pattern")


def match_patterns(texts: DataFrame, text: str, patterns: DataFrame, pattern: str,
                   max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of ``texts`` with every row of ``patterns`` that fits its text, ignoring case of the text."""
    matches = matching_texts(texts, text, patterns, pattern, max_rows)
    return lookup_join(texts.withColumn("_text", F.lower(F.col(text))), matches, ["_text"], max_rows=max_rows).drop("_text")
