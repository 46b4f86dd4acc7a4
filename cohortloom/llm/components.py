"""Connected components of links between numbers, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import materialize

MAX_ROUNDS = 60


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step: every node is linked to the smallest node near it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    large = both.join(near, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.distinct()  # a > b in every row
    low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    small = large.join(low, F.col("a") == F.col("n")).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node in ``links`` (a, b) but the roots.

    Each round is written to the shared folder, so a lost executor costs one round. Rounds grow with the
    logarithm of the longest path; the links of a node with very many are minima on the map side and joins
    that adaptive execution can split.
    """
    now = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == mark or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, now = state, materialize(_stars(now))
    raise RuntimeError("components did not settle")
