"""Ranks inside large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], buckets: int,
                  alias: str = "rank") -> DataFrame:
    """Distinct ranks 0..n-1 per group in a hash order, in two levels.

    Rows are ranked inside hash buckets and the bucket sizes give the offsets, so no task has to
    sort a whole group; choose ``buckets`` near group rows / 100,000.
    """
    group = list(group)
    hashed = df.withColumn("_h", F.xxhash64(*order))
    hashed = hashed.withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)).cast("int"))
    local = Window.partitionBy(*group, "_b").orderBy("_h", *order)
    ranked = hashed.withColumn("_local", F.row_number().over(local))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (hashed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_size"))
               .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
               .drop("_size"))
    # a missing group is a group like any other
    offsets = offsets.select(*[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group)],
                             F.col("_b").alias("_ob"), "_offset")
    same = F.col("_b") == F.col("_ob")
    for i, g in enumerate(group):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}"))
    return (ranked.join(offsets, same)
            .withColumn(alias, F.col("_offset") + F.col("_local") - 1)
            .drop("_h", "_b", "_ob", "_local", "_offset", *[f"_g{i}" for i in range(len(group))]))
