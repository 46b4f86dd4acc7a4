"""Exact quantiles with linear interpolation between order statistics, by histograms of leading digits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialize

#: Bits of a digit; a key has four.
DIGIT = 16
#: Rows of a bucket that are ranked value by value instead of by a further digit.
FEW = 1 << 16
_TOP = (1 << 63) - 1
_INFINITE = 0x7FF << 52


def with_ordered_key(df: DataFrame, value: str, key: str) -> DataFrame:
    """Adds a long that sorts as the double ``value`` does and is equal for equal values only.

    It holds exponent and mantissa as one number, with the sign. Both zeros have key 0; a number that is none comes last.
    Scaling by a power of two is exact, so the logarithm only has to be right to one. Each step is a column of its own:
    a step is used several times by the next.
    """
    v, size, step, scaled = F.col(f"`{value}`"), F.col("_size"), F.col("_step"), F.col("_scaled")
    rough = F.least(F.greatest(F.coalesce(F.floor(F.log2(size)), F.lit(-1022)), F.lit(-1022)), F.lit(1023))
    steps = df.withColumn("_size", F.abs(v)).withColumn("_step", rough).withColumn("_scaled", size / F.pow(F.lit(2.0), step))
    up, down = scaled >= 2, (scaled < 1) & (step > -1022)
    steps = steps.withColumn("_step", F.when(up, step + 1).when(down, step - 1).otherwise(step)).withColumn(
        "_scaled", F.when(up, scaled / 2).when(down, scaled * 2).otherwise(scaled))
    # From the smallest normal exponent down what is left is below one and the number is that of a subnormal.
    bits = (step + 1022) * F.lit(1 << 52) + (scaled * F.lit(float(1 << 52))).cast("long")
    bits = F.when(F.isnan(v), F.lit(_TOP)).when(size == float("inf"), F.lit(_INFINITE)).when(size == 0, F.lit(0).cast("long")).otherwise(bits)
    steps = steps.withColumn("_scaled", bits)
    return steps.withColumn(key, F.when(v < 0, -F.col("_scaled")).otherwise(F.col("_scaled"))).drop("_size", "_step", "_scaled")


def _inside(rows: DataFrame, targets: DataFrame, shift: int) -> DataFrame:
    """The rows whose leading digits are those of a bucket still looked into, with that bucket."""
    wanted = targets.select(F.col("_g").alias("_tg"), F.col("_bucket")).distinct()
    same = (F.col("_g") == F.col("_tg")) & (F.shiftright("_key", shift) == F.col("_bucket"))
    return rows.join(wanted, same).select("_g", "_bucket", "_key", "_v")


def _histogram(inside: DataFrame, shift: int) -> DataFrame:
    """Counts by the next digits, added up where rows are read, and their running sum in the bucket they divide.

    A running sum is over the distinct digits of one bucket: 2**DIGIT at most, or FEW values.
    """
    counted = inside.groupBy("_g", "_bucket", F.shiftright("_key", shift).alias("_next")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_v"))
    steps = Window.partitionBy("_g", "_bucket").orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.withColumn("_upto", F.sum("_c").over(steps))


def _found(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target (group, which quantile, rank) in the part of its bucket that holds the rank."""
    t = targets.select(F.col("_g").alias("_tg"), F.col("_bucket").alias("_tb"), "_which", "_rank", "_below", "_weight")
    joined = histogram.join(t, (F.col("_g") == F.col("_tg")) & (F.col("_bucket") == F.col("_tb")))
    upto = F.col("_below") + F.col("_upto")
    here = joined.filter((F.col("_rank") < upto) & (F.col("_rank") >= upto - F.col("_c")))
    return here.select("_g", F.col("_next").alias("_bucket"), "_which", "_rank", (upto - F.col("_c")).alias("_below"), "_weight", "_c", "_v")


def grouped_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float],
                      few: int = FEW, digit: int = DIGIT) -> DataFrame:
    """Exact quantiles per group without bringing a group, or its values, into one task.

    Values become longs of the same order. Rows are counted by group and leading digit where they are read, so only
    histograms are shuffled; the running sum tells which bucket holds each wanted order statistic, and only the
    rows of these buckets are looked at again, by the next digit, until a bucket has at most ``few`` rows or no digit is left.
    Constant and heavily tied values need no more than others, and no step can miss. Missing values do not
    count; a missing group is a group, one without values gives no row. Result: ``(group, prob, value)``.
    """
    keep, probs = list(group), [float(p) for p in probs]
    fields = [F.lit(0).alias("_all"), *[F.col(f"`{g}`").alias(g) for g in keep]]
    known = df.filter(F.col(f"`{value}`").isNotNull()).select(F.struct(*fields).alias("_g"), F.col(f"`{value}`").cast("double").alias("_v"))
    rows = materialize(with_ordered_key(known, "_v", "_key"))
    shift = 64 - digit
    whole = rows.withColumn("_bucket", F.lit(0).cast("long"))
    histogram = materialize(_histogram(whole, shift))
    sizes = histogram.groupBy("_g").agg(F.sum("_c").alias("_n"))
    place = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    wanted = F.array(*[F.struct(F.lit(i).alias("_which"), rank.cast("long").alias("_rank"), weight.alias("_weight"))
                       for i, at in enumerate(place)
                       for rank, weight in ((F.floor(at), 1 - (at - F.floor(at))), (F.floor(at) + 1, at - F.floor(at)))])
    targets = sizes.select("_g", F.inline(wanted)).filter("_weight > 0").select(
        "_g", F.lit(0).cast("long").alias("_bucket"), "_which", "_rank", F.lit(0).cast("long").alias("_below"), "_weight")
    targets = materialize(_found(histogram, targets))
    while shift > 0:
        most = targets.agg(F.max("_c")).first()[0]
        if most is None:
            break
        inside = _inside(rows, targets, shift)
        shift = 0 if most <= few else max(0, shift - digit)
        targets = _found(_histogram(inside, shift), targets)
        if shift > 0:  # else nothing is asked of them but the result
            targets = materialize(targets)
    low, high, weight = F.min_by("_v", "_rank"), F.max_by("_v", "_rank"), F.max_by("_weight", "_rank")
    # By weight where the distance is infinite; equal neighbours are taken as they are.
    endless = F.abs(high - low) == float("inf")
    between = F.when(low == high, low).when(endless, F.sum(F.col("_weight") * F.col("_v"))).otherwise(low + weight * (high - low))
    ends = targets.groupBy("_g", "_which").agg(between.alias("value"))
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_which") + 1)
    return ends.select(*[F.col(f"_g.`{g}`").alias(g) for g in keep], prob.alias("prob"), "value")


def wide_quantiles(df: DataFrame, group: str, value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``group`` and one column for each quantile."""
    long = grouped_quantiles(df, [group], value, probs)
    return long.groupBy(group).agg(*[F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(n) for p, n in zip(probs, names)])
