"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import apart, materialize, text_key, whole_text, word_count

#: Share weights of the sources in code point order, repeating; at most CAP times a source's size is taken.
WEIGHTS = (1, 2, 3)
CAP = 3
#: The hash has LEVELS digits of DIGIT_BITS bits; a histogram looks at one digit.
DIGIT_BITS, LEVELS = 12, 5


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, size, source key and the hash that decides, written once.

    The hash covers doc_id and text, so it is the same in every run and on every cluster, and rows without a
    doc_id are still told apart. Rows equal in both are taken or left together.
    """
    text, key = whole_text(docs), text_key(docs)
    draw = F.md5(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.coalesce(key, F.lit("null"))).cast("binary"))
    # A null source sorts after all others.
    return materialize(docs.select(
        docs["doc_id"].alias("doc_id"), key.alias("text_key"), word_count(text).alias("size"),
        F.when(docs["source"].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), docs["source"].cast("string"))).alias("source_key"),
        F.conv(F.substring(draw, 1, DIGIT_BITS * LEVELS // 4), 16, 10).cast("long").alias("draw")))


def _digit(level: int) -> Column:
    """The leading part of the hash up to and with the given digit."""
    return F.shiftright(F.col("draw"), DIGIT_BITS * (LEVELS - 1 - level))


def plan_sources(totals: DataFrame) -> DataFrame:
    """Target, whole passes and the rest to draw for each source, from one row per source.

    Water filling in closed form: sources in order of the share at which they fill up; the first that stays
    below its limit at the common level fixes the level. The two windows hold one row per source.
    """
    by_name = Window.orderBy("source_key")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighted = totals.withColumn("weight", weight.cast("long")).withColumn("limit_", F.col("source_size") * CAP)
    fill = Window.orderBy((F.col("limit_") / F.col("weight")).asc(), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = weighted.select("*",
        ((F.sum("source_size").over(every) - F.coalesce(F.sum("limit_").over(fill), F.lit(0)))
         / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))).alias("level"))
    free = level.withColumn("open_level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit_"), F.struct(F.col("limit_") / F.col("weight"), "source_key", "level"))).over(every)["level"])
    target = F.when(F.col("open_level").isNull() | (F.col("open_level") * F.col("weight") > F.col("limit_")), F.col("limit_").cast("double")).otherwise(F.col("open_level") * F.col("weight"))
    passes = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).cast("long")
    return (free.withColumn("target", target).withColumn("passes", passes)
            .select("source_key", "source_size", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest")))


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source the largest hash that is drawn once more (``bound``, -1 for none).

    Level by level: sum sizes by leading hash digits, find the bucket in which the running sum passes the rest,
    look only into that bucket next. A bucket's key holds the digits, so a hot source is spread over all its
    buckets, and each running sum is over at most 2**DIGIT_BITS rows of one source. The last bucket is one hash
    value: it is drawn if that brings the sum nearer to the rest.
    """
    steps = Window.partitionBy("source_key").orderBy("digits").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside, goal = rows, sources.select("source_key", F.col("rest").alias("goal"))
    for level in range(LEVELS):
        last = level == LEVELS - 1
        counted = inside.groupBy("source_key", _digit(level).alias("digits")).agg(F.sum("size").alias("part"))
        run = counted.withColumn("upto", F.sum("part").over(steps)).join(goal, "source_key")
        edge = run.filter("upto > goal").groupBy("source_key").agg(F.min(F.struct("digits", "part", "upto", "goal")).alias("e"))
        edge = materialize(edge.select("source_key", F.col("e.digits").alias("digits"),
                                       (F.col("e.goal") - F.col("e.upto") + F.col("e.part")).alias("goal"), F.col("e.part").alias("part")))
        if not last:
            on = (F.col("source_key") == F.col("_s")) & (_digit(level) == F.col("_d"))
            inside = rows.join(edge.select(F.col("source_key").alias("_s"), F.col("digits").alias("_d")), on, "left_semi")
            goal = edge.select("source_key", "goal")
    nearer = F.col("part") - F.col("goal") < F.col("goal")
    return edge.select("source_key", F.when(nearer, F.col("digits")).otherwise(F.col("digits") - 1).alias("bound"))


def mix(rows: DataFrame) -> DataFrame:
    """Per row of ``sized``: source_size, target and how often the document is taken (``times``)."""
    first = materialize(rows.groupBy("source_key", _digit(0).alias("digits")).agg(F.sum("size").alias("part")))
    sources = materialize(plan_sources(first.groupBy("source_key").agg(F.sum("part").alias("source_size"))))
    # No edge: the rest is not passed by the whole source, which then is drawn in full or not at all (rest 0).
    bounds = sources.join(thresholds(rows, sources), "source_key", "left").withColumn(
        "bound", F.coalesce("bound", F.when(F.col("rest") > 0, F.lit((1 << (DIGIT_BITS * LEVELS)) - 1)).otherwise(F.lit(-1))))
    # By bucket, so that the join's key is never a whole source.
    buckets = first.select("source_key", "digits").join(bounds, "source_key").withColumnRenamed("digits", "_d").withColumnRenamed("source_key", "_s")
    joined = rows.join(buckets, (F.col("source_key") == F.col("_s")) & (_digit(0) == F.col("_d")))
    extra = F.when(F.col("draw") <= F.col("bound"), 1).otherwise(0)
    return joined.withColumn("times", F.least(F.col("passes") + extra, F.lit(CAP)).cast("int"))


def source_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Null texts have size 0, a null source is a source of its own, sorted last. A source of size 0 has target 0.
    Rows with equal doc_id and text share their fate. An empty table gives an empty result.
    """
    return mix(sized(docs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def take_mix(docs: DataFrame) -> DataFrame:
    """The mixed documents with all columns, each as often as the mix takes it."""
    id_, key, times, copy = apart(docs, "m_id", "m_key", "m_times", "m_copy")
    chosen = mix(sized(docs)).filter("times > 0").groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.max("times").alias(times))
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & text_key(docs).eqNullSafe(F.col(key))
    return docs.join(chosen, same).select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)
