"""Multiple imputation by chained equations, with the imputation number as a column.

All data sets live in one frame. A sweep visits the incomplete columns in turn: linear
prediction is one batched least-squares job for all data sets, the random-forest method draws an
observed donor that falls into the same leaf. Frames are written out after every donor draw and
every sweep, so the plan stays short and a lost executor never repeats earlier sweeps.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.ranks import bucketed_rank
from cohortloom.operators.models import ModelSpec, fit_linear
from cohortloom.session import materialize

ROWS_PER_BUCKET = 100_000
PARALLEL_FITS = 8
MAX_DEPTH, SPARE_LEVELS = 30, 4


def _missing(column: str) -> str:
    return f"_na_{column}"


def _draw(seed: int, salt: str, n: Column, *ids: str) -> Column:
    """Uniform whole number below ``n``, fixed by the row's ids and the seed."""
    return F.pmod(F.xxhash64(*[F.col(i) for i in ids], F.lit(salt), F.lit(seed)), n)


def start_frame(df: DataFrame, row_id: str, columns: Sequence[str], m: int, seed: int,
                imp: str = "imp", starts: Mapping[str, float] | None = None) -> DataFrame:
    """``m`` copies of the data whose gaps are filled with random observed values, or with the constant in ``starts``.

    Every gap draws the rank of an observed value of its column, uniformly, and meets it in one
    join on (column, rank) for all columns together.
    """
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    empty = [c for c in columns if counts[c] == 0]
    if empty:
        raise ValueError(f"no observed value in {empty}")
    flagged = df.withColumns({_missing(c): F.col(c).isNull() for c in columns})
    copies = flagged.withColumn(imp, F.explode(F.sequence(F.lit(1), F.lit(m))))
    given = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in (starts or {}).items() if c in columns}
    copies = copies.withColumns(given)
    columns = [c for c in columns if c not in given]
    if not columns:
        return copies
    long = F.inline(F.array(*[
        F.struct(F.lit(c).alias("_var"), F.col(c).cast("double").alias("_val")) for c in columns]))
    observed = df.select(row_id, long).filter("_val is not null")
    buckets = max(1, math.ceil(max(counts[c] for c in columns) / ROWS_PER_BUCKET))
    donors = bucketed_rank(observed, ["_var"], [F.col(row_id), F.col("_var"), F.lit(seed)], buckets,
                           "_rank").select("_var", "_rank", "_val")
    gap = F.inline(F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("_var"), F.lit(counts[c]).alias("_n")))
        for c in columns])))
    holes = copies.select(row_id, imp, gap).withColumn(
        "_rank", F.pmod(F.xxhash64(row_id, imp, "_var", F.lit(seed + 1)), F.col("_n")))
    filled = (holes.join(donors, ["_var", "_rank"]).groupBy(row_id, imp)
              .agg(*[F.max(F.when(F.col("_var") == c, F.col("_val"))).alias(f"_new_{c}") for c in columns]))
    out = copies.join(filled, [row_id, imp], "left")
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_new_{c}")) for c in columns})
    return out.drop(*[f"_new_{c}" for c in columns])


def _predict_column(frame: DataFrame, target: str, predictors: Sequence[str], m: int, imp: str) -> DataFrame:
    """Replace the gaps by least-squares predictions, one regression per data set in one job."""
    rows = frame.filter(~F.col(_missing(target))).select(
        F.col(imp).alias("_imp"), *[F.col(c).cast("double").alias(c) for c in [target, *predictors]])
    fits = fit_linear(rows, target, [ModelSpec(target, tuple(predictors), i) for i in range(1, m + 1)],
                      prepared=True)
    value = F.element_at(F.array(*[F.lit(float(f.beta[0])) for f in fits]), F.col(imp))
    for j, p in enumerate(predictors, 1):
        slope = F.element_at(F.array(*[F.lit(float(f.beta[j])) for f in fits]), F.col(imp))
        value = value + slope * F.col(p).cast("double")
    return frame.withColumn(target, F.when(F.col(_missing(target)), value).otherwise(F.col(target)))


def tree_depth(observed: int, min_leaf: int) -> int:
    """Levels that let leaves shrink to ``min_leaf`` rows, with room for uneven splits; the learner takes 30 at most."""
    return min(MAX_DEPTH, max(1, math.ceil(math.log2(max(observed, 2) / min_leaf)) + SPARE_LEVELS))


def _leaves(rows: DataFrame, row_id: str, target: str, predictors: Sequence[str], missing: str,
            trees: int, min_leaf: int, bins: int, seed: int, m: int, imp: str) -> DataFrame:
    """Leaf of every row in each tree of its data set's forest.

    The forests of the data sets are independent, so they are grown by concurrent jobs.
    """
    wanted = rows.select(row_id, imp, missing, F.col(target).cast("double").alias(target),
                         *[F.col(p).cast("double").alias(p) for p in predictors])
    assembled = VectorAssembler(inputCols=list(predictors), outputCol="_x").transform(wanted)
    depth = tree_depth(rows.filter((F.col(imp) == 1) & ~F.col(missing)).count(), min_leaf)

    def grow(i: int) -> DataFrame:
        forest = RandomForestRegressor(featuresCol="_x", labelCol=target, leafCol="_leaf", numTrees=trees, maxDepth=depth,
                                       minInstancesPerNode=min_leaf, maxBins=bins, seed=seed * 1009 + i)
        part = assembled.filter(F.col(imp) == i)
        model = forest.fit(part.filter(~F.col(missing)))
        return model.transform(part).select(row_id, imp, missing, target, vector_to_array("_leaf").alias("_leaf"))

    with ThreadPoolExecutor(min(m, PARALLEL_FITS)) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(grow), range(1, m + 1)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def leaf_donors(rows: DataFrame, row_id: str, target: str, predictors: Sequence[str], missing: str,
                trees: int, min_leaf: int, bins: int, seed: int, m: int, imp: str) -> DataFrame:
    """One donor value per row with a gap, from the leaves it shares with observed rows.

    A forest per data set is grown on the observed rows. The donors of a gap are all observed rows of its leaf, over
    all trees: a seeded draw picks a rank among them. Leaf sizes are counted on the map side, and only leaves that
    a draw has fallen on have their rows ranked.
    """
    leaves = materialize(_leaves(rows, row_id, target, predictors, missing, trees, min_leaf, bins, seed, m, imp))
    leaf = [imp, "_tree", "_node"]
    exploded = leaves.select(row_id, imp, missing, F.col(target).alias("_val"), F.posexplode("_leaf").alias("_tree", "_node"))
    exploded = exploded.withColumn("_node", F.col("_node").cast("int"))
    donors, gaps = exploded.filter(~F.col(missing)), exploded.filter(F.col(missing))
    sizes = donors.groupBy(*leaf).agg(F.count(F.lit(1)).alias("_size"))
    parts = gaps.join(sizes, leaf).groupBy(row_id, imp).agg(
        F.sort_array(F.collect_list(F.struct("_tree", "_node", "_size"))).alias("_parts"))
    ends = F.transform("_parts", lambda p, t: F.aggregate(F.slice("_parts", F.lit(1), t + 1), F.lit(0).cast("bigint"),
                                                          lambda total, x: total + x["_size"]))
    picked = (parts.withColumn("_ends", ends)
              .withColumn("_pick", _draw(seed, target, F.element_at("_ends", -1), row_id, imp))
              .withColumn("_at", F.size(F.filter("_ends", lambda e: e <= F.col("_pick"))))
              .withColumn("_part", F.get("_parts", F.col("_at"))))
    picked = materialize(picked.select(row_id, imp, F.col("_part._tree").alias("_tree"), F.col("_part._node").alias("_node"),
                                       (F.col("_pick") - F.col("_ends")[F.col("_at")] + F.col("_part._size")).alias("_rank")))
    asked = donors.join(picked.select(*leaf).distinct(), leaf, "left_semi")
    biggest = sizes.agg(F.max("_size")).first()[0] or 1
    ranked = bucketed_rank(asked, leaf, [F.col(row_id), F.col("_tree"), F.lit(seed)],
                           max(1, math.ceil(biggest / ROWS_PER_BUCKET)), "_rank")
    return picked.join(ranked.select(*leaf, "_rank", "_val"), [*leaf, "_rank"]).select(row_id, imp, "_val")


def _draw_column(frame: DataFrame, row_id: str, target: str, predictors: Sequence[str], m: int,
                 imp: str, trees: int, min_leaf: int, bins: int, seed: int) -> DataFrame:
    values = leaf_donors(frame, row_id, target, predictors, _missing(target), trees, min_leaf, bins, seed, m, imp)
    joined = frame.join(values, [row_id, imp], "left")
    return joined.withColumn(target, F.coalesce("_val", target)).select(*frame.columns)


def mice_impute(df: DataFrame, row_id: str, methods: Mapping[str, str], predictors: Sequence[str],
                m: int = 10, sweeps: int = 5, seed: int = 20, trees: int = 10, min_leaf: int = 5,
                bins: int = 32, imp: str = "imp", starts: Mapping[str, float] | None = None) -> DataFrame:
    """Completed data sets 1..m stacked in one frame with the column ``imp``.

    ``methods`` maps each incomplete column to ``norm.predict`` or ``rf``; columns are visited in
    that order. ``predictors`` are numeric columns without gaps of their own; the other incomplete
    columns always take part as well. Observed values are never changed. Trees of the forest method grow until a
    leaf would hold fewer than ``min_leaf`` rows, splitting at ``bins`` candidate points per column.
    The chain begins with random observed values, or with the constants of ``starts`` for the columns it names.
    """
    unknown = set(methods.values()) - {"norm.predict", "rf"}
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    frame = materialize(start_frame(df, row_id, list(methods), m, seed, imp, starts))
    for sweep in range(sweeps):
        for n, (target, method) in enumerate(methods.items()):
            used = [*predictors, *[c for c in methods if c != target]]
            if method == "norm.predict":
                # a narrow expression over literals: the next job may compute it again
                frame = _predict_column(frame, target, used, m, imp)
            else:
                frame = materialize(_draw_column(frame, row_id, target, used, m, imp, trees, min_leaf, bins,
                                                 seed + sweep * len(methods) + n))
        if list(methods.values())[-1] == "norm.predict":
            frame = materialize(frame)
    return frame.drop(*[_missing(c) for c in methods])


def complete_long(frame: DataFrame, columns: Sequence[str], imp: str = "imp") -> DataFrame:
    """The stacked completed data with the wanted columns only."""
    return frame.select(imp, *[F.col(f"`{c}`") for c in columns])
