"""Running sums and nearest neighbours along an order that may be as long as the data: blocks first, then carries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialize

PART = "_part"


def in_blocks(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows dealt by ranges of (group, order), written once with the number of their range in ``_part``.

    Ranges follow each other, so a group that is longer than a range stands in consecutive blocks.
    """
    return materialize(df.repartitionByRange(*[F.col(f"`{c}`") for c in (*group, *order)]).withColumn(PART, F.spark_partition_id()))


def _on_block(group: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    same = left[PART] == right["_cp"]
    for i, g in enumerate(group):
        same = same & left[g].eqNullSafe(right[f"_cg{i}"])
    return same


def _with_carries(blocks: DataFrame, group: Sequence[str], sums: DataFrame) -> DataFrame:
    """Rows with the carries of their block; ``sums`` has one row for each group and block, as many as both together."""
    carried = sums.select(*[F.col(f"`{g}`").alias(f"_cg{i}") for i, g in enumerate(group)], F.col(PART).alias("_cp"),
                          *[c for c in sums.columns if c not in (*group, PART)])
    return blocks.join(carried, _on_block(group, blocks, carried)).drop("_cp", *[f"_cg{i}" for i in range(len(group))])


def running_sums(blocks: DataFrame, group: Sequence[str], order: Sequence[str], upto: Mapping[str, Column] | None = None,
                 onward: Mapping[str, Column] | None = None) -> DataFrame:
    """Sums of expressions up to and with each row, or from it to the end, within its group.

    ``blocks`` comes from ``in_blocks``. A window adds up inside a block, another the block totals of a group; no task holds more
    than a block of rows or a group's totals.
    """
    upto, onward = dict(upto or {}), dict(onward or {})
    keys = [*group, PART]
    values = blocks.withColumns({f"_v_{n}": c for n, c in {**upto, **onward}.items()})
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    totals = values.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in (*upto, *onward)])
    carries = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in (*upto, *onward)],
                            *[F.sum(f"_t_{n}").over(whole).alias(f"_w_{n}") for n in onward])
    out = _with_carries(values, group, carries)
    run = {n: F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(inside) for n in (*upto, *onward)}
    out = out.withColumns({n: run[n] if n in upto else F.col(f"_w_{n}") - run[n] + F.col(f"_v_{n}") for n in run})
    return out.select(*blocks.columns, *run)


def neighbours(blocks: DataFrame, group: Sequence[str], order: Sequence[str], payload: str, below: str, above: str) -> DataFrame:
    """Adds the last ``payload`` that is not null at or before each row of its group, and the first after it.

    Each block is gone through once in either direction; the last and first payload of the blocks are carried over their edges.
    """
    keys = [*group, PART]
    up = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    known = F.when(F.col(payload).isNotNull(), place)
    edges = blocks.groupBy(*keys).agg(F.max_by(payload, known).alias("_last"), F.min_by(payload, known).alias("_first"))
    by_part = Window.partitionBy(*(group or [F.lit(0)]))
    earlier = by_part.orderBy(F.col(PART).asc()).rowsBetween(Window.unboundedPreceding, -1)
    later = by_part.orderBy(F.col(PART).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carries = edges.select(*keys, F.last("_last", ignorenulls=True).over(earlier).alias("_before"),
                           F.last("_first", ignorenulls=True).over(later).alias("_after"))
    out = _with_carries(blocks, group, carries)
    out = out.withColumn(below, F.coalesce(F.last(payload, ignorenulls=True).over(up), F.col("_before")))
    out = out.withColumn(above, F.coalesce(F.last(payload, ignorenulls=True).over(down), F.col("_after")))
    return out.drop("_before", "_after")
