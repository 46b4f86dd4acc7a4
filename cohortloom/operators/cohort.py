"""Index events, exclusion and attrition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.skew import BROADCAST_ROWS, fits, skew_join


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: Sequence[str]) -> DataFrame:
    """First row per key by ``order`` with nulls last.

    A minimum over a struct is combined map-side, so a key with very many rows is reduced
    where it is read; a row_number window would sort it in one task. A column that ``order`` names is
    carried once, even if it is kept too.
    """
    rank, place = [], {}
    for i, item in enumerate(order):
        col = F.col(f"`{item}`") if isinstance(item, str) else item
        rank += [col.isNull().alias(f"_n{i}"), col.alias(f"_o{i}")]
        if isinstance(item, str):
            place[item] = f"_o{i}"
    rest = [c for c in keep if c not in place]
    payload = [F.struct(*[F.col(f"`{c}`").alias(c) for c in rest]).alias("_row")] if rest else []
    best = df.groupBy(*keys).agg(F.min(F.struct(*rank, *payload)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{place[c]}" if c in place else f"_best._row.`{c}`").alias(c) for c in keep])


def index_event(events: DataFrame, persons: DataFrame, keys: Sequence[str], date: str,
                condition: Column, event_keep: Sequence[str] = (), tiebreak: Sequence[str] = (),
                person_keep: Sequence[str] = (), small: bool | None = None) -> DataFrame:
    """First qualifying event per person with its attributes and the person's.

    ``condition`` may use any event and person column: it is tested on every joined event row. A
    person table that fits is broadcast; otherwise the events of a hot person are spread over
    several tasks by ``skew_join``. Both ways test the same rows.
    """
    keys = list(keys)
    if fits(persons, BROADCAST_ROWS) if small is None else small:
        joined = events.join(F.broadcast(persons), keys)
    else:
        joined = skew_join(events, persons, keys)
    joined = joined.filter(condition)
    order = list(dict.fromkeys([date, *tiebreak, *person_keep]))
    keep = list(dict.fromkeys([date, *event_keep, *person_keep]))
    return earliest(joined, keys, order, keep)


def exclusion_set(events: DataFrame, condition: Column, keys: Sequence[str]) -> DataFrame:
    return events.filter(condition).select(*keys).distinct()


def apply_exclusion(included: DataFrame, excluded: DataFrame, keys: Sequence[str],
                    condition: Column) -> DataFrame:
    return included.filter(condition).join(excluded, list(keys), "left_anti")


def attrition(included: DataFrame, excluded: DataFrame, person: str, site: str, age: str,
              age_limit: int = 18, sites: DataFrame | None = None) -> DataFrame:
    """Persons per step and site: initial, exclude-age, exclude-dx, eligible.

    ``exclude-age`` counts ages above the limit and ``eligible`` ages below it, so an age equal
    to the limit is in neither. Each person is reduced to one row of flags; a site without
    persons still reports zeros when it is in ``sites``.
    """
    steps = ["initial", "exclude-age", "exclude-dx", "eligible"]
    inc = included.select(site, person, F.lit(1).alias("inc"),
                          (F.col(age) > age_limit).cast("int").alias("old"),
                          (F.col(age) < age_limit).cast("int").alias("young"),
                          F.lit(0).alias("dx"))
    exc = excluded.select(site, person, F.lit(0).alias("inc"), F.lit(0).alias("old"),
                          F.lit(0).alias("young"), F.lit(1).alias("dx"))
    flags = inc.unionByName(exc).groupBy(site, person).agg(
        *[F.max(c).alias(c) for c in ("inc", "old", "young", "dx")])
    counts = flags.groupBy(site).agg(
        F.sum("inc").alias("initial"),
        F.sum("old").alias("exclude-age"),
        F.sum("dx").alias("exclude-dx"),
        F.sum(F.when(F.col("dx") == 0, F.col("young")).otherwise(0)).alias("eligible"))
    if sites is not None:
        counts = sites.select(site).distinct().join(counts, site, "left")
    counts = counts.fillna(0, steps)
    return counts.unpivot([site], steps, "criterion", "pat_cnt").select(
        "criterion", F.col("pat_cnt").cast("int").alias("pat_cnt"), site)


def dedup_person(cohort: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Keep the row with the earliest ``by`` per key; further columns break ties."""
    rest = [c for c in cohort.columns if c not in keys]
    order = [by, *[c for c in rest if c != by]]
    return earliest(cohort, keys, order, rest).select(*cohort.columns)


def exclusion_counts(df: DataFrame, first_treatment: str, other_first: Sequence[str]) -> DataFrame:
    """Persons without any treatment and persons that began with a non-standard one."""
    first = F.col(first_treatment)
    return df.agg(F.count_if(first.isNull()).alias("no_treatment"),
                  F.count_if(first.isin(*other_first)).alias("other_first_treatment"))
