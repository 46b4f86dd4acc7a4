"""First events after an index date, censoring and the long endpoint table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.predicates import on_or_after
from cohortloom.functions.skew import BROADCAST_ROWS, attach_index, fits, lookup_join
from cohortloom.functions.values import days_between


def code_events(events: DataFrame, codeset: DataFrame, code: str, codeset_code: str, group: str,
                condition: Column | None = None) -> DataFrame:
    """Event rows tagged with their code group; a constant join predicate goes in ``condition``."""
    if condition is not None:
        events = events.filter(condition)
    groups = codeset.select(F.col(codeset_code).alias(code), group).distinct()
    return lookup_join(events, groups, [code])


def first_event_after_index(cohort: DataFrame, events: DataFrame, keys: Sequence[str], index: str,
                            date: str, group: Sequence[str] = (), lookback_days: int = 0,
                            first: str = "first_date", small: bool | None = None) -> DataFrame:
    """Earliest event per person (and group) not before ``index - lookback_days``."""
    cols = [*keys, *group]
    dated = events.select(*cols, F.to_date(date).alias("_date"))
    joined = attach_index(dated, cohort.select(*keys, index), keys, distinct=True, small=small)
    inside = joined.filter(on_or_after(F.col("_date"), F.col(index), lookback_days))
    return inside.groupBy(*keys, index, *group).agg(F.min("_date").alias(first))


def union_sources(*firsts: DataFrame) -> DataFrame:
    """Distinct union of the per-source first events; sources with equal dates collapse."""
    return reduce(lambda a, b: a.unionByName(b), firsts).distinct()


@dataclass(frozen=True)
class EventRule:
    """Which rows of an event table count for a source, and by which codes and date."""

    source: str
    code: Column
    date: Column
    codes: DataFrame
    codes_column: str
    condition: Column | None = None
    lookback_days: int = 0


def first_events(cohort: DataFrame, events: DataFrame, rules: Sequence[EventRule], keys: Sequence[str], index: str, group: str,
                 first: str = "first_date", small: bool | None = None) -> DataFrame:
    """Earliest event per person, source and code group by all rules over one event table: ``(keys, index, source, group, first)``.

    The table is scanned once, whatever the number of rules: a row is tagged with the rules it satisfies, the code sets
    are one table tagged the same way, and the minimum is conditional on the source. A row may count for several.
    """
    tags = [F.when(F.lit(True) if r.condition is None else r.condition,
                   F.struct(F.lit(r.source).alias("source"), r.code.cast("string").alias("_code"), F.to_date(r.date).alias("_date"),
                            F.lit(r.lookback_days).alias("_back"))) for r in rules]
    tagged = events.select(*keys, F.inline(F.array_compact(F.array(*tags)))).filter(F.col("_date").isNotNull())
    codes = reduce(lambda a, b: a.unionByName(b), [
        r.codes.select(F.lit(r.source).alias("source"), F.col(r.codes_column).cast("string").alias("_code"), F.col(group)) for r in rules])
    coded = lookup_join(tagged, codes.distinct(), ["source", "_code"]).drop("_code")
    joined = attach_index(coded, cohort.select(*keys, index), keys, distinct=True, small=small)
    inside = joined.filter(F.col("_date") >= F.date_sub(F.col(index), F.col("_back")))
    return inside.groupBy(*keys, index, "source", group).agg(F.min("_date").alias(first))


@dataclass(frozen=True)
class ActivitySource:
    """Event table with a preferred and a substitute date column."""

    events: DataFrame
    primary: str
    fallback: str


def censor_date(cohort: DataFrame, sources: Sequence[ActivitySource], keys: Sequence[str],
                index: str, alias: str = "censor_date", small: bool | None = None) -> DataFrame:
    """Last activity on or after the index date over all sources.

    Per source the result is the latest primary date, or the latest fallback date when no
    primary one exists: the substitution happens after the maximum, not row by row. Only the
    row's own first known date decides whether it counts, so of each source two dates per person are
    enough: the latest primary one and, over the rows without one, the latest fallback. All sources are
    reduced to these in one grouping, before the join when the cohort is too large to broadcast; a frame
    that several sources share is read once.
    """
    slim = cohort.select(*keys, index)
    small = fits(slim, BROADCAST_ROWS) if small is None else small
    frames, pairs = {}, []
    for i, src in enumerate(sources):
        primary = F.to_date(src.primary)
        pairs.append((f"_a{i}", f"_b{i}"))
        frames.setdefault(id(src.events), (src.events, []))[1].extend([
            primary.alias(f"_a{i}"), F.when(primary.isNull(), F.to_date(src.fallback)).alias(f"_b{i}")])
    parts = [events.select(*keys, *cols) for events, cols in frames.values()]
    dated = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    dates = [c for pair in pairs for c in pair]
    latest = [F.max(c).alias(c) for c in dates]
    if small:
        joined = dated.join(F.broadcast(slim), keys)
        found = joined.filter(F.array_max(F.array(*dates)) >= F.col(index)).groupBy(*keys, index).agg(*latest)
    else:
        found = dated.filter(F.coalesce(*dates).isNotNull()).groupBy(*keys).agg(*latest).join(slim, keys)

    def since(c: str) -> Column:
        return F.when(F.col(c) >= F.col(index), F.col(c))

    ends = F.array_max(F.array(*[F.coalesce(since(a), since(b)) for a, b in pairs]))
    return (found.select(*keys, index, ends.alias(alias)).filter(F.col(alias).isNotNull())
            .groupBy(*keys, index).agg(F.max(alias).alias(alias)))


def endpoint_stack(parts: Mapping[str | None, tuple[DataFrame, str, str | None]],
                   keys: Sequence[str], index: str) -> DataFrame:
    """Long endpoint table ``(keys, index, endpoint, endpoint_date, days)`` without repeats.

    ``parts`` maps a label to ``(frame, date column, group column)``; with a group column the
    endpoint name is read from it.
    """
    out = []
    for label, (df, date, group) in parts.items():
        name = F.col(group) if group else F.lit(label)
        out.append(df.select(
            *keys, index, name.alias("endpoint"), F.col(date).alias("endpoint_date"),
            days_between(F.col(index), F.col(date)).alias("days")))
    return reduce(lambda a, b: a.unionByName(b), out).distinct()
