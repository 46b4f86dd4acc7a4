"""Wide endpoint tables, treatment order, and times between states.

After the one pivot everything is a row-wise expression: a person has one value per endpoint,
so ordering treatments sorts a short array inside the row and needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.values import least_strict


def first_nonnegative_event(stack: DataFrame, keys: Sequence[str], endpoint: str = "endpoint",
                            days: str = "days") -> DataFrame:
    """Smallest day offset >= 0 per person and endpoint."""
    return (stack.filter(F.col(days) >= 0).groupBy(*keys, endpoint)
            .agg(F.min(days).alias(days)))


def pivot_endpoints(firsts: DataFrame, keys: Sequence[str], values: Sequence[str],
                    endpoint: str = "endpoint", days: str = "days",
                    require: str | None = "censor") -> DataFrame:
    """One column per endpoint; persons without the ``require`` endpoint are dropped."""
    wide = firsts.groupBy(*keys).agg(
        *[F.min(F.when(F.col(endpoint) == v, F.col(days))).alias(v) for v in values])
    return wide if require is None else wide.filter(F.col(f"`{require}`").isNotNull())


def composite_endpoint(df: DataFrame, name: str, members: Sequence[str]) -> DataFrame:
    """Earliest of several endpoints, ignoring the ones that never happened."""
    return df.withColumn(name, F.least(*[F.col(m) for m in members]))


def treatment_sequence(df: DataFrame, keys: Sequence[str], treatments: Sequence[str],
                       prefix: str = "trt", mode: str = "rank") -> DataFrame:
    """Names of the treatments in time order, for those with any; see ``with_sequence``."""
    out = with_sequence(df, treatments, prefix, mode).filter(F.col(f"{prefix}1").isNotNull())
    return out.select(*keys, *[f"{prefix}{k}" for k in range(1, len(treatments) + 1)])


def with_sequence(df: DataFrame, treatments: Sequence[str], prefix: str = "trt", mode: str = "rank") -> DataFrame:
    """``trt1`` .. ``trtN`` beside the other columns: the names of the treatments in time order.

    ``rank`` labels each treatment with its position in time (ties by column order). ``order``
    reproduces labels taken from a sorting permutation: treatment number i gets the position
    of the i-th smallest value; the two differ only for cyclic permutations of three or more.
    """
    given = F.array_compact(F.array(*[
        F.when(F.col(t).isNotNull(), F.struct(
            F.col(t).alias("val"), F.lit(i).alias("pos"), F.lit(t).alias("name")))
        for i, t in enumerate(treatments)]))
    columns = df.columns
    df = df.withColumn("_given", given).withColumn("_sorted", F.array_sort("_given"))
    out = []
    for k in range(1, len(treatments) + 1):
        if mode == "rank":
            entry = F.get("_sorted", F.lit(k - 1))
        elif mode == "order":
            kth = F.get("_given", F.lit(k - 1))
            rank = F.array_position("_sorted", kth)
            entry = F.get("_given", F.when(rank > 0, rank.cast("int") - 1))
        else:
            raise ValueError(f"mode must be 'rank' or 'order', not {mode!r}")
        out.append(entry["name"].alias(f"{prefix}{k}"))
    return df.select(*[F.col(f"`{c}`") for c in columns], *out)


def after_first_flags(df: DataFrame, flags: dict[str, str], treatments: int = 4,
                      prefix: str = "trt") -> DataFrame:
    """0/1 columns: the named treatment came second or later."""
    later = [f"{prefix}{k}" for k in range(2, treatments + 1)]
    cols = {}
    for name, treatment in flags.items():
        hit = F.lit(False)
        for c in later:
            hit = hit | F.coalesce(F.col(c) == treatment, F.lit(False))
        cols[name] = hit.cast("int")
    return df.withColumns(cols)


def status_time(df: DataFrame, endpoints: Sequence[str], censor: str = "censor") -> DataFrame:
    """``status_<e>`` = happened, ``time_<e>`` = its day or the censoring day."""
    cols = {}
    for e in endpoints:
        cols[f"status_{e}"] = F.col(e).isNotNull().cast("int")
        cols[f"time_{e}"] = F.coalesce(F.col(e), F.col(censor))
    return df.withColumns(cols)


@dataclass(frozen=True)
class Transition:
    """Days from the start of one treatment to another among persons who began with it."""

    name: str
    first: str
    start: tuple[str, ...]
    end: str


def _taken_time(endpoint: str) -> Column:
    """Day of an endpoint, zero when it never happened."""
    return F.col(f"time_{endpoint}") * F.col(f"status_{endpoint}")


def transition_times(df: DataFrame, transitions: Sequence[Transition],
                     first_treatment: str = "trt1") -> DataFrame:
    """Positive waiting times; null otherwise.

    The start is the minimum of the zeroed member times, so a composite start is zero when
    only one member was taken.
    """
    cols = {}
    for t in transitions:
        gap = _taken_time(t.end) - least_strict(*[_taken_time(s) for s in t.start])
        cols[t.name] = F.when((F.col(first_treatment) == t.first) & (gap > 0), gap)
    return df.withColumns(cols)


def index_to_first(df: DataFrame, members: Sequence[str], first: str = "standard",
                   alias: str = "time_idx2std", first_treatment: str = "trt1") -> DataFrame:
    """Days from index to the first-line start; zero for persons who began otherwise."""
    return df.withColumn(alias, F.when(
        F.col(first_treatment) == first,
        least_strict(*[F.col(f"time_{m}") for m in members])).otherwise(0))


def escalation_outcome(df: DataFrame, surgery: str, step_ups: Sequence[str], censor: str = "censor",
                       first: str = "standard", start: str = "time_idx2std",
                       first_treatment: str = "trt1") -> DataFrame:
    """Combined escalation outcome for persons who began with the first line.

    Adds ``status6`` (any escalation), ``status6_col`` (surgery), ``status_bio_imm`` (a step-up)
    and ``time6`` (earliest escalation, else censoring, minus the start of treatment). The status
    is null for a person without any treatment who escalated later, as three-valued logic has it.
    """
    begun = F.col(first_treatment) == first
    stepped = sum((F.col(f"status_{s}") for s in step_ups), F.lit(0)) > 0
    operated = F.col(f"status_{surgery}") > 0
    times = [F.col(f"time_{e}") for e in (surgery, *step_ups)]
    df = df.withColumns({
        "status6": (begun & (operated | stepped)).cast("int"),
        "status6_col": (begun & operated).cast("int"),
        "status_bio_imm": (begun & stepped).cast("int"),
    })
    return df.withColumn("time6", F.when(F.col("status6") == 1, least_strict(*times) - F.col(start))
                         .otherwise(F.col(censor) - F.col(start)))


def any_treatment_time(df: DataFrame, endpoints: Sequence[str], alias: str = "trt1_time",
                       first_treatment: str = "trt1") -> DataFrame:
    """Earliest of all endpoint times, zero for persons without a first treatment."""
    earliest = F.least(*[F.col(f"time_{e}") for e in endpoints])
    return df.withColumn(alias, earliest * F.col(first_treatment).isNotNull().cast("int"))
