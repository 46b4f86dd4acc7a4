"""Baseline measurements: stacking, cleaning, nearest-to-index choice, z-scores and flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.predicates import any_of, is_member, starts_with_any
from cohortloom.functions.scans import in_blocks, neighbours
from cohortloom.functions.skew import attach_index, fits, lookup_join
from cohortloom.functions.values import days_between, decade_bucket, lms_zscore, round_half_even
from cohortloom.operators.cohort import earliest
from cohortloom.sources.contracts import assert_unique

REFERENCE_ROWS = 20_000


def vitals_stack(cohort: DataFrame, wide: DataFrame, long: DataFrame, keys: Sequence[str],
                 index: str, wide_columns: Mapping[str, tuple[str, str]], wide_date: str,
                 long_codes: Mapping[str, str], long_code: str, long_value: str, long_unit: str,
                 long_date: str, small: bool | None = None) -> DataFrame:
    """Measurements from a wide table and a coded long table as distinct rows.

    ``wide_columns`` maps a type to ``(column, unit)`` and is unpivoted in one scan;
    ``long_codes`` maps a code to a type. Repeats are removed before any integer cast.
    """
    entries = F.array(*[
        F.struct(F.lit(kind).alias("vital_type"), F.col(col).cast("double").alias("vital_val"),
                 F.lit(unit).alias("vital_unit"))
        for kind, (col, unit) in wide_columns.items()])
    from_wide = (wide.select(*keys, F.to_date(wide_date).alias("measure_date"), F.inline(entries))
                 .filter(F.col("vital_val").isNotNull()))
    kind = F.create_map(*[F.lit(x) for pair in long_codes.items() for x in pair])
    from_long = (long.filter(F.col(long_code).isin(*long_codes))
                 .select(*keys, F.to_date(long_date).alias("measure_date"),
                         kind[F.col(long_code)].alias("vital_type"),
                         F.col(long_value).cast("double").alias("vital_val"),
                         F.col(long_unit).alias("vital_unit")))
    stacked = from_wide.unionByName(from_long).distinct()
    joined = attach_index(stacked, cohort.select(*keys, index), keys, small=small)
    return joined.select(*keys, "vital_type", "vital_val", "vital_unit", "measure_date",
                         days_between(F.col(index), F.col("measure_date")).alias("days"))


def dx_groups(cohort: DataFrame, events: DataFrame, rules: Mapping[str, Sequence[str]],
              keys: Sequence[str], index: str, code: str, date: Column,
              small: bool | None = None) -> DataFrame:
    """Distinct (person, group, code, date) rows for code-prefix groups, in one scan."""
    every = [p for prefixes in rules.values() for p in prefixes]
    hits = F.array_compact(F.array(*[
        F.when(starts_with_any(F.col(code), prefixes), F.lit(group))
        for group, prefixes in rules.items()]))
    tagged = (events.filter(starts_with_any(F.col(code), every))
              .select(*keys, F.explode(hits).alias("dx_group"), F.col(code).alias("dx"),
                      date.alias("dx_date")).distinct())
    joined = attach_index(tagged, cohort.select(*keys, index), keys, distinct=True, small=small)
    return joined.select(*keys, "dx_group", "dx", "dx_date",
                         days_between(F.col(index), F.col("dx_date")).alias("days"))


def lab_events(cohort: DataFrame, labs: DataFrame, codeset: DataFrame, keys: Sequence[str],
               index: str, code: str, codeset_code: str, name: str,
               dates: Mapping[str, str], keep: Sequence[str], small: bool | None = None) -> DataFrame:
    """All result rows of the wanted labs with one day offset per date; nothing is removed.

    ``dates`` maps a date column to the name of its offset.
    """
    codes = codeset.select(F.col(codeset_code).alias(code), name)
    wanted = lookup_join(labs.select(*keys, code, *dates, *keep), codes, [code])
    joined = attach_index(wanted, cohort.select(*keys, index), keys, small=small)
    offsets = [days_between(F.col(index), F.col(d)).alias(o) for d, o in dates.items()]
    return joined.select(*keys, name, *dates, *keep, *offsets)


def inpatient_encounters(cohort: DataFrame, encounters: DataFrame, keys: Sequence[str], index: str,
                         kind: str, kinds: Sequence[str], admit: str, discharge: str,
                         small: bool | None = None) -> DataFrame:
    """Stays of the wanted types with admission offset and length."""
    stays = encounters.filter(F.col(kind).isin(*kinds)).select(*keys, kind, admit, discharge)
    joined = attach_index(stays, cohort.select(*keys, index), keys, small=small)
    return joined.select(*keys, kind, admit, discharge,
                         days_between(F.col(index), F.col(admit)).alias("admit_days"),
                         days_between(F.col(admit), F.col(discharge)).alias("los"))


@dataclass(frozen=True)
class UnitRule:
    """Division applied to one measurement type under a unit test and a value test."""

    kind: str
    divisor: float
    unit_contains: str | None = None
    unit_equals: str | None = None
    above: float | None = None


def convert_units(df: DataFrame, rules: Sequence[UnitRule], kind: str, value: str, unit: str) -> DataFrame:
    """Apply the first matching rule; unit tests are case-sensitive and fail on a missing unit."""
    out = None
    for r in rules:
        hit = F.col(kind) == r.kind
        if r.unit_contains is not None:
            hit = hit & F.col(unit).contains(r.unit_contains)
        if r.unit_equals is not None:
            hit = hit & (F.col(unit) == r.unit_equals)
        if r.above is not None:
            hit = hit & (F.col(value) > r.above)
        converted = F.col(value) / F.lit(r.divisor)
        out = F.when(hit, converted) if out is None else out.when(hit, converted)
    return df if out is None else df.withColumn(value, out.otherwise(F.col(value)))


@dataclass(frozen=True)
class PlausibleRule:
    """Allowed units and value limits of one measurement type."""

    kind: str
    below: float | None = None
    above: float | None = None
    at_most: float | None = None
    units: tuple[str, ...] | None = None
    not_units: tuple[str, ...] | None = None


def plausible_range(df: DataFrame, rules: Sequence[PlausibleRule], kind: str, value: str,
                    unit: str | None = None, keep_unlisted: bool = False) -> DataFrame:
    """Keep rows that satisfy the rule of their type; a null test counts as failed.

    Types without a rule are dropped, or pass with ``keep_unlisted``.
    """
    arms = []
    for r in rules:
        ok = F.col(kind) == r.kind
        if r.below is not None:
            ok = ok & (F.col(value) < r.below)
        if r.above is not None:
            ok = ok & (F.col(value) > r.above)
        if r.at_most is not None:
            ok = ok & (F.col(value) <= r.at_most)
        if r.units is not None:
            ok = ok & is_member(F.col(unit), r.units)
        if r.not_units is not None:
            ok = ok & ~F.col(unit).isin(*r.not_units)
        arms.append(ok)
    if keep_unlisted:
        arms.append(~is_member(F.col(kind), [r.kind for r in rules]))
    return df.filter(any_of(arms))


def nearest_to_index(df: DataFrame, keys: Sequence[str], offset: Column, tiebreak: Sequence[str]) -> DataFrame:
    """Row with the smallest absolute offset per key, missing offsets last."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.abs(offset), *tiebreak]
    return earliest(df, keys, order, rest)


def nearest_within(df: DataFrame, keys: Sequence[str], offset: Column, tiebreak: Sequence[str],
                   latest: int) -> DataFrame:
    """Nearest row first, window after: a nearest value past ``latest`` removes the key."""
    return nearest_to_index(df, keys, offset, tiebreak).filter(offset <= latest)


def same_day_pivot(df: DataFrame, keys: Sequence[str], day: str, kind: str, value: str,
                   values: Sequence[str], require: Sequence[str] = ()) -> DataFrame:
    """One column per type for values of the same day; ``require`` must all be present."""
    wide = df.groupBy(*keys, day).agg(
        *[F.max(F.when(F.col(kind) == v, F.col(value))).alias(v) for v in values])
    return wide.dropna(subset=list(require)) if require else wide


def derived_bmi(df: DataFrame, height: str = "HT", weight: str = "WT", bmi: str = "BMI",
                upper: float = 60) -> DataFrame:
    """Fill a missing BMI from height and weight (rounded half to even) and drop absurd rows.

    A height of zero gives no BMI: the row stays only with a measured one.
    """
    computed = round_half_even(F.try_divide(F.col(weight), F.col(height) * F.col(height)))
    return (df.withColumn(bmi, F.coalesce(F.col(bmi), computed))
            .filter((F.col(weight) > 0) & (F.col(bmi) > 0) & (F.col(bmi) < upper)))


def growth_age(df: DataFrame, persons: DataFrame, keys: Sequence[str], age_days: str, sex: str,
               day: str, small: bool | None = None) -> DataFrame:
    """Age in months at the measurement, its decade bucket, and the numeric sex code."""
    joined = attach_index(df, persons.select(*keys, age_days, sex), keys, small=small)
    months = F.bround((F.col(age_days) + F.col(day)) / 30, 1)
    return (joined.withColumn("agemos", months)
            .withColumn("bucket", decade_bucket(F.col("agemos")).cast("int"))
            .withColumn("sex_code", F.when(F.col(sex) == "M", 1).otherwise(2)))


def nearest_reference_join(df: DataFrame, reference: DataFrame, equal: Mapping[str, str], value: str, point: str,
                           keep: Mapping[str, str], max_rows: int = REFERENCE_ROWS) -> DataFrame:
    """Left join to the reference row nearest to ``value`` among those with equal keys.

    A reference that is measured to fit becomes one broadcast row per equality key holding its
    sorted points, and the choice is an array expression inside the row. With a larger one the
    distinct asked values and the points are merged in one order, range by range: each value meets the last point
    at or below it and the first above, carried over the edges of ranges, so nothing grows beyond values plus points.
    Ties take the lower point, of equal points the smallest row; both ways answer each input row once.
    ``keep`` maps reference columns to output names.
    """
    renamed = reference.select(
        *[F.col(r).alias(l) for l, r in equal.items()],
        F.col(point).alias("_point"), *[F.col(c).alias(f"_k_{c}") for c in keep])
    gap = lambda p: F.abs(p - F.col(value))
    fields = F.struct(F.col("_point"), *[F.col(f"_k_{c}") for c in keep])
    if fits(reference, max_rows):
        lists = renamed.groupBy(*equal).agg(F.collect_list(fields).alias("_points"))
        joined = df.join(F.broadcast(lists), list(equal), "left")
        ranked = F.transform("_points", lambda p: F.struct(
            gap(p["_point"]).alias("_gap"), p["_point"].alias("_point"), p.alias("_hit")))
        best = joined.withColumn("_best", F.array_min(ranked)["_hit"])
        return best.select(*df.columns, F.col("_best._point").alias(point),
                           *[F.col(f"_best._k_{c}").alias(n) for c, n in keep.items()])
    asked = [*equal, value]
    points = renamed.filter(F.col("_point").isNotNull()).groupBy(*equal, F.col("_point").cast("double").alias("_at")).agg(F.min(fields).alias("_hit"))
    values = df.select(*equal, F.col(value).cast("double").alias("_at")).distinct()
    merged = points.unionByName(values.withColumn("_hit", F.lit(None).cast(points.schema["_hit"].dataType)))
    # at one place points come first, so that a value meets the point it stands on
    blocks = in_blocks(merged.withColumn("_asked", F.col("_hit").isNull().cast("int")), list(equal), ["_at", "_asked"])
    near = neighbours(blocks, list(equal), ["_at", "_asked"], "_hit", "_low", "_high").filter("_asked = 1")
    low, high = F.col("_at") - F.col("_low._point"), F.col("_high._point") - F.col("_at")
    # without a value there is no distance: the smallest point, as the minimum over all would take
    best = F.when(F.col("_low").isNull() | (high < low), F.col("_high")).otherwise(F.col("_low"))
    found = near.select(*[F.col(f"`{c}`").alias(f"_a{i}") for i, c in enumerate(equal)], F.col("_at").alias(f"_a{len(equal)}"), best.alias("_best"))
    same = F.lit(True)
    for i, c in enumerate(asked):
        same = same & (F.col(f"`{c}`") == F.col(f"_a{i}") if c != value else F.col(f"`{c}`").cast("double").eqNullSafe(F.col(f"_a{i}")))
    return df.join(found, same, "left").select(*df.columns, F.col("_best._point").alias(point),
                                               *[F.col(f"_best._k_{c}").alias(n) for c, n in keep.items()])


def growth_zscores(df: DataFrame, curves: Mapping[str, tuple[DataFrame, float]],
                   keys: Sequence[str]) -> DataFrame:
    """``<measure>_Z`` per measure from ``{measure: (curve, factor)}``.

    The factor brings the measure to the unit of the curve. Curves are joined one after another,
    each one-to-one, so no shuffle is added while the curves fit.
    """
    columns = list(df.columns)
    for measure, (curve, factor) in curves.items():
        parts = {c: f"_{measure}_{c}" for c in ("l", "m", "s")}
        df = _with_curve(df, curve, parts)
        df = df.withColumn(f"{measure}_Z", lms_zscore(
            F.col(measure) * factor, *[F.col(parts[c]) for c in ("l", "m", "s")]))
        columns.append(f"{measure}_Z")
        df = df.select(*columns)
    return df


def _with_curve(df: DataFrame, curve: DataFrame, parts: Mapping[str, str]) -> DataFrame:
    reference = curve.select(
        decade_bucket(F.col("agemos")).cast("int").alias("bucket"),
        F.col("sex").cast("int").alias("sex"), F.col("agemos").alias("curve_agemos"), "l", "m", "s")
    return nearest_reference_join(df, reference, {"bucket": "bucket", "sex_code": "sex"},
                                  "agemos", "curve_agemos", parts)


def presence_flags(base: DataFrame, wide: DataFrame, keys: Sequence[str], columns: Sequence[str],
                   suffix: str = "_ind") -> DataFrame:
    """``<column>_ind`` = value present; persons absent from ``wide`` get 0."""
    joined = base.select(*keys).join(wide.select(*keys, *[F.col(f"`{c}`") for c in columns]),
                                     list(keys), "left")
    return joined.select(*keys, *[F.col(f"`{c}`").isNotNull().cast("int").alias(f"{c}{suffix}")
                                  for c in columns])


def inpatient_flags(cohort: DataFrame, encounters: DataFrame, keys: Sequence[str], index_type: str,
                    kinds: Sequence[str], kind: str = "enc_type", admit_days: str = "admit_days",
                    los: str = "los") -> DataFrame:
    """Three indications of an inpatient start.

    ``IP_IND1`` from the type of the index event, ``IP_IND2`` when a stay contains the index
    day (a stay of unknown length never does), ``IP_IND3`` when a stay begins on it.
    """
    start, length = F.col(admit_days), F.col(los)
    inside = F.coalesce((start <= 0) & (start + length >= 0), F.lit(False)).cast("int")
    at_zero = F.coalesce(start == 0, F.lit(False)).cast("int")
    stays = (encounters.filter(F.col(kind).isin(*kinds)).groupBy(*keys)
             .agg(F.max(inside).alias("IP_IND2"), F.max(at_zero).alias("IP_IND3")))
    return (cohort.select(*keys, index_type,
                          is_member(F.col(index_type), kinds).cast("int").alias("IP_IND1"))
            .join(stays, list(keys), "left").fillna(0, ["IP_IND2", "IP_IND3"]))


def clean_labs(df: DataFrame, rules: Sequence[PlausibleRule], units: Sequence[UnitRule], name: str,
               value: str, unit: str) -> DataFrame:
    """Drop missing results and those outside their lab's rule, then convert units."""
    kept = plausible_range(df.filter(F.col(value).isNotNull()), rules, name, value, unit,
                           keep_unlisted=True)
    return convert_units(kept, units, name, value, unit)


def lab_abstraction(df: DataFrame, keys: Sequence[str], name: str, value: str,
                    offsets: Sequence[str], labs: Sequence[str], latest: int = 30,
                    tiebreak: Sequence[str] = ()) -> DataFrame:
    """One column per lab: the result nearest to index by the first known offset."""
    offset = F.coalesce(*[F.col(o) for o in offsets])
    ties = list(dict.fromkeys([*offsets, *tiebreak, value]))
    picked = nearest_within(df.filter(F.col(name).isin(*labs)), [*keys, name], offset, ties, latest)
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col(name) == lab, F.col(value))).alias(lab) for lab in labs])


def baseline_dx_flags(cohort: DataFrame, diagnoses: DataFrame, keys: Sequence[str],
                      groups: Sequence[str], group: str = "dx_group", days: str = "days") -> DataFrame:
    """0/1 per diagnosis group seen on or before the index day."""
    seen = diagnoses.filter(F.col(days) <= 0).groupBy(*keys).agg(
        *[F.max((F.col(group) == g).cast("int")).alias(g) for g in groups])
    return cohort.select(*keys).join(seen, list(keys), "left").fillna(0, list(groups))


def analysis_set(cohort: DataFrame, endpoints: DataFrame, others: Sequence[DataFrame],
                 keys: Sequence[str], index: str, check: bool = True) -> DataFrame:
    """One row per person: cohort, endpoints (inner) and every other table (left).

    A column already present keeps its first copy. With ``check`` each joined side must have
    unique keys, so the result cannot fan out.
    """
    out = cohort.withColumn("index_year", F.year(index))
    for i, side in enumerate([endpoints, *others]):
        if check:
            assert_unique(side, keys)
        new = [c for c in side.columns if c in keys or c not in out.columns]
        out = out.join(side.select(*[F.col(f"`{c}`") for c in new]), list(keys),
                       "inner" if i == 0 else "left")
    return out
