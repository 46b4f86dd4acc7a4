"""Scalar column expressions: dates, ages, rounding, recoding, text cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_date(*candidates: Column) -> Column:
    """First known of several dates, as a date (sources may hold timestamps)."""
    return F.coalesce(*[F.to_date(c) for c in candidates])


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(F.to_date(end), F.to_date(start))


def age_years(birth: Column, at: Column) -> Column:
    """Whole years, rounded half away from zero (17.6 years counts as 18)."""
    return F.round(days_between(birth, at) / F.lit(365.25)).cast("int")


def round_to_int(value: Column) -> Column:
    """Integer cast that rounds; a bare Spark cast would truncate."""
    return F.round(value).cast("int")


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def recode(value: Column, levels: Mapping[str, Sequence[str]], missing: str, other: str,
           missing_codes: Sequence[str] = ()) -> Column:
    """Map code lists to labels; null and ``missing_codes`` share one label, the rest another."""
    out = F.when(value.isNull() | value.isin(*missing_codes), missing) if missing_codes else F.when(
        value.isNull(), missing)
    for label, codes in levels.items():
        out = out.when(value.isin(*codes), label)
    return out.otherwise(other)


def threshold_flag(value: Column, at_least: float) -> Column:
    return (value >= at_least).cast("int")


def least_strict(*values: Column) -> Column:
    """Smallest value, null as soon as one is null (``F.least`` skips nulls)."""
    any_null = values[0].isNull()
    for v in values[1:]:
        any_null = any_null | v.isNull()
    return F.when(~any_null, F.least(*values) if len(values) > 1 else values[0])


def decade_bucket(value: Column) -> Column:
    return F.floor(value / 10) * 10


def lms_zscore(x: Column, l: Column, m: Column, s: Column) -> Column:
    """Box-Cox z-score against a reference curve; the log form where L is zero."""
    return F.when(l == 0, F.ln(x / m) / s).otherwise((F.pow(x / m, l) - 1) / (l * s))


def n_pct(n: Column, total: Column) -> Column:
    """``n (p%)`` with a whole percentage."""
    pct = F.round(n / total * 100).cast("bigint").cast("string")
    return F.concat(n.cast("string"), F.lit(" ("), pct, F.lit("%)"))


def n_pct_without(n: Column, total: Column) -> Column:
    """The complement cell: ``N-n (100-p%)``."""
    pct = F.round((F.lit(1) - n / total) * 100).cast("bigint").cast("string")
    return F.concat((total - n).cast("string"), F.lit(" ("), pct, F.lit("%)"))


def mean_sd(mean: Column, sd: Column) -> Column:
    """``mean (sd)``: whole mean, one-digit sample deviation; null when the deviation is."""
    return F.concat(
        F.round(mean).cast("bigint").cast("string"),
        F.lit(" ("),
        F.round(sd, 1).cast("decimal(18,1)").cast("string"),
        F.lit(")"),
    )
