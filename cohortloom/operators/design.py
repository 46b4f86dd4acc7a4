"""Model inputs: constant fills, factor coding and term selection."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_constants(df: DataFrame, values: Mapping[str, float | int | str]) -> DataFrame:
    return df.fillna(dict(values))


def factor_levels(df: DataFrame, column: str) -> list[str]:
    """Sorted levels of a factor; each will be a column, so the driver can name them all."""
    rows = df.select(F.col(f"`{column}`").cast("string").alias("v")).filter("v is not null").distinct().collect()
    return sorted(r["v"] for r in rows)


def dummy_code(df: DataFrame, factors: Mapping[str, str | None],
               levels: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """0/1 columns ``<factor><level>`` for every level but the reference.

    ``factors`` maps a column to its reference level (``None``: the first level). Returns the
    frame and, per factor, the columns that stand for it; a missing value stays missing in all.
    """
    terms, cols = {}, {}
    for name, ref in factors.items():
        known = list(levels[name]) if levels and name in levels else factor_levels(df, name)
        ref = known[0] if ref is None else ref
        terms[name] = [f"{name}{v}" for v in known if v != ref]
        for v in known:
            if v != ref:
                cols[f"{name}{v}"] = (F.col(f"`{name}`").cast("string") == v).cast("double")
    return df.withColumns(cols), terms


def select_terms(selected: Sequence[str], drop_pattern: str, force: Sequence[str] = ()) -> list[str]:
    """Hand selection: chosen variables without those matching a pattern, plus forced ones."""
    kept = [v for v in selected if not re.search(drop_pattern, v)]
    return kept + [v for v in force if v not in kept]
