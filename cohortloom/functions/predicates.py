"""Boolean column expressions: code, text and date filters.

Everything here is a plain Catalyst expression, so prefix, IN and null tests reach the parquet
reader as pushed filters.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions) if conditions else F.lit(False)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)


def starts_with_any(code: Column, prefixes: Sequence[str]) -> Column:
    return any_of([code.startswith(p) for p in prefixes])


def ends_with_any(code: Column, suffixes: Sequence[str]) -> Column:
    return any_of([code.endswith(s) for s in suffixes])


def code_matches(code: Column, exact: Sequence[str] = (), prefixes: Sequence[str] = ()) -> Column:
    """Exact code list or any of the prefixes."""
    parts = [code.isin(*exact)] if exact else []
    if prefixes:
        parts.append(starts_with_any(code, prefixes))
    return any_of(parts)


def text_contains_any(text: Column, words: Sequence[str]) -> Column:
    """Case-insensitive substring test; the words are given in lower case."""
    low = F.lower(text)
    return any_of([low.contains(w) for w in words])


def text_excludes_any(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(text)
    return all_of([~low.contains(w) for w in words])


def text_like(text: Column, pattern: str) -> Column:
    """Ordered wildcards, e.g. ``%platelet%count%``, ignoring case."""
    return F.lower(text).like(pattern)


def type_matches(kind: Column, prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    return any_of([kind.startswith(p) for p in prefixes] + [kind.endswith(s) for s in suffixes])


def guarded_inclusion(
    code: Column,
    open_prefixes: Sequence[str],
    guarded_prefixes: Sequence[str],
    guard: Column,
    date_guard: str = "as_written",
) -> Column:
    """Two code families of which only the second is bound to a date guard.

    ``as_written`` keeps the precedence of an unparenthesised ``A OR B AND guard``;
    ``all`` applies the guard to both families.
    """
    if date_guard == "as_written":
        return starts_with_any(code, open_prefixes) | (
            starts_with_any(code, guarded_prefixes) & guard
        )
    if date_guard == "all":
        return starts_with_any(code, [*open_prefixes, *guarded_prefixes]) & guard
    raise ValueError(f"date_guard must be 'as_written' or 'all', not {date_guard!r}")


def on_or_after(date: Column, index: Column, lookback_days: int = 0) -> Column:
    """``date`` is at most ``lookback_days`` before ``index``."""
    start = F.date_sub(index, lookback_days) if lookback_days else index
    return date >= start


def year_between(date: Column, first: int, last: int) -> Column:
    return F.year(date).between(first, last)


def is_member(value: Column, members: Sequence[str]) -> Column:
    """Set membership that is false, not null, for a missing value (safe to negate)."""
    return F.coalesce(value.isin(*members), F.lit(False))
