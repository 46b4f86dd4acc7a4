"""Code sets built from dictionary tables in one scan each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.patterns import matching_texts
from cohortloom.functions.predicates import (
    text_contains_any,
    text_excludes_any,
    text_like,
    type_matches,
)
from cohortloom.functions.skew import lookup_join


@dataclass(frozen=True)
class DrugRule:
    """One arm of a drug code set."""

    group: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    type_prefixes: tuple[str, ...] = ()
    type_suffixes: tuple[str, ...] = ()


def _tag(df: DataFrame, tags: list, *names: str) -> DataFrame:
    """One output row per matching tag, so overlapping arms all keep the row."""
    matched = F.array_compact(F.array(*tags))
    return df.select("*", F.inline(matched).alias(*names))


def build_drug_codeset(dictionary: DataFrame, rules: Sequence[DrugRule], text: str, kind: str,
                       keep: Sequence[str], group: str = "therapy") -> DataFrame:
    """Distinct ``keep`` columns per arm, arms stacked without removing repeats between them."""
    tags = []
    for arm, rule in enumerate(rules):
        hit = (text_contains_any(F.col(text), rule.include)
               & text_excludes_any(F.col(text), rule.exclude)
               & type_matches(F.col(kind), rule.type_prefixes, rule.type_suffixes))
        tags.append(F.when(hit, F.struct(F.lit(arm).alias("_arm"), F.lit(rule.group).alias(group))))
    tagged = _tag(dictionary, tags, "_arm", group)
    return tagged.select("_arm", *keep, group).distinct().drop("_arm")


def crosswalk_codes(codeset: DataFrame, attributes: DataFrame, code: str, filters: Mapping[str, str],
                    target: str, target_name: str, keep: Sequence[str],
                    attribute_keep: Sequence[str] = (), copies: int = 1) -> DataFrame:
    """Translate codes through an attribute table restricted by constant filters.

    ``copies`` repeats each distinct row, for results that were stacked from identical arms.
    """
    narrowed = attributes
    for name, value in filters.items():
        narrowed = narrowed.filter(F.col(name) == value)
    narrowed = narrowed.select(code, F.col(target).alias(target_name), *attribute_keep)
    out = lookup_join(narrowed, codeset.select(*keep).distinct(), [code])
    out = out.select(*keep, target_name, *attribute_keep).distinct()
    if copies > 1:
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy")
    return out


def build_lab_codeset(dictionary: DataFrame, patterns: Mapping[str, str], text: str,
                      keep: Sequence[str], name: str = "lab_name") -> DataFrame:
    """Distinct dictionary rows per lab whose text matches the lab's wildcard pattern.

    A row that fits several patterns is kept once for each.
    """
    tags = [F.when(text_like(F.col(text), p), F.struct(F.lit(lab).alias(name)))
            for lab, p in patterns.items()]
    return _tag(dictionary, tags, name).select(name, *keep).distinct()


def build_codeset_from_rules(dictionary: DataFrame, rules: DataFrame, text: str, keep: Sequence[str], group: str = "therapy",
                             pattern: str = "pattern", exclude: str = "exclude") -> DataFrame:
    """Distinct ``keep`` columns per group of a rule table, which may hold thousands of patterns.

    A rule is a LIKE pattern in lower case; ``exclude`` tells whether it takes rows out. A row belongs to a group if one of
    the group's including patterns fits its text and none of the excluding ones. A missing ``exclude`` counts as false.
    """
    named = rules.select(F.col(group), F.col(pattern), F.coalesce(F.col(exclude), F.lit(False)).alias("_out"))
    hits = matching_texts(dictionary, text, named, pattern)
    fitting = hits.groupBy("_text", group).agg(F.bool_or("_out").alias("_out")).filter(~F.col("_out")).drop("_out")
    rows = dictionary.select(*keep, F.lower(F.col(text)).alias("_text")).distinct()
    return lookup_join(rows, fitting, ["_text"]).select(*keep, group).distinct()


def codeset_counts(codeset: DataFrame, group: str, counted: str, alias: str) -> DataFrame:
    return codeset.groupBy(group).agg(F.countDistinct(counted).alias(alias))
