"""The pattern index gives what testing every pattern on every text gives."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortloom.functions.patterns import match_patterns
from cohortloom.operators.codesets import build_codeset_from_rules

ODD_TEXTS = [None, "", "a", "ab", "100%", "a_b", "Ünïcode \U0001f600\U0001f601 text", "ABC abc", "ABC abc", "x" * 3000 + "needle"]
ODD_PATTERNS = [None, "", "%", "_", "__", "a%", "%b", "%a_b%", r"%\%", r"a\_b", "%\U0001f600\U0001f601%", "abc abc", "%ab%ab%", "%needle",
                "%zzz%", "abc_abc", "%ï%", "%abc%", "%abc%"]


def compiled(pattern):
    parts = re.findall(r"\\.|.", pattern, re.S)
    return re.compile("".join(".*" if p == "%" else "." if p == "_" else re.escape(p[-1]) for p in parts), re.S)


def pairs(texts, patterns):
    rules = [(j, compiled(p)) for j, p in enumerate(patterns) if p is not None]
    return sorted((i, j) for j, rule in rules for i, t in enumerate(texts) if t is not None and rule.fullmatch(t.lower()))


@pytest.mark.parametrize("max_rows", [1_000_000, 0])
def test_odd_patterns(spark, max_rows):
    texts = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "i int, t string")
    patterns = spark.createDataFrame(list(enumerate(ODD_PATTERNS)), "j int, p string")
    out = match_patterns(texts, "t", patterns, "p", max_rows)
    assert out.columns == ["i", "t", "j", "p"]
    assert sorted((r["i"], r["j"]) for r in out.collect()) == pairs(ODD_TEXTS, ODD_PATTERNS)
    assert match_patterns(texts.limit(0), "t", patterns, "p", max_rows).count() == 0
    assert match_patterns(texts, "t", patterns.limit(0), "p", max_rows).count() == 0


def test_thousands_of_patterns_in_one_join(spark):
    rng = random.Random(3)
    syllables = "al be cor di en fo gra hu in ju ka lo mi no pra ri sol tu um vi".split()
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(3)) for _ in range(150)]
    patterns = sorted({"%" + "%".join("".join(rng.choices(syllables, k=2)) for _ in range(rng.randint(1, 2))) + "%" for _ in range(12000)})
    assert len(patterns) > 5000
    out = match_patterns(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t",
                         spark.createDataFrame(list(enumerate(patterns)), "j int, p string"), "p")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert sorted((r["i"], r["j"]) for r in out.select("i", "j").collect()) == pairs(texts, patterns)


def test_rule_table(spark):
    """An excluding pattern takes a row out of its own group only; repeats and missing flags change nothing."""
    names = ["Alpha tablet", "alpha cream", "beta tablet", None, "alpha tablet"]
    dictionary = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "code int, name string")
    rules = spark.createDataFrame([("a", "%alpha%", False), ("a", "%cream%", True), ("any", "%tablet%", None), ("any", "%tablet%", False),
                                   ("any", "%alpha%", False), ("none", "%beta%", True)], "therapy string, pattern string, exclude boolean")
    out = build_codeset_from_rules(dictionary, rules, "name", ["code"])
    assert sorted(map(tuple, out.collect())) == [(0, "a"), (0, "any"), (1, "any"), (2, "any"), (4, "a"), (4, "any")]
    twice = dictionary.unionByName(dictionary).withColumn("code", F.col("code") * 0)
    assert sorted(map(tuple, build_codeset_from_rules(twice, rules, "name", ["code"]).collect())) == [(0, "a"), (0, "any")]
