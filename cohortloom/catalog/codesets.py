"""Code sets from the part dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog import query, star
from cohortloom.catalog.star import table
from cohortloom.functions.patterns import match_patterns
from cohortloom.operators.codesets import build_codeset_from_rules, build_lab_codeset, codeset_counts

LAB_PATTERNS = {
    "hemoglobin": "%red%",
    "platelet_count": "%l%g%r%",
    "leukocyte": "%old%",
    "albumin": "%gear%",
}


@query("drug_codeset", star.sql("SELECT p_partkey, p_name, p_type, therapy FROM codeset", star.CODESET_SQL))
def q_drug_codeset(spark, sf):
    return star.codeset(spark, sf)


@query("crosswalk_codes", star.sql("SELECT therapy, p_partkey, p_name, ndc FROM crosswalk", star.CODESET_SQL))
def q_crosswalk_codes(spark, sf):
    return star.crosswalk(spark, sf)


@query("crosswalk_codes_repeated", star.sql("""
SELECT therapy, p_partkey, p_name, ndc FROM crosswalk
UNION ALL SELECT therapy, p_partkey, p_name, ndc FROM crosswalk
UNION ALL SELECT therapy, p_partkey, p_name, ndc FROM crosswalk""", star.CODESET_SQL))
def q_crosswalk_codes_repeated(spark, sf):
    return star.crosswalk(spark, sf, copies=3)


@query("lab_codeset", """
SELECT DISTINCT 'hemoglobin' AS lab_name, p_name, p_type FROM part WHERE lower(p_name) LIKE '%red%'
UNION SELECT DISTINCT 'platelet_count', p_name, p_type FROM part WHERE lower(p_name) LIKE '%l%g%r%'
UNION SELECT DISTINCT 'leukocyte', p_name, p_type FROM part WHERE lower(p_name) LIKE '%old%'
UNION SELECT DISTINCT 'albumin', p_name, p_type FROM part WHERE lower(p_name) LIKE '%gear%'""")
def q_lab_codeset(spark, sf):
    return build_lab_codeset(table(spark, sf, "part"), LAB_PATTERNS, "p_name", ["p_name", "p_type"])


@query("codeset_counts", star.sql("""
SELECT therapy, CAST(count(DISTINCT p_name) AS BIGINT) AS med_cnt FROM codeset GROUP BY 1""", star.CODESET_SQL))
def q_codeset_counts(spark, sf):
    return codeset_counts(star.codeset(spark, sf), "therapy", "p_name", "med_cnt")


@query("crosswalk_counts", star.sql("""
SELECT therapy, CAST(count(DISTINCT ndc) AS BIGINT) AS ndc_cnt FROM crosswalk GROUP BY 1""", star.CODESET_SQL))
def q_crosswalk_counts(spark, sf):
    return codeset_counts(star.crosswalk(spark, sf), "therapy", "ndc", "ndc_cnt")


#: Dictionary texts of several fields, patterns and rules read off the dictionary itself, so that they grow with it.
LONG_NAME = "lower(concat_ws(' ', p_name, p_brand, p_type, p_size))"
PATTERN_SQL = f"""
WITH dictionary AS (SELECT *, {LONG_NAME} AS long_name FROM part),
patterns AS (
  SELECT lower('%' || split_part(p_name, ' ', 1) || '%' || p_brand || ' %' || p_size) AS pattern FROM part
  UNION SELECT lower('%' || substr(p_name, 2, 5) || '%' || p_type || ' _') FROM part
  UNION SELECT lower('%' || p_size || '%') FROM part)"""


def _patterns(part):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    any_ = F.lit("%")
    forms = [F.concat(any_, first, any_, F.col("p_brand"), F.lit(" %"), F.col("p_size")),
             F.concat(any_, F.substring("p_name", 2, 5), any_, F.col("p_type"), F.lit(" _")),
             F.concat(any_, F.col("p_size"), any_)]
    return part.select(F.explode(F.array(*[F.lower(f) for f in forms])).alias("pattern")).distinct()


@query("pattern_index", PATTERN_SQL + """
SELECT pattern, CAST(count(*) AS BIGINT) AS n_parts, min(p_partkey) AS first_part, max(p_partkey) AS last_part
FROM dictionary JOIN patterns ON long_name LIKE pattern GROUP BY pattern""")
def q_pattern_index(spark, sf):
    part = table(spark, sf, "part")
    dictionary = part.select("p_partkey", F.expr(LONG_NAME).alias("long_name"))
    return match_patterns(dictionary, "long_name", _patterns(part), "pattern").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n_parts"), F.min("p_partkey").alias("first_part"), F.max("p_partkey").alias("last_part"))


@query("rule_codeset", f"""
WITH dictionary AS (SELECT *, {LONG_NAME} AS long_name FROM part),
rules AS (
  SELECT p_brand || '/' || p_type AS therapy, lower('%' || p_brand || ' ' || p_type || ' %') AS pattern, false AS exclude FROM part
  UNION SELECT p_brand || '/' || p_type, lower(split_part(max(p_name), ' ', 1) || '%'), true FROM part GROUP BY 1),
hits AS (
  SELECT DISTINCT long_name, p_partkey, therapy, exclude FROM dictionary JOIN rules ON long_name LIKE pattern)
SELECT p_partkey, long_name, therapy FROM hits GROUP BY ALL HAVING NOT bool_or(exclude)""")
def q_rule_codeset(spark, sf):
    part = table(spark, sf, "part")
    therapy = F.concat_ws("/", "p_brand", "p_type").alias("therapy")
    include = part.select(therapy, F.lower(F.concat(F.lit("%"), "p_brand", F.lit(" "), "p_type", F.lit(" %"))).alias("pattern"), F.lit(False).alias("exclude"))
    last = F.split_part(F.max("p_name"), F.lit(" "), F.lit(1))
    exclude = part.groupBy(therapy).agg(F.concat(F.lower(last), F.lit("%")).alias("pattern")).withColumn("exclude", F.lit(True))
    dictionary = part.select("p_partkey", F.expr(LONG_NAME).alias("long_name"))
    return build_codeset_from_rules(dictionary, include.distinct().unionByName(exclude), "long_name", ["p_partkey", "long_name"])
