"""Index events, exclusion and attrition of the order cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog import query, star
from cohortloom.catalog.star import table
from cohortloom.functions.skew import lookup_join
from cohortloom.operators.cohort import attrition, dedup_person, exclusion_counts


@query("index_event", star.sql_cohort(
    "SELECT person_id, site, birth_date, sex, race, enc_type, index_date, age, age_days FROM included"))
def q_index_event(spark, sf):
    return star.included(spark, sf).select(
        "person_id", "site", "birth_date", "sex", "race", "enc_type", "index_date", "age", "age_days")


@query("person_join", star.sql("""
SELECT d.event_id, d.person_id, p.site, p.sex, p.race, p.birth_date
FROM dx d JOIN persons p ON d.person_id = p.person_id""", star.COHORT_SQL))
def q_person_join(spark, sf):
    dx = star.diagnoses(spark, sf).select("event_id", "person_id")
    people = star.persons(spark, sf).select("person_id", "site", "sex", "race", "birth_date")
    return lookup_join(dx, people, ["person_id"], selective=False)


@query("exclusion_set", star.sql_cohort("SELECT person_id FROM excluded"))
def q_exclusion_set(spark, sf):
    return star.excluded(spark, sf)


@query("apply_exclusion", star.sql_cohort("SELECT person_id, site, index_date, age FROM cohort"))
def q_apply_exclusion(spark, sf):
    return star.cohort(spark, sf).select("person_id", "site", "index_date", "age")


ATTRITION_SQL = star.sql_cohort("""
SELECT 'initial' AS criterion, CAST(count(DISTINCT i.person_id) AS INTEGER) AS pat_cnt, s.site
FROM (SELECT DISTINCT site FROM persons) s LEFT JOIN included i ON i.site = s.site GROUP BY s.site
UNION ALL
SELECT 'exclude-age', CAST(count(DISTINCT CASE WHEN i.age > 18 THEN i.person_id END) AS INTEGER), s.site
FROM (SELECT DISTINCT site FROM persons) s LEFT JOIN included i ON i.site = s.site GROUP BY s.site
UNION ALL
SELECT 'exclude-dx', CAST(count(DISTINCT e.person_id) AS INTEGER), p.site
FROM persons p LEFT JOIN excluded e ON e.person_id = p.person_id GROUP BY p.site
UNION ALL
SELECT 'eligible', CAST(count(DISTINCT c.person_id) AS INTEGER), s.site
FROM (SELECT DISTINCT site FROM persons) s LEFT JOIN cohort c ON c.site = s.site GROUP BY s.site""")


@query("attrition", ATTRITION_SQL)
def q_attrition(spark, sf):
    people = star.persons(spark, sf).select("person_id", "site")
    excluded = star.excluded(spark, sf).join(people, "person_id")
    return attrition(star.included(spark, sf), excluded, "person_id", "site", "age", sites=people)


@query("dedup_person", star.sql("""
SELECT person_id, code, admit_date FROM (
  SELECT person_id, code, admit_date,
         row_number() OVER (PARTITION BY person_id ORDER BY admit_date, code) AS rn
  FROM (SELECT DISTINCT person_id, code, admit_date FROM dx)) WHERE rn = 1""", star.COHORT_SQL))
def q_dedup_person(spark, sf):
    dx = star.diagnoses(spark, sf).select("person_id", "code", "admit_date")
    return dedup_person(dx, ["person_id"], "admit_date")


@query("exclusion_counts", star.sql_timeline("""
SELECT CAST(sum(CASE WHEN trt1 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_treatment,
       CAST(sum(CASE WHEN trt1 IN ('step_1', 'step_2', 'surgery') THEN 1 ELSE 0 END) AS BIGINT)
         AS other_first_treatment
FROM timeline"""))
def q_exclusion_counts(spark, sf):
    return exclusion_counts(star.timeline(spark, sf), "trt1", ["step_1", "step_2", "surgery"])


@query("site_order_counts", """
SELECT c.c_mktsegment AS site, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o.o_custkey) AS BIGINT) AS persons
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1""")
def q_site_order_counts(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("site"))
    return o.join(c, "c_custkey").groupBy("site").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("persons"))
