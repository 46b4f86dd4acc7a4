"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog import query, star
from cohortloom.catalog.star import table
from cohortloom.functions import predicates as P
from cohortloom.functions import values as V
from cohortloom.functions.skew import lookup_join
from cohortloom.operators.design import dummy_code


@query("code_prefix_filter", """
SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '5-L%'""")
def q_code_prefix_filter(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter(P.starts_with_any(F.col("o_orderpriority"), ["1-", "5-L"])).select(
        "o_orderkey", "o_orderpriority")


@query("code_in_list", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE CAST(l_partkey AS VARCHAR) IN ('7', '17', '544', '1033') OR CAST(l_partkey AS VARCHAR) LIKE '12%'
   OR CAST(l_partkey AS VARCHAR) LIKE '45%'""")
def q_code_in_list(spark, sf):
    li = table(spark, sf, "lineitem")
    code = F.col("l_partkey").cast("string")
    return li.filter(P.code_matches(code, star.PX_EXACT, star.PX_PREFIXES)).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("text_contains_any", """
SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%old%'""")
def q_text_contains_any(spark, sf):
    return table(spark, sf, "part").filter(
        P.text_contains_any(F.col("p_name"), ["ring", "old"])).select("p_partkey", "p_name")


@query("text_excludes_any", """
SELECT p_partkey, p_name FROM part
WHERE lower(p_name) NOT LIKE '%ring%' AND lower(p_name) NOT LIKE '%old%' AND lower(p_name) NOT LIKE '%rod%'""")
def q_text_excludes_any(spark, sf):
    return table(spark, sf, "part").filter(
        P.text_excludes_any(F.col("p_name"), ["ring", "old", "rod"])).select("p_partkey", "p_name")


@query("text_contains_any_documents", """
SELECT doc_id, lang FROM documents
WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%copyright%' OR lower(text) LIKE '%warranty%'""")
def q_text_contains_any_documents(spark, sf):
    return table(spark, sf, "documents").filter(
        P.text_contains_any(F.col("text"), ["license", "copyright", "warranty"])).select("doc_id", "lang")


@query("type_prefix_suffix", """
SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%' OR p_type LIKE '%OMY'""")
def q_type_prefix_suffix(spark, sf):
    return table(spark, sf, "part").filter(
        P.type_matches(F.col("p_type"), ["S"], ["OMY"])).select("p_partkey", "p_type")


@query("multi_wildcard_like", """
SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%l%d%g%'
UNION ALL SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%the%end%of%'""")
def q_multi_wildcard_like(spark, sf):
    part = table(spark, sf, "part").filter(P.text_like(F.col("p_name"), "%l%d%g%"))
    docs = table(spark, sf, "documents").filter(P.text_like(F.col("text"), "%the%end%of%"))
    return part.select("p_partkey", "p_name").union(docs.select("doc_id", "lang"))


def _guarded(spark, sf, mode):
    joined = lookup_join(star.diagnoses(spark, sf), star.persons(spark, sf), ["person_id"], selective=False)
    guard = F.col("dx_date") >= F.date_add(F.col("birth_date"), 7300)
    return joined.filter(P.guarded_inclusion(F.col("code"), ["1-"], ["2-"], guard, mode)).select(
        "event_id", "code", "dx_date")


@query("guarded_inclusion_as_written", star.sql("""
SELECT d.event_id, d.code, d.dx_date FROM dx d JOIN persons p ON d.person_id = p.person_id
WHERE d.code LIKE '1-%' OR d.code LIKE '2-%' AND d.dx_date >= p.birth_date + 7300""", star.COHORT_SQL))
def q_guarded_as_written(spark, sf):
    return _guarded(spark, sf, "as_written")


@query("guarded_inclusion_all", star.sql("""
SELECT d.event_id, d.code, d.dx_date FROM dx d JOIN persons p ON d.person_id = p.person_id
WHERE (d.code LIKE '1-%' OR d.code LIKE '2-%') AND d.dx_date >= p.birth_date + 7300""", star.COHORT_SQL))
def q_guarded_all(spark, sf):
    return _guarded(spark, sf, "all")


@query("event_date_coalesce", star.sql(
    "SELECT event_id, coalesce(dx_date, admit_date) AS event_date FROM dx", star.COHORT_SQL))
def q_event_date_coalesce(spark, sf):
    return star.diagnoses(spark, sf).select(
        "event_id", V.event_date(F.col("dx_date"), F.col("admit_date")).alias("event_date"))


@query("lookback_filter", """
SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_shipdate AS DATE) AS ship
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE CAST(l.l_shipdate AS DATE) >= CAST(o.o_orderdate AS DATE) - 30""")
def q_lookback_filter(spark, sf):
    return (star.lines(spark, sf).filter(P.on_or_after(F.col("ship"), F.col("ordered"), 30))
            .select("l_orderkey", "l_linenumber", "ship"))


@query("recode_levels", """
SELECT c_custkey, CASE WHEN v IN ('5') THEN 'white' WHEN v IN ('3') THEN 'black'
       WHEN v IN ('7', '8') OR v IS NULL THEN 'unk' ELSE 'ot' END AS race
FROM (SELECT c_custkey, CAST(nullif(c_nationkey, 4) AS VARCHAR) AS v FROM customer)""")
def q_recode_levels(spark, sf):
    v = F.nullif(F.col("c_nationkey"), F.lit(4)).cast("string")
    return table(spark, sf, "customer").select(
        "c_custkey", V.recode(v, {"white": ["5"], "black": ["3"]}, "unk", "ot", ["7", "8"]).alias("race"))


@query("age_at_index", star.sql("""
SELECT d.event_id, CAST(round(date_diff('day', p.birth_date, d.admit_date) / 365.25) AS INTEGER) AS age,
       CAST(date_diff('day', p.birth_date, d.admit_date) AS INTEGER) AS age_days
FROM dx d JOIN persons p ON d.person_id = p.person_id""", star.COHORT_SQL))
def q_age_at_index(spark, sf):
    people = star.persons(spark, sf).select("person_id", "birth_date")
    j = lookup_join(star.diagnoses(spark, sf), people, ["person_id"], selective=False)
    birth, at = F.col("birth_date"), F.col("admit_date")
    return j.select("event_id", V.age_years(birth, at).alias("age"), V.days_between(birth, at).alias("age_days"))


@query("not_null_filter", star.sql(
    "SELECT event_id, dx_date FROM dx WHERE dx_date IS NOT NULL", star.COHORT_SQL))
def q_not_null_filter(spark, sf):
    return star.diagnoses(spark, sf).filter(F.col("dx_date").isNotNull()).select("event_id", "dx_date")


@query("year_age_window", star.sql_cohort("""
SELECT person_id, age, CAST(year(index_date) AS INTEGER) AS index_year FROM included
WHERE year(index_date) BETWEEN 1995 AND 1996 AND age <= 17 AND age >= 10"""))
def q_year_age_window(spark, sf):
    inc = star.included(spark, sf)
    kept = inc.filter(P.year_between(F.col("index_date"), 1995, 1996) & F.col("age").between(10, 17))
    return kept.select("person_id", "age", F.year("index_date").alias("index_year"))


@query("group_membership", star.sql_timeline("""
SELECT person_id, trt1, time6 FROM timeline WHERE trt1 IN ('standard', 'step_1', 'step_2') AND time6 >= 0"""))
def q_group_membership(spark, sf):
    t = star.timeline(spark, sf)
    return t.filter(F.col("trt1").isin("standard", "step_1", "step_2") & (F.col("time6") >= 0)).select(
        "person_id", "trt1", "time6")


@query("null_safe_membership", star.sql("""
SELECT event_id, CAST(NOT coalesce(dx_date IN (DATE '1995-02-01', DATE '1996-03-01'), FALSE) AS INTEGER) AS other
FROM dx""", star.COHORT_SQL))
def q_null_safe_membership(spark, sf):
    days = [F.lit("1995-02-01").cast("date"), F.lit("1996-03-01").cast("date")]
    return star.diagnoses(spark, sf).select(
        "event_id", (~P.is_member(F.col("dx_date"), days)).cast("int").alias("other"))


@query("select_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_select_columns(spark, sf):
    wanted = ["o_orderkey", "o_custkey", "o_totalprice"]
    return table(spark, sf, "orders").drop("o_orderstatus").select(*wanted)


@query("threshold_flag", "SELECT c_custkey, CAST(c_acctbal >= 1000 AS INTEGER) AS rich FROM customer")
def q_threshold_flag(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", V.threshold_flag(F.col("c_acctbal"), 1000).alias("rich"))


@query("relevel", """
SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS DOUBLE) AS segAUTOMOBILE,
       CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS segBUILDING,
       CAST(c_mktsegment = 'FURNITURE' AS DOUBLE) AS segFURNITURE,
       CAST(c_mktsegment = 'HOUSEHOLD' AS DOUBLE) AS segHOUSEHOLD FROM customer""")
def q_relevel(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "seg")
    coded, terms = dummy_code(c, {"seg": "MACHINERY"})
    return coded.select("c_custkey", *terms["seg"])


@query("round_half_even", """
SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half FROM lineitem""")
def q_round_half_even(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", V.round_half_even(F.col("l_quantity") / 2).alias("half"))


@query("least_strict", star.sql("""
SELECT event_id, CASE WHEN dx_date IS NOT NULL THEN least(dx_date, admit_date + 1) END AS strict,
       least(dx_date, admit_date + 1) AS lenient FROM dx""", star.COHORT_SQL))
def q_least_strict(spark, sf):
    a, b = F.col("dx_date"), F.date_add("admit_date", 1)
    return star.diagnoses(spark, sf).select(
        "event_id", V.least_strict(a, b).alias("strict"), F.least(a, b).alias("lenient"))
