"""First events, censoring and timelines of the order cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog import query, star
from cohortloom.operators.endpoints import EventRule, first_events
from cohortloom.operators.timelines import (
    after_first_flags,
    any_treatment_time,
    first_nonnegative_event,
    status_time,
    treatment_sequence,
)
from cohortloom.session import materialize

KEYS = star.KEYS


def _who(spark, sf):
    return materialize(star.cohort(spark, sf, True).select(*KEYS, "index_date"))


def _cohort_lines(spark, sf):
    """The cohort and its order lines: orders of others are gone before the lines are joined."""
    who = _who(spark, sf)
    return who, star.lines(spark, sf, who)


@query("first_procedure", star.sql_stack("SELECT person_id, index_date, first_date FROM ep_surgery"))
def q_first_procedure(spark, sf):
    who, rows = _cohort_lines(spark, sf)
    return star.surgery(spark, sf, who, rows=rows)


@query("first_prescription", star.sql_stack("SELECT person_id, index_date, therapy, first_date FROM ep_rx"))
def q_first_prescription(spark, sf):
    who, rows = _cohort_lines(spark, sf)
    return star.first_prescriptions(spark, sf, who, rows=rows)


MED_SQL = """
ep_disp AS (
  SELECT a.person_id, a.index_date, c.therapy, min(d.dispense_date) AS first_date
  FROM cohort a JOIN dispensing d ON a.person_id = d.person_id JOIN crosswalk c ON d.ndc = c.ndc
  WHERE d.dispense_date >= a.index_date - 30 GROUP BY 1, 2, 3),
ep_admin_rx AS (
  SELECT a.person_id, a.index_date, c.therapy, min(m.start_date) AS first_date
  FROM cohort a JOIN med_admin m ON a.person_id = m.person_id
  JOIN codeset c ON m.code = CAST(c.p_partkey AS VARCHAR) AND m.kind = 'RX'
  WHERE m.start_date >= a.index_date - 30 GROUP BY 1, 2, 3),
ep_admin_nd AS (
  SELECT a.person_id, a.index_date, c.therapy, min(m.start_date) AS first_date
  FROM cohort a JOIN med_admin m ON a.person_id = m.person_id
  JOIN crosswalk c ON m.code = c.ndc AND m.kind = 'ND'
  WHERE m.start_date >= a.index_date - 30 GROUP BY 1, 2, 3)
"""


def _drug_rules(codes, ndc):
    """The four sources of drugs among the order lines: prescribed, dispensed, given by either code system."""
    part, flag, status, ship = (F.col(c) for c in ("l_partkey", "l_returnflag", "l_linestatus", "ship"))
    number, package = part.cast("string"), F.concat(F.lit("N"), part.cast("string"))
    started = F.when(F.col("l_linenumber") % 5 != 0, ship)
    return {r.source: r for r in (
        EventRule("prescribed", number, started, codes, "p_partkey", flag == "R", 30),
        EventRule("dispensed", package, ship, ndc, "ndc", flag == "A", 30),
        EventRule("given_rx", number, ship, codes, "p_partkey", (flag == "N") & (status == "O"), 30),
        EventRule("given_nd", package, ship, ndc, "ndc", (flag == "N") & (status != "O"), 30))}


def _first_drugs(spark, sf, *sources):
    """First drugs of the cohort by the named sources, in one scan of its lines."""
    who, rows = _cohort_lines(spark, sf)
    # both code sets serve two sources each, so they are persisted like the cohort
    codes = materialize(star.codeset(spark, sf))
    rules = _drug_rules(codes, materialize(star.crosswalk(spark, sf, codes=codes)))
    return first_events(who, rows, [rules[s] for s in sources or rules], KEYS, "index_date", "therapy").drop("source")


@query("first_dispensing", star.sql_stack("SELECT * FROM ep_disp", MED_SQL))
def q_first_dispensing(spark, sf):
    return _first_drugs(spark, sf, "dispensed")


@query("first_administration_rx", star.sql_stack("SELECT * FROM ep_admin_rx", MED_SQL))
def q_first_administration_rx(spark, sf):
    return _first_drugs(spark, sf, "given_rx")


@query("first_administration_nd", star.sql_stack("SELECT * FROM ep_admin_nd", MED_SQL))
def q_first_administration_nd(spark, sf):
    return _first_drugs(spark, sf, "given_nd")


@query("union_sources", star.sql_stack("""
SELECT * FROM ep_rx UNION SELECT * FROM ep_disp UNION SELECT * FROM ep_admin_rx UNION SELECT * FROM ep_admin_nd
""", MED_SQL))
def q_union_sources(spark, sf):
    return _first_drugs(spark, sf).distinct()


@query("censor_date", star.sql_stack("SELECT person_id, index_date, censor_date FROM ep_censor"))
def q_censor_date(spark, sf):
    return star.censoring(spark, sf, _who(spark, sf))


@query("endpoint_stack", star.sql_stack("SELECT * FROM stack"))
def q_endpoint_stack(spark, sf):
    return star.stack(spark, sf)


@query("first_nonnegative_event", star.sql_stack("""
SELECT person_id, endpoint, CAST(min(days) AS INTEGER) AS days FROM stack WHERE days >= 0 GROUP BY 1, 2"""))
def q_first_nonnegative_event(spark, sf):
    return first_nonnegative_event(star.stack(spark, sf), KEYS)


@query("pivot_endpoints", star.sql_timeline(
    "SELECT person_id, base_a, base_b, step_1, step_2, surgery, censor FROM wide"))
def q_pivot_endpoints(spark, sf):
    return star.wide(spark, sf).drop("standard")


@query("composite_endpoint", star.sql_timeline("SELECT person_id, base_a, base_b, standard FROM wide"))
def q_composite_endpoint(spark, sf):
    return star.wide(spark, sf).select("person_id", "base_a", "base_b", "standard")


@query("treatment_sequence", star.sql_timeline("SELECT person_id, trt1, trt2, trt3, trt4 FROM seq"))
def q_treatment_sequence(spark, sf):
    return treatment_sequence(star.wide(spark, sf), KEYS, star.TREATMENTS)


@query("treatment_sequence_order_mode", star.sql_timeline("""
SELECT p.person_id,
       max(CASE WHEN s.idx = 1 THEN p.name END) AS trt1, max(CASE WHEN s.idx = 2 THEN p.name END) AS trt2,
       max(CASE WHEN s.idx = 3 THEN p.name END) AS trt3, max(CASE WHEN s.idx = 4 THEN p.name END) AS trt4
FROM given p JOIN (
  SELECT person_id, idx, row_number() OVER (PARTITION BY person_id ORDER BY val, idx) AS i FROM given) s
  ON p.person_id = s.person_id AND p.idx = s.i
GROUP BY 1""", """
given AS (
  SELECT person_id, name, val, row_number() OVER (PARTITION BY person_id ORDER BY pos) AS idx
  FROM (SELECT person_id, 'standard' AS name, 1 AS pos, standard AS val FROM wide
        UNION ALL SELECT person_id, 'step_1', 2, step_1 FROM wide
        UNION ALL SELECT person_id, 'step_2', 3, step_2 FROM wide
        UNION ALL SELECT person_id, 'surgery', 4, surgery FROM wide)
  WHERE val IS NOT NULL)"""))
def q_treatment_sequence_order_mode(spark, sf):
    return treatment_sequence(star.wide(spark, sf), KEYS, star.TREATMENTS, mode="order")


@query("after_first_flags", star.sql_timeline("""
SELECT person_id,
       CAST(coalesce(trt2 = 'surgery' OR trt3 = 'surgery' OR trt4 = 'surgery', FALSE) AS INTEGER) AS surgery_after,
       CAST(coalesce(trt2 = 'step_1' OR trt3 = 'step_1' OR trt4 = 'step_1', FALSE) AS INTEGER) AS step_1_after
FROM seq"""))
def q_after_first_flags(spark, sf):
    seq = treatment_sequence(star.wide(spark, sf), KEYS, star.TREATMENTS)
    return after_first_flags(seq, {"surgery_after": "surgery", "step_1_after": "step_1"}).select(
        "person_id", "surgery_after", "step_1_after")


STATUS_COLUMNS = ["person_id"] + [f"{k}_{e}" for e in star.ENDPOINTS[:-1] for k in ("status", "time")]


@query("status_time", star.sql_timeline(f"SELECT {', '.join(STATUS_COLUMNS)} FROM st"))
def q_status_time(spark, sf):
    return status_time(star.wide(spark, sf), star.ENDPOINTS[:-1]).select(*STATUS_COLUMNS)


def _gap(first, start, end):
    gap = f"(time_{end} * status_{end} - {start})"
    return f"CASE WHEN trt1 = '{first}' AND {gap} > 0 THEN {gap} END"


STD_START = "least(time_base_a * status_base_a, time_base_b * status_base_b)"


@query("transition_times", star.sql_timeline(f"""
SELECT person_id, {_gap('standard', STD_START, 'step_2')} AS time_std2s2,
       {_gap('standard', STD_START, 'step_1')} AS time_std2s1,
       {_gap('standard', STD_START, 'surgery')} AS time_std2sur,
       {_gap('step_2', 'time_step_2 * status_step_2', 'step_1')} AS time_s2_s1,
       {_gap('step_2', 'time_step_2 * status_step_2', 'surgery')} AS time_s2_sur,
       {_gap('step_1', 'time_step_1 * status_step_1', 'step_2')} AS time_s1_s2,
       {_gap('step_1', 'time_step_1 * status_step_1', 'surgery')} AS time_s1_sur
FROM st"""))
def q_transition_times(spark, sf):
    return star.timeline(spark, sf).select("person_id", *[t.name for t in star.TRANSITIONS])


@query("index_to_first", star.sql_timeline("SELECT person_id, trt1, time_idx2std FROM timeline"))
def q_index_to_first(spark, sf):
    return star.timeline(spark, sf).select("person_id", "trt1", "time_idx2std")


@query("escalation_outcome", star.sql_timeline(
    "SELECT person_id, status6, status6_col, status_bio_imm, time6 FROM timeline"))
def q_escalation_outcome(spark, sf):
    return star.timeline(spark, sf).select("person_id", "status6", "status6_col", "status_bio_imm", "time6")


@query("any_treatment_time", star.sql_timeline("""
SELECT person_id, CAST(least(time_base_a, time_base_b, time_step_1, time_step_2, time_surgery)
       * CAST(trt1 IS NOT NULL AS INTEGER) AS INTEGER) AS trt1_time FROM timeline"""))
def q_any_treatment_time(spark, sf):
    return any_treatment_time(star.timeline(spark, sf), star.ENDPOINTS[:-1]).select("person_id", "trt1_time")
