"""Baseline covariates of the event-log cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog import query, star
from cohortloom.catalog.endpoints import STD_START, _gap
from cohortloom.catalog.star import (CODESET_SQL, COHORT_SQL, EVENTS_SQL, KEYS, LOG_SQL, STACK_SQL, TIMELINE_SQL, log, sql, table,
                                     visitors)
from cohortloom.functions.skew import attach_index
from cohortloom.functions.values import event_date, lms_zscore, round_to_int
from cohortloom.operators import covariates as C
from cohortloom.session import materialize

WIDE = {"HT": ("ht", "in"), "WT": ("wt", "lb"), "BMI": ("bmi", "kg/m2")}
LONG_CODES = {"H-1": "HT", "W-1": "WT", "B-1": "BMI"}
UNITS = [C.UnitRule("HT", 39.37, unit_contains="in", above=20),
         C.UnitRule("WT", 2.20462, unit_contains="lb")]
RANGES = [C.PlausibleRule("HT", below=3), C.PlausibleRule("WT", below=200), C.PlausibleRule("BMI", below=60)]
LABS = ["hemoglobin", "platelet_count", "leukocyte", "CRP", "neutrophil"]
LAB_CODES = {"click": "hemoglobin", "view": "platelet_count", "purchase": "leukocyte", "error": "CRP",
             "signup": "neutrophil"}
LAB_RULES = [
    C.PlausibleRule("leukocyte", at_most=100, not_units=("%",)),
    C.PlausibleRule("neutrophil", at_most=90, units=("%",)),
    C.PlausibleRule("hemoglobin", units=("g/dL", "OT")),
    C.PlausibleRule("platelet_count", units=("10*3/uL", "OT")),
]
LAB_UNITS = [C.UnitRule("CRP", 10, unit_equals="mg/L")]
LAB_DATES = {"order_date": "order_days", "specimen_date": "specimen_days", "result_date": "result_days"}
OFFSETS = ["specimen_days", "result_days", "order_days"]
DX_RULES = {"abdominal_pain": ["error1", "error2", "click9"], "diarrhea": ["view7"],
            "rectal_bleeding": ["click3", "view71", "click91"]}


def _who(spark, sf):
    return materialize(visitors(spark, sf))


def _vital_wide(spark, sf):
    k = F.col("k")
    return log(spark, sf).filter("event_type in ('view', 'error')").select(
        "person_id", "day", F.when(k % 4 != 0, 30 + k * 0.5).alias("ht"),
        F.when(k % 3 != 0, 40 + k * 2.0).alias("wt"), F.when(k % 5 == 0, 12 + k * 0.6).alias("bmi"))


def _vital_long(spark, sf):
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("k") % len(xs) + 1)
    return log(spark, sf).filter("event_type in ('click', 'purchase')").select(
        "person_id", "day", pick("H-1", "W-1", "B-1", "X-1").alias("code"),
        F.round(F.col("value"), 1).alias("result"), pick("in", "cm", "lb", "kg", None).alias("unit"))


def _vitals(spark, sf, who):
    return C.vitals_stack(who, _vital_wide(spark, sf), _vital_long(spark, sf), KEYS, "index_date", WIDE, "day",
                          LONG_CODES, "code", "result", "unit", "day")


VITALS_SQL = """
vital_rows AS (
  SELECT person_id, 'HT' AS vital_type, CAST(30 + k * 0.5 AS DOUBLE) AS vital_val, 'in' AS vital_unit,
         day AS measure_date FROM log WHERE event_type IN ('view', 'error') AND k % 4 <> 0
  UNION SELECT person_id, 'WT', CAST(40 + k * 2.0 AS DOUBLE), 'lb', day FROM log
  WHERE event_type IN ('view', 'error') AND k % 3 <> 0
  UNION SELECT person_id, 'BMI', CAST(12 + k * 0.6 AS DOUBLE), 'kg/m2', day FROM log
  WHERE event_type IN ('view', 'error') AND k % 5 = 0
  UNION SELECT person_id, ['HT', 'WT', 'BMI'][k % 4 + 1], round(value, 1),
               ['in', 'cm', 'lb', 'kg', NULL][k % 5 + 1], day
  FROM log WHERE event_type IN ('click', 'purchase') AND k % 4 < 3),
vitals AS (
  SELECT v.person_id, v.vital_type, v.vital_val, v.vital_unit, v.measure_date,
         CAST(date_diff('day', w.index_date, v.measure_date) AS INTEGER) AS days
  FROM vital_rows v JOIN visitors w ON v.person_id = w.person_id),
converted AS (
  SELECT person_id, vital_type, vital_unit, measure_date, days,
         CASE WHEN vital_type = 'HT' AND vital_unit LIKE '%in%' AND vital_val > 20
              THEN vital_val / CAST(39.37 AS DOUBLE)
              WHEN vital_type = 'WT' AND vital_unit LIKE '%lb%' THEN vital_val / CAST(2.20462 AS DOUBLE)
              ELSE vital_val END AS vital_val FROM vitals),
plausible AS (
  SELECT * FROM converted WHERE (vital_type = 'HT' AND vital_val < 3)
     OR (vital_type = 'WT' AND vital_val < 200) OR (vital_type = 'BMI' AND vital_val < 60)),
nearest AS (
  SELECT person_id, vital_type, vital_val, measure_date, days FROM (
    SELECT *, row_number() OVER (PARTITION BY person_id, vital_type
                                 ORDER BY abs(days), measure_date, vital_val, vital_unit) AS rn
    FROM plausible) WHERE rn = 1),
same_day AS (
  SELECT person_id, days, max(CASE WHEN vital_type = 'HT' THEN vital_val END) AS HT,
         max(CASE WHEN vital_type = 'WT' THEN vital_val END) AS WT,
         max(CASE WHEN vital_type = 'BMI' THEN vital_val END) AS BMI
  FROM nearest WHERE days <= 30 GROUP BY 1, 2),
body AS (
  SELECT person_id, days, HT, WT, coalesce(BMI, round_even(WT / (HT * HT), 0)) AS BMI
  FROM same_day WHERE HT IS NOT NULL AND WT IS NOT NULL),
bmi AS (SELECT * FROM body WHERE WT > 0 AND BMI > 0 AND BMI < 60)
"""


def _cleaned(spark, sf, who):
    converted = C.convert_units(_vitals(spark, sf, who), UNITS, "vital_type", "vital_val", "vital_unit")
    return C.plausible_range(converted, RANGES, "vital_type", "vital_val")


def _nearest(spark, sf, who):
    return C.nearest_to_index(_cleaned(spark, sf, who), [*KEYS, "vital_type"], F.col("days"),
                              ["measure_date", "vital_val", "vital_unit"])


def _same_day(spark, sf, who):
    near = _nearest(spark, sf, who).filter("days <= 30")
    return C.same_day_pivot(near, KEYS, "days", "vital_type", "vital_val", ["HT", "WT", "BMI"])


def _body(spark, sf, who):
    return C.derived_bmi(_same_day(spark, sf, who).dropna(subset=["HT", "WT"]))


@query("vitals_stack", sql("SELECT * FROM vitals", LOG_SQL, VITALS_SQL))
def q_vitals_stack(spark, sf):
    return _vitals(spark, sf, _who(spark, sf))


@query("vitals_as_integer", sql("""
SELECT person_id, vital_type, measure_date, CAST(round(vital_val) AS INTEGER) AS vital_val FROM vitals
""", LOG_SQL, VITALS_SQL))
def q_vitals_as_integer(spark, sf):
    return _vitals(spark, sf, _who(spark, sf)).select(
        "person_id", "vital_type", "measure_date", round_to_int(F.col("vital_val")).alias("vital_val"))


def _stay_log(spark, sf):
    k = F.col("k")
    return log(spark, sf).filter("event_type = 'purchase'").select(
        "person_id", star.stay_type(k).alias("enc_type"), F.col("day").alias("admit_date"),
        F.when(k % 11 != 0, F.date_add("day", k % 7)).alias("discharge_date"))


def _dx_log(spark, sf):
    return log(spark, sf).select(
        "person_id", F.concat("event_type", F.col("k").cast("string")).alias("dx"),
        F.when(F.col("event_id") % 3 != 0, F.col("day")).alias("dx_date"),
        F.date_sub("day", 1).alias("admit_date"))


MORE_SQL = """
stays AS (
  SELECT s.person_id, s.enc_type, s.admit_date, s.discharge_date,
         CAST(date_diff('day', w.index_date, s.admit_date) AS INTEGER) AS admit_days,
         CAST(date_diff('day', s.admit_date, s.discharge_date) AS INTEGER) AS los
  FROM (SELECT person_id, ['IP', 'EI', 'IS', 'AV', 'ED'][k % 5 + 1] AS enc_type, day AS admit_date,
               CASE WHEN k % 11 <> 0 THEN day + k % 7 END AS discharge_date
        FROM log WHERE event_type = 'purchase') s
  JOIN visitors w ON s.person_id = w.person_id WHERE s.enc_type IN ('IP', 'EI', 'IS')),
dx_log AS (
  SELECT person_id, event_type || CAST(k AS VARCHAR) AS dx,
         coalesce(CASE WHEN event_id % 3 <> 0 THEN day END, day - 1) AS dx_date FROM log),
dx_rows AS (
  SELECT DISTINCT d.person_id, g.dx_group, d.dx, d.dx_date,
         CAST(date_diff('day', w.index_date, d.dx_date) AS INTEGER) AS days
  FROM dx_log d JOIN visitors w ON d.person_id = w.person_id
  JOIN (VALUES ('abdominal_pain', 'error1'), ('abdominal_pain', 'error2'), ('abdominal_pain', 'click9'),
               ('diarrhea', 'view7'), ('rectal_bleeding', 'click3'), ('rectal_bleeding', 'view71'),
               ('rectal_bleeding', 'click91')) g(dx_group, prefix) ON starts_with(d.dx, g.prefix)),
lab_rows AS (
  SELECT l.person_id, c.lab_name, l.event_id, l.order_date, l.specimen_date, l.result_date, l.result_num,
         l.result_unit,
         CAST(date_diff('day', w.index_date, l.order_date) AS INTEGER) AS order_days,
         CAST(date_diff('day', w.index_date, l.specimen_date) AS INTEGER) AS specimen_days,
         CAST(date_diff('day', w.index_date, l.result_date) AS INTEGER) AS result_days
  FROM (SELECT person_id, event_id, event_type, day - 1 AS order_date,
               CASE WHEN event_id % 3 <> 0 THEN day END AS specimen_date,
               CASE WHEN event_id % 4 <> 0 THEN day + 1 END AS result_date,
               CASE WHEN k % 13 <> 0 THEN value END AS result_num,
               ['%', 'g/dL', 'mg/L', NULL, 'OT', '10*3/uL'][k % 6 + 1] AS result_unit FROM log) l
  JOIN visitors w ON l.person_id = w.person_id
  JOIN (VALUES ('click', 'hemoglobin'), ('view', 'platelet_count'), ('purchase', 'leukocyte'),
               ('error', 'CRP'), ('signup', 'neutrophil')) c(code, lab_name) ON l.event_type = c.code),
clean AS (
  SELECT * REPLACE (CASE WHEN lab_name = 'CRP' AND result_unit = 'mg/L' THEN result_num / 10
                         ELSE result_num END AS result_num)
  FROM lab_rows WHERE result_num IS NOT NULL
   AND (lab_name <> 'leukocyte' OR (result_unit <> '%' AND result_num <= 100))
   AND (lab_name <> 'neutrophil' OR (result_unit = '%' AND result_num <= 90))
   AND (lab_name <> 'hemoglobin' OR result_unit IN ('g/dL', 'OT'))
   AND (lab_name <> 'platelet_count' OR result_unit IN ('10*3/uL', 'OT'))),
lab_near AS (
  SELECT person_id, lab_name, result_num FROM (
    SELECT *, coalesce(specimen_days, result_days, order_days) AS off,
           row_number() OVER (PARTITION BY person_id, lab_name
             ORDER BY abs(coalesce(specimen_days, result_days, order_days)), specimen_days, result_days,
                      order_days, result_num) AS rn
    FROM clean) WHERE rn = 1 AND off <= 30),
labs AS (
  SELECT person_id, max(CASE WHEN lab_name = 'hemoglobin' THEN result_num END) AS hemoglobin,
         max(CASE WHEN lab_name = 'platelet_count' THEN result_num END) AS platelet_count,
         max(CASE WHEN lab_name = 'leukocyte' THEN result_num END) AS leukocyte,
         max(CASE WHEN lab_name = 'CRP' THEN result_num END) AS CRP,
         max(CASE WHEN lab_name = 'neutrophil' THEN result_num END) AS neutrophil
  FROM lab_near GROUP BY 1),
ip AS (
  SELECT w.person_id, w.enc_type, CAST(w.enc_type IN ('IP', 'EI') AS INTEGER) AS IP_IND1,
         CAST(count(s.admit_days) FILTER (s.admit_days <= 0 AND s.admit_days + s.los >= 0) > 0 AS INTEGER) AS IP_IND2,
         CAST(count(s.admit_days) FILTER (s.admit_days = 0) > 0 AS INTEGER) AS IP_IND3
  FROM visitors w LEFT JOIN stays s ON s.person_id = w.person_id AND s.enc_type IN ('IP', 'EI')
  GROUP BY 1, 2),
dxf AS (
  SELECT w.person_id,
         CAST(count(d.dx) FILTER (d.dx_group = 'abdominal_pain') > 0 AS INTEGER) AS abdominal_pain,
         CAST(count(d.dx) FILTER (d.dx_group = 'diarrhea') > 0 AS INTEGER) AS diarrhea,
         CAST(count(d.dx) FILTER (d.dx_group = 'rectal_bleeding') > 0 AS INTEGER) AS rectal_bleeding
  FROM visitors w LEFT JOIN dx_rows d ON d.person_id = w.person_id AND d.days <= 0 GROUP BY 1)
"""


def _all(select):
    return sql(select, LOG_SQL, VITALS_SQL, MORE_SQL)


def _dx(spark, sf, who):
    return C.dx_groups(who, _dx_log(spark, sf), DX_RULES, KEYS, "index_date", "dx",
                       event_date(F.col("dx_date"), F.col("admit_date")))


def _stays(spark, sf, who):
    return C.inpatient_encounters(who, _stay_log(spark, sf), KEYS, "index_date", "enc_type",
                                  ["IP", "EI", "IS"], "admit_date", "discharge_date")


def _lab_log(spark, sf):
    k, i = F.col("k"), F.col("event_id")
    units = F.array(*[F.lit(u) for u in ("%", "g/dL", "mg/L", None, "OT", "10*3/uL")])
    return log(spark, sf).select(
        "person_id", "event_id", F.col("event_type").alias("code"), F.date_sub("day", 1).alias("order_date"),
        F.when(i % 3 != 0, F.col("day")).alias("specimen_date"),
        F.when(i % 4 != 0, F.date_add("day", 1)).alias("result_date"),
        F.when(k % 13 != 0, F.col("value")).alias("result_num"),
        F.element_at(units, k % 6 + 1).alias("result_unit"))


def _labs(spark, sf, who):
    kinds = F.create_map(*[F.lit(x) for p in LAB_CODES.items() for x in p])
    codes = log(spark, sf).select(F.col("event_type").alias("loinc")).distinct().withColumn(
        "lab_name", kinds[F.col("loinc")])
    return C.lab_events(who, _lab_log(spark, sf), codes, KEYS, "index_date", "code", "loinc", "lab_name",
                        LAB_DATES, ["event_id", "result_num", "result_unit"])


def _clean_labs(spark, sf, who):
    return C.clean_labs(_labs(spark, sf, who), LAB_RULES, LAB_UNITS, "lab_name", "result_num", "result_unit")


def _lab_wide(spark, sf, who):
    return C.lab_abstraction(_clean_labs(spark, sf, who), KEYS, "lab_name", "result_num", OFFSETS, LABS)


@query("dx_groups", _all("SELECT * FROM dx_rows"))
def q_dx_groups(spark, sf):
    return _dx(spark, sf, _who(spark, sf))


@query("lab_events", _all("SELECT * FROM lab_rows"))
def q_lab_events(spark, sf):
    return _labs(spark, sf, _who(spark, sf))


@query("inpatient_encounters", _all("SELECT * FROM stays"))
def q_inpatient_encounters(spark, sf):
    return _stays(spark, sf, _who(spark, sf))


@query("convert_units", sql("SELECT person_id, vital_type, measure_date, vital_unit, round(vital_val, 6) AS vital_val "
                            "FROM converted", LOG_SQL, VITALS_SQL))
def q_convert_units(spark, sf):
    out = C.convert_units(_vitals(spark, sf, _who(spark, sf)), UNITS, "vital_type", "vital_val", "vital_unit")
    return out.select("person_id", "vital_type", "measure_date", "vital_unit",
                      F.round("vital_val", 6).alias("vital_val"))


@query("plausible_range", sql("SELECT person_id, vital_type, round(vital_val, 6) AS vital_val FROM plausible",
                              LOG_SQL, VITALS_SQL))
def q_plausible_range(spark, sf):
    return _cleaned(spark, sf, _who(spark, sf)).select(
        "person_id", "vital_type", F.round("vital_val", 6).alias("vital_val"))


@query("nearest_to_index", sql("""
SELECT person_id, vital_type, measure_date, days, round(vital_val, 6) AS vital_val FROM nearest
""", LOG_SQL, VITALS_SQL))
def q_nearest_to_index(spark, sf):
    return _nearest(spark, sf, _who(spark, sf)).select(
        "person_id", "vital_type", "measure_date", "days", F.round("vital_val", 6).alias("vital_val"))


@query("window_after_nearest", sql("""
SELECT person_id, vital_type, days, round(vital_val, 6) AS vital_val FROM nearest WHERE days <= 3
""", LOG_SQL, VITALS_SQL))
def q_window_after_nearest(spark, sf):
    near = C.nearest_within(_cleaned(spark, sf, _who(spark, sf)), [*KEYS, "vital_type"], F.col("days"),
                            ["measure_date", "vital_val", "vital_unit"], 3)
    return near.select("person_id", "vital_type", "days", F.round("vital_val", 6).alias("vital_val"))


@query("same_day_pivot", sql("""
SELECT person_id, days, round(HT, 6) AS HT, round(WT, 6) AS WT, round(BMI, 6) AS BMI FROM same_day
""", LOG_SQL, VITALS_SQL))
def q_same_day_pivot(spark, sf):
    return _same_day(spark, sf, _who(spark, sf)).select(
        "person_id", "days", *[F.round(c, 6).alias(c) for c in ("HT", "WT", "BMI")])


@query("derived_bmi", sql("""
SELECT person_id, days, round(HT, 6) AS HT, round(WT, 6) AS WT, round(BMI, 6) AS BMI FROM bmi
""", LOG_SQL, VITALS_SQL))
def q_derived_bmi(spark, sf):
    return _body(spark, sf, _who(spark, sf)).select(
        "person_id", "days", *[F.round(c, 6).alias(c) for c in ("HT", "WT", "BMI")])


# ages and reference curves use every log entry of a person as a measurement, so that the joins
# grow with the log


def _measured(spark, sf, who):
    m = log(spark, sf).select("person_id", "event_id", "day", (1.0 + F.col("k") / 100).alias("HT"),
                              (20 + F.col("k") * 0.5).alias("WT"), (12 + F.col("k") * 0.2).alias("BMI"))
    dated = attach_index(m, who.select(*KEYS, "index_date"), KEYS).withColumn(
        "days", F.datediff("day", "index_date")).drop("day", "index_date")
    return C.growth_age(dated, who, KEYS, "age_days", "sex", "days")


def _curve(spark, sf, shift):
    p = table(spark, sf, "part").select(
        (1 + F.col("p_partkey") % 2).cast("double").alias("sex"), (F.col("p_size") * 5 + shift).alias("agemos"),
        ((F.col("p_size") % 5 - 2) / 2).alias("l"), (15.3 + F.col("p_size") * 0.47).alias("m"),
        (0.1 + F.col("p_size") * 0.001).alias("s"))
    return p.distinct()


GROWTH_SQL = """
measured AS (
  SELECT l.person_id, l.event_id, CAST(1.0 + k / 100 AS DOUBLE) AS HT, CAST(20 + k * 0.5 AS DOUBLE) AS WT,
         CAST(12 + k * 0.2 AS DOUBLE) AS BMI, CASE WHEN w.sex = 'M' THEN 1 ELSE 2 END AS sex_code,
         round_even((w.age_days + CAST(date_diff('day', w.index_date, l.day) AS INTEGER)) / 30, 1) AS agemos
  FROM log l JOIN visitors w ON l.person_id = w.person_id),
aged AS (SELECT *, CAST(floor(agemos / 10) * 10 AS INTEGER) AS bucket FROM measured),
curve AS (
  SELECT DISTINCT 1 + p_partkey % 2 AS sex, CAST(p_size * 5 + 0.5 AS DOUBLE) AS point,
         CAST((p_size % 5 - 2) / 2 AS DOUBLE) AS l, CAST(15.3 + p_size * 0.47 AS DOUBLE) AS m,
         CAST(0.1 + p_size * 0.001 AS DOUBLE) AS s FROM part),
hits AS (
  SELECT * FROM (
    SELECT a.*, c.point, c.l, c.m, c.s,
           row_number() OVER (PARTITION BY a.event_id ORDER BY abs(c.point - a.agemos), c.point) AS rn
    FROM aged a LEFT JOIN curve c ON c.sex = a.sex_code AND floor(c.point / 10) * 10 = a.bucket) WHERE rn = 1)
"""


@query("growth_age", sql("SELECT person_id, event_id, agemos, bucket, sex_code FROM aged",
                         LOG_SQL, GROWTH_SQL))
def q_growth_age(spark, sf):
    return _measured(spark, sf, _who(spark, sf)).select("person_id", "event_id", "agemos", "bucket", "sex_code")


def _nearest_reference(spark, sf, **limit):
    curve = _curve(spark, sf, 0.5)
    reference = curve.select((F.floor(F.col("agemos") / 10) * 10).cast("int").alias("bucket"),
                             F.col("sex").cast("int").alias("sex"), F.col("agemos").alias("point"), "l", "m", "s")
    hits = C.nearest_reference_join(
        _measured(spark, sf, _who(spark, sf)), reference,
        {"bucket": "bucket", "sex_code": "sex"}, "agemos", "point", {"l": "l", "m": "m", "s": "s"}, **limit)
    return hits.select("event_id", "agemos", "point", "l", F.round("m", 6).alias("m"), F.round("s", 6).alias("s"))


REFERENCE_SQL = sql("SELECT event_id, agemos, point, l, round(m, 6) AS m, round(s, 6) AS s FROM hits", LOG_SQL, GROWTH_SQL)


@query("nearest_reference_join", REFERENCE_SQL)
def q_nearest_reference_join(spark, sf):
    return _nearest_reference(spark, sf)


@query("nearest_reference_join_shuffled", REFERENCE_SQL)
def q_nearest_reference_join_shuffled(spark, sf):
    return _nearest_reference(spark, sf, max_rows=0)


@query("lms_zscore", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l = 0 THEN ln(x / 25) / 0.25
       ELSE (pow(x / 25, l) - 1) / (l * 0.25) END, 6) AS z
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, CAST(l_linenumber - 3 AS DOUBLE) AS l FROM lineitem)""")
def q_lms_zscore(spark, sf):
    li = table(spark, sf, "lineitem")
    z = lms_zscore(F.col("l_quantity"), (F.col("l_linenumber") - 3).cast("double"), F.lit(25.0), F.lit(0.25))
    return li.select("l_orderkey", "l_linenumber", F.round(z, 6).alias("z"))


def _zscores(spark, sf, who):
    curves = {"HT": (_curve(spark, sf, 0.5), 100.0), "WT": (_curve(spark, sf, 2.0), 1.0),
              "BMI": (_curve(spark, sf, 4.5), 1.0)}
    return C.growth_zscores(_measured(spark, sf, who), curves, ["event_id"])


def _z(measure, shift, factor):
    return f"""
z_{measure} AS (
  SELECT event_id, CASE WHEN l = 0 THEN ln(x / m) / s ELSE (pow(x / m, l) - 1) / (l * s) END AS z FROM (
    SELECT a.event_id, a.{measure} * {factor} AS x, c.l, c.m, c.s,
           row_number() OVER (PARTITION BY a.event_id
             ORDER BY abs(c.point - 0.5 + {shift} - a.agemos), c.point) AS rn
    FROM aged a LEFT JOIN curve c ON c.sex = a.sex_code
     AND floor((c.point - 0.5 + {shift}) / 10) * 10 = a.bucket) WHERE rn = 1)"""


@query("growth_zscores", sql("""
SELECT h.event_id, round(h.z, 6) AS HT_Z, round(w.z, 6) AS WT_Z, round(b.z, 6) AS BMI_Z
FROM z_HT h JOIN z_WT w ON h.event_id = w.event_id JOIN z_BMI b ON h.event_id = b.event_id
""", LOG_SQL, GROWTH_SQL, _z("HT", 0.5, 100), _z("WT", 2.0, 1), _z("BMI", 4.5, 1)))
def q_growth_zscores(spark, sf):
    return _zscores(spark, sf, _who(spark, sf)).select(
        "event_id", *[F.round(f"{m}_Z", 6).alias(f"{m}_Z") for m in ("HT", "WT", "BMI")])


@query("presence_flags", _all("""
SELECT w.person_id, CAST(hemoglobin IS NOT NULL AS INTEGER) AS hemoglobin_ind,
       CAST(platelet_count IS NOT NULL AS INTEGER) AS platelet_count_ind,
       CAST(leukocyte IS NOT NULL AS INTEGER) AS leukocyte_ind, CAST(CRP IS NOT NULL AS INTEGER) AS CRP_ind,
       CAST(neutrophil IS NOT NULL AS INTEGER) AS neutrophil_ind
FROM visitors w LEFT JOIN labs l ON w.person_id = l.person_id"""))
def q_presence_flags(spark, sf):
    who = _who(spark, sf)
    return C.presence_flags(who, _lab_wide(spark, sf, who), KEYS, LABS)


@query("inpatient_flags", _all("SELECT * FROM ip"))
def q_inpatient_flags(spark, sf):
    who = _who(spark, sf)
    return C.inpatient_flags(who, _stays(spark, sf, who), KEYS, "enc_type", ["IP", "EI"])


@query("clean_labs", _all("SELECT event_id, lab_name, round(result_num, 6) AS result_num, result_unit FROM clean"))
def q_clean_labs(spark, sf):
    return _clean_labs(spark, sf, _who(spark, sf)).select(
        "event_id", "lab_name", F.round("result_num", 6).alias("result_num"), "result_unit")


@query("lab_abstraction", _all("""
SELECT person_id, round(hemoglobin, 6) AS hemoglobin, round(platelet_count, 6) AS platelet_count,
       round(leukocyte, 6) AS leukocyte, round(CRP, 6) AS CRP, round(neutrophil, 6) AS neutrophil FROM labs"""))
def q_lab_abstraction(spark, sf):
    return _lab_wide(spark, sf, _who(spark, sf)).select(
        "person_id", *[F.round(c, 6).alias(c) for c in LABS])


@query("baseline_dx_flags", _all("SELECT * FROM dxf"))
def q_baseline_dx_flags(spark, sf):
    who = _who(spark, sf)
    return C.baseline_dx_flags(who, _dx(spark, sf, who), KEYS, list(DX_RULES))


@query("analysis_set", sql("""
SELECT w.person_id, w.site, w.sex, CAST(year(w.index_date) AS INTEGER) AS index_year, e.n_events,
       round(b.BMI, 6) AS BMI, round(l.hemoglobin, 6) AS hemoglobin, round(l.CRP, 6) AS CRP,
       i.IP_IND1, i.IP_IND2, i.IP_IND3, d.abdominal_pain, d.diarrhea, d.rectal_bleeding
FROM visitors w JOIN (SELECT person_id, CAST(count(*) AS BIGINT) AS n_events FROM log GROUP BY 1) e ON w.person_id = e.person_id
LEFT JOIN (SELECT person_id, max(BMI) AS BMI FROM bmi GROUP BY 1) b ON w.person_id = b.person_id
LEFT JOIN labs l ON w.person_id = l.person_id LEFT JOIN ip i ON w.person_id = i.person_id
LEFT JOIN dxf d ON w.person_id = d.person_id""", LOG_SQL, VITALS_SQL, MORE_SQL))
def q_analysis_set(spark, sf):
    who = _who(spark, sf)
    counts = log(spark, sf).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_events"))
    body = _body(spark, sf, who).groupBy(*KEYS).agg(F.max("BMI").alias("BMI"))
    labs = _lab_wide(spark, sf, who)
    out = C.analysis_set(
        who, counts, [body, labs, C.inpatient_flags(who, _stays(spark, sf, who), KEYS, "enc_type", ["IP", "EI"]),
                      C.baseline_dx_flags(who, _dx(spark, sf, who), KEYS, list(DX_RULES))], KEYS, "index_date")
    return out.select("person_id", "site", "sex", "index_year", "n_events", F.round("BMI", 6).alias("BMI"),
                      F.round("hemoglobin", 6).alias("hemoglobin"), F.round("CRP", 6).alias("CRP"),
                      "IP_IND1", "IP_IND2", "IP_IND3", "abdominal_pain", "diarrhea", "rectal_bleeding")


FULL_LABS = ", ".join(f"round(l.{c}, 6) AS {c}, CAST(l.{c} IS NOT NULL AS INTEGER) AS {c}_ind" for c in LABS)
FULL_Z = ", ".join(f"round(z.{m}_Z, 6) AS {m}_Z" for m in ("HT", "WT", "BMI"))
FULL_TIMES = ["base_a", "base_b", "step_1", "step_2", "surgery"]


@query("analysis_set_full", sql(f"""
SELECT c.person_id, c.site, c.sex, c.age, CAST(year(c.index_date) AS INTEGER) AS index_year, t.trt1, t.trt2, t.trt3, t.trt4,
       {', '.join(f't.status_{e}, t.time_{e}' for e in FULL_TIMES)}, t.status6, t.time6,
       {_gap('standard', STD_START, 'step_1')} AS time_std2s1, {_gap('standard', STD_START, 'surgery')} AS time_std2sur,
       {FULL_Z}, {FULL_LABS}, i.IP_IND1, i.IP_IND2, i.IP_IND3, d.abdominal_pain, d.diarrhea, d.rectal_bleeding
FROM cohort c JOIN timeline t ON c.person_id = t.person_id
LEFT JOIN (SELECT a.person_id, max(h.z) AS HT_Z, max(w.z) AS WT_Z, max(b.z) AS BMI_Z
           FROM aged a JOIN z_HT h ON a.event_id = h.event_id JOIN z_WT w ON a.event_id = w.event_id
           JOIN z_BMI b ON a.event_id = b.event_id GROUP BY 1) z ON c.person_id = z.person_id
LEFT JOIN labs l ON c.person_id = l.person_id LEFT JOIN ip i ON c.person_id = i.person_id
LEFT JOIN dxf d ON c.person_id = d.person_id""", COHORT_SQL, CODESET_SQL, EVENTS_SQL, STACK_SQL, TIMELINE_SQL, LOG_SQL, VITALS_SQL, MORE_SQL,
    GROWTH_SQL, _z("HT", 0.5, 100), _z("WT", 2.0, 1), _z("BMI", 4.5, 1)))
def q_analysis_set_full(spark, sf):
    """Cohort, endpoints, sequence, transitions, z-scores, labs with presence flags, stays and diagnoses, keys checked."""
    base = materialize(star.cohort(spark, sf).select("person_id", "site", "sex", "age", "index_date"))
    endpoints = materialize(star.timeline(spark, sf, base.select(*KEYS, "index_date")))
    who = _who(spark, sf)
    scores = _zscores(spark, sf, who).groupBy(*KEYS).agg(*[F.max(f"{m}_Z").alias(f"{m}_Z") for m in ("HT", "WT", "BMI")])
    labs = materialize(_lab_wide(spark, sf, who))
    sides = [materialize(scores), labs, C.presence_flags(base, labs, KEYS, LABS),
             materialize(C.inpatient_flags(who, _stays(spark, sf, who), KEYS, "enc_type", ["IP", "EI"])),
             materialize(C.baseline_dx_flags(who, _dx(spark, sf, who), KEYS, list(DX_RULES)))]
    out = C.analysis_set(base, endpoints, sides, KEYS, "index_date")
    return out.select(
        "person_id", "site", "sex", "age", "index_year", *[f"trt{k}" for k in range(1, 5)],
        *[f"{kind}_{e}" for e in FULL_TIMES for kind in ("status", "time")], "status6", "time6", "time_std2s1", "time_std2sur",
        *[F.round(f"{m}_Z", 6).alias(f"{m}_Z") for m in ("HT", "WT", "BMI")], *[F.round(c, 6).alias(c) for c in LABS],
        *[f"{c}_ind" for c in LABS], "IP_IND1", "IP_IND2", "IP_IND3", "abdominal_pain", "diarrhea", "rectal_bleeding")
