"""Hand-computed small cases, one per trap."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortloom.functions.predicates import guarded_inclusion, starts_with_any
from cohortloom.functions.values import age_years, event_date, lms_zscore, mean_sd, round_half_even, round_to_int
from cohortloom.operators import covariates as C
from cohortloom.operators.codesets import build_lab_codeset, crosswalk_codes
from cohortloom.operators.cohort import apply_exclusion, attrition, dedup_person, exclusion_set, index_event
from cohortloom.operators.endpoints import ActivitySource, censor_date, endpoint_stack, first_event_after_index
from cohortloom.operators.survival import kaplan_meier, survival_at, with_log_ci
from cohortloom.operators.timelines import (
    composite_endpoint,
    first_nonnegative_event,
    treatment_sequence,
)
from cohortloom.plans import definitions as D
from cohortloom.sources.contracts import assert_not_null, assert_unique, schema
from cohortloom.sources.tables import conform, union_sites

KEYS = ["patid", "site"]


def day(text):
    return dt.date.fromisoformat(text) if text else None


def included(spark, events, births, small):
    ev = spark.createDataFrame(
        [(p, "S", c, day(d), day(a)) for p, c, d, a in events],
        "patid string, site string, dx string, dx_date date, admit_date date")
    ev = ev.withColumn("index_date", event_date(F.col("dx_date"), F.col("admit_date")))
    people = spark.createDataFrame([(p, "S", day(b)) for p, b in births], "patid string, site string, birth_date date")
    cond = guarded_inclusion(F.col("dx"), D.INCLUDE_OPEN, D.INCLUDE_GUARDED, F.col("dx_date") >= F.col("birth_date"))
    wanted = ev.filter(starts_with_any(F.col("dx"), ["556", "K51"]))
    out = index_event(wanted, people, KEYS, "index_date", cond, [], [], ["birth_date"], small)
    out = out.withColumn("age", age_years(F.col("birth_date"), F.col("index_date")))
    return ev, out


EVENTS = [
    ("null_guarded", "K51.9", None, "2015-01-05"),
    ("null_open", "556.9", None, "2015-01-05"),
    ("null_last", "556.9", None, None),
    ("null_last", "556.9", "2015-02-01", None),
    ("a17", "K51.9", "2017-06-15", None),
    ("a18", "K51.9", "2017-07-15", None),
    ("a19", "K51.9", "2018-07-15", None),
    ("excluded", "K51.9", "2010-01-01", None),
    ("excluded", "K51.4", "2012-01-01", None),
]
BIRTHS = [(p, "2000-01-01") for p in sorted({e[0] for e in EVENTS})]


@pytest.mark.parametrize("small", [True, False])
def test_inclusion_age_and_attrition(spark, small):
    ev, inc = included(spark, EVENTS, BIRTHS, small)
    rows = {r["patid"]: r for r in inc.collect()}
    assert "null_guarded" not in rows
    assert rows["null_open"]["index_date"] == day("2015-01-05")
    assert rows["null_last"]["index_date"] == day("2015-02-01")
    assert [rows[p]["age"] for p in ("a17", "a18", "a19")] == [17, 18, 19]
    exc = exclusion_set(ev, starts_with_any(F.col("dx"), D.EXCLUDE), KEYS)
    eligible = {r["patid"] for r in apply_exclusion(inc, exc, KEYS, F.col("age") < 18).collect()}
    assert eligible == {"null_open", "null_last", "a17"}
    sites = spark.createDataFrame([("S",), ("empty",)], "site string")
    counts = {(r["site"], r["criterion"]): r["pat_cnt"]
              for r in attrition(inc, exc, "patid", "site", "age", sites=sites).collect()}
    assert counts["S", "initial"] == 6
    assert counts["S", "exclude-age"] == 1
    assert counts["S", "exclude-dx"] == 1
    assert counts["S", "eligible"] == 3
    assert counts["empty", "initial"] == 0


def test_date_guard_on_both(spark):
    df = spark.createDataFrame([("556.1", None), ("K51", True), ("K51", False), ("556.1", True)], "c string, g boolean")
    keep = lambda mode: df.filter(guarded_inclusion(F.col("c"), ["556"], ["K51"], F.col("g"), mode)).count()
    assert keep("as_written") == 3
    assert keep("all") == 2
    with pytest.raises(ValueError):
        keep("none")


def test_earliest_birth_date(spark):
    df = spark.createDataFrame([("p", day("2001-01-02"), "x"), ("p", day("2000-05-05"), "y"), ("p", None, "z")],
                               "patid string, birth_date date, tag string")
    assert [r["tag"] for r in dedup_person(df, ["patid"], "birth_date").collect()] == ["y"]


def index(spark, *persons):
    return spark.createDataFrame([(p, "S", day("2016-01-01")) for p in persons],
                                 "patid string, site string, index_date date")


@pytest.mark.parametrize("small", [True, False])
def test_censor_fallback_after_maximum(spark, small):
    ev = spark.createDataFrame([("p", "S", None, day("2016-05-01")), ("p", "S", day("2016-01-01"), None),
                                ("q", "S", None, day("2016-05-01")), ("q", "S", day("2015-01-01"), day("2017-01-01"))],
                               "patid string, site string, admit_date date, dx_date date")
    out = censor_date(index(spark, "p", "q"), [ActivitySource(ev, "admit_date", "dx_date")], KEYS, "index_date",
                      small=small)
    assert {r["patid"]: r["censor_date"] for r in out.collect()} == {
        "p": day("2016-01-01"), "q": day("2016-05-01")}


@pytest.mark.parametrize("small", [True, False])
def test_first_date_before_index_hides_a_later_one(spark, small):
    who = index(spark, "one", "two")
    first = day("2015-12-22")
    later = day("2016-01-21")
    schema = "patid string, site string, therapy string, d date"
    a = spark.createDataFrame([("one", "S", "m", first), ("one", "S", "m", later), ("two", "S", "m", first),
                               ("two", "S", "m", day("2015-11-01"))], schema)
    b = spark.createDataFrame([("two", "S", "m", later)], schema)
    firsts = [first_event_after_index(who, x, KEYS, "index_date", "d", ["therapy"], 30, small=small) for x in (a, b)]
    assert {r["first_date"] for r in firsts[0].collect()} == {first}
    stack = endpoint_stack({"a": (firsts[0], "first_date", "therapy"), "b": (firsts[1], "first_date", "therapy")},
                           KEYS, "index_date")
    out = first_nonnegative_event(stack, KEYS).collect()
    assert [(r["patid"], r["days"]) for r in out] == [("two", 20)]


def test_treatment_order_modes(spark):
    df = spark.createDataFrame([(1, 30, 10, 20, None), (2, None, None, None, None), (3, 5, 5, None, 1)],
                               "id int, standard int, imm int, bio int, col int")
    names = ["standard", "imm", "bio", "col"]
    rank = {r["id"]: r for r in treatment_sequence(df, ["id"], names).collect()}
    assert [rank[1][f"trt{k}"] for k in range(1, 5)] == ["imm", "bio", "standard", None]
    assert [rank[3][f"trt{k}"] for k in range(1, 5)] == ["col", "standard", "imm", None]
    assert 2 not in rank
    order = {r["id"]: r for r in treatment_sequence(df, ["id"], names, mode="order").collect()}
    assert [order[1][f"trt{k}"] for k in range(1, 5)] == ["bio", "standard", "imm", None]


def test_composite_ignores_missing(spark):
    df = spark.createDataFrame([(None, 5), (None, None), (3, 9)], "a int, b int")
    assert [r["c"] for r in composite_endpoint(df, "c", ["a", "b"]).collect()] == [5, None, 3]


def test_units_and_limits(spark):
    df = spark.createDataFrame([("HT", 50.0, "in"), ("HT", 15.0, "in"), ("WT", 100.0, "lb"), ("HT", 1.5, None),
                                ("XX", 1.0, "in")], "k string, v double, u string")
    out = C.convert_units(df, D.VITAL_UNITS, "k", "v", "u")
    assert [round(r["v"], 6) for r in out.collect()] == [1.270003, 15, 45.359291, 1.5, 1.0]
    kept = C.plausible_range(out, D.VITAL_LIMITS, "k", "v")
    assert sorted(round(r["v"], 2) for r in kept.collect()) == [1.27, 1.5, 45.36]


def test_window_follows_the_nearest_choice(spark):
    df = spark.createDataFrame([("p", 31, 1.5), ("p", -400, 1.2), ("q", 30, 1.0), ("q", None, 2.0)],
                               "patid string, days int, v double")
    out = C.nearest_within(df, ["patid"], F.col("days"), ["v"], 30).collect()
    assert [(r["patid"], r["days"]) for r in out] == [("q", 30)]


def test_height_and_weight_must_share_the_day(spark):
    df = spark.createDataFrame([("p", -3, "HT", 1.3), ("p", -2, "WT", 40.0), ("q", 1, "HT", 1.3), ("q", 1, "WT", 55.0)],
                               "patid string, days int, k string, v double")
    out = C.same_day_pivot(df, ["patid"], "days", "k", "v", ["HT", "WT", "BMI"], ["HT", "WT"])
    rows = C.derived_bmi(out).collect()
    assert [(r["patid"], r["BMI"]) for r in rows] == [("q", 33)]


def test_rounding(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (2.7,)], "v double")
    assert [r[0] for r in df.select(round_half_even(F.col("v"))).collect()] == [2, 4, 3]
    assert [r[0] for r in df.select(round_to_int(F.col("v"))).collect()] == [3, 4, 3]


@pytest.mark.parametrize("max_rows", [1000, 0])
def test_nearest_reference_stays_in_its_bucket(spark, max_rows):
    ref = spark.createDataFrame([(70, 1, 75.5), (80, 1, 80.5), (70, 2, 71.5)], "bucket int, sex int, p double")
    df = spark.createDataFrame([("a", 79.9, 70, 1), ("b", 79.9, 70, 2), ("c", 99.0, 90, 1)],
                               "id string, age double, bucket int, sex_code int")
    out = C.nearest_reference_join(df, ref, {"bucket": "bucket", "sex_code": "sex"}, "age", "p", {"p": "hit"},
                                   max_rows=max_rows)
    assert {r["id"]: r["hit"] for r in out.collect()} == {"a": 75.5, "b": 71.5, "c": None}


def test_lms(spark):
    df = spark.createDataFrame([(18.0, -2.0, 16.0, 0.1), (18.0, 0.0, 16.0, 0.1), (18.0, None, 16.0, 0.1)],
                               "x double, l double, m double, s double")
    z = [r[0] for r in df.select(lms_zscore(*[F.col(c) for c in "xlms"])).collect()]
    assert z[0] == pytest.approx(1.049383, abs=1e-6)
    assert z[1] == pytest.approx(1.177830, abs=1e-6)
    assert z[2] is None


def test_lab_rules(spark):
    df = spark.createDataFrame([("leukocyte", 5.0, None), ("neutrophil", 101.0, "%"), ("ESR", 5.0, None),
                                ("CRP", 5.0, "mg/L"), ("ESR", None, "mm/h"), ("leukocyte", 5.0, "10*3/uL"),
                                ("hemoglobin", 12.0, "mg")], "k string, v double, u string")
    out = C.clean_labs(df, D.LAB_LIMITS, D.LAB_UNITS, "k", "v", "u")
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [("CRP", 0.5), ("ESR", 5.0), ("leukocyte", 5.0)]


def test_inpatient_flags(spark):
    who = spark.createDataFrame([("a", "IP"), ("b", "AV"), ("c", None), ("d", "EI"), ("e", "IS")],
                                "patid string, enc_type_at_index string")
    stays = spark.createDataFrame([("a", "IP", -2, None), ("b", "IP", -2, 2), ("c", "EI", 0, 0), ("d", "IS", 0, 3)],
                                  "patid string, enc_type string, admit_days int, los int")
    out = C.inpatient_flags(who, stays, ["patid"], "enc_type_at_index", ["IP", "EI"])
    got = {r["patid"]: (r["IP_IND1"], r["IP_IND2"], r["IP_IND3"]) for r in out.collect()}
    assert got == {"a": (1, 0, 0), "b": (0, 1, 0), "c": (0, 1, 1), "d": (1, 0, 0), "e": (0, 0, 0)}


def test_cell_of_a_single_person_is_null(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 10.0), (2, 13.0)], "g int, v double")
    out = df.groupBy("g").agg(mean_sd(F.avg("v"), F.stddev_samp("v")).alias("c")).orderBy("g").collect()
    assert [r["c"] for r in out] == [None, "12 (2.1)"]


SURVIVAL = [(5, 1), (6, 0), (7, 1), (7, 1), (9, 0), (10, 1)]


def test_survival_curve(spark):
    df = spark.createDataFrame(SURVIVAL, "t int, s int")
    curve = kaplan_meier(df, "t", "s")
    rows = {r["t"]: r for r in with_log_ci(curve).collect()}
    assert rows[5]["survival"] == pytest.approx(0.833333, abs=1e-6)
    assert rows[7]["survival"] == pytest.approx(0.416667, abs=1e-6)
    assert rows[7]["lower"] == pytest.approx(0.146792, abs=1e-6)
    assert rows[7]["upper"] == 1.0
    assert rows[10]["survival"] == 0.0
    at = {r["at"]: r for r in survival_at(curve, [4, 8, 11], "t").collect()}
    assert set(at) == {4, 8}
    assert (at[4]["survival"], at[4]["n_risk"], at[8]["n_risk"]) == (1.0, 6, 2)
    with pytest.raises(TypeError):
        kaplan_meier(df.withColumn("t", F.col("t").cast("double")), "t", "s")


def test_one_text_in_two_labs(spark):
    df = spark.createDataFrame([("1", "Neutrophils per 100 Leukocytes"), ("2", "Platelet mean count"),
                                ("3", "count of platelets")], "loinc_num string, long_common_name string")
    out = build_lab_codeset(df, D.LAB_PATTERNS, "long_common_name", ["loinc_num"]).collect()
    assert sorted((r["loinc_num"], r["lab_name"]) for r in out) == [
        ("1", "leukocyte"), ("1", "neutrophil"), ("2", "platelet_count")]


def test_crosswalk_copies(spark):
    codes = spark.createDataFrame([("m", "1", "drug")], "therapy string, rxcui string, str string")
    attr = spark.createDataFrame([("1", "NDC", "RXNORM", "001"), ("1", "NDC", "OTHER", "002")],
                                 "rxcui string, atn string, sab string, atv string")
    for copies in (1, 3):
        out = crosswalk_codes(codes, attr, "rxcui", D.CROSSWALK_FILTERS, "atv", "ndc", ["therapy", "rxcui", "str"],
                              copies=copies)
        assert [r["ndc"] for r in out.collect()] == ["001"] * copies


def test_key_checks(spark):
    df = spark.createDataFrame([("p", 1), ("p", 2), ("q", None)], "patid string, v int")
    with pytest.raises(ValueError, match="duplicate key"):
        assert_unique(df, ["patid"])
    assert assert_unique(df, ["patid", "v"]) is df
    with pytest.raises(ValueError, match="missing values"):
        assert_not_null(df, ["patid", "v"])


def test_insert_rounds_and_casts_by_position(spark):
    df = spark.createDataFrame([("p", 2.7, "2016-01-01"), ("q", -2.5, "2016-01-02")], "a string, b double, c string")
    out = conform(df.toDF("k", "v", "d"), schema("k string, v int, d date"))
    assert [tuple(r) for r in out.collect()] == [("p", 3, day("2016-01-01")), ("q", -3, day("2016-01-02"))]


def test_sites_with_different_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, "y")], "id int, b string")
    rows = {r["id"]: r.asDict() for r in union_sites({"A": a, "B": b}).collect()}
    assert rows[1] == {"id": 1, "a": "x", "site": "A", "b": None}
    assert rows[2] == {"id": 2, "a": None, "site": "B", "b": "y"}


def test_a_height_of_zero_gives_no_bmi(spark):
    rows = spark.createDataFrame([(1, 0.0, 50.0, None), (2, 0.0, 50.0, 17.0), (3, 2.0, 50.0, None), (4, 0.0, 0.0, None), (5, None, 50.0, None)],
                                 "p int, HT double, WT double, BMI double")
    assert {(r["p"], r["BMI"]) for r in C.derived_bmi(rows).collect()} == {(2, 17.0), (3, 12.0)}
