"""The whole study on a made-up clinic."""

import pytest
from pyspark.sql import functions as F

from cohortloom.plans import definitions as D
from cohortloom.plans import study
from cohortloom.sources.contracts import ATTRITION, COHORT, assert_not_null, assert_unique
from tests.clinic import SITES, build


VARIABLES = ["age_at_index", "sex", "race", "HT_Z", "hemoglobin", "platelet_count", "ESR", "albumin"]


@pytest.fixture(scope="module")
def results(spark):
    with pytest.MonkeyPatch.context() as patch:
        # fewer regressors keep the model searches short
        patch.setattr(D, "MODEL_VARIABLES", VARIABLES)
        patch.setattr(D, "MODEL_FACTORS", {"sex": None, "race": "white"})
        patch.setattr(D, "IMPUTE_METHODS", {c: D.IMPUTE_METHODS[c] for c in VARIABLES if c in D.IMPUTE_METHODS})
        patch.setattr(D, "FILLS", {"albumin": 4})
        patch.setattr(D, "IMPUTE_EXTRA", [])
        yield study.run(build(spark), SITES, m=2, sweeps=1, trees=3)


def test_cohort_and_attrition(results):
    people = results["cohort"]
    assert set(people.columns) == set(COHORT.names)
    assert_unique(people, ["patid"])
    assert_not_null(people, ["birth_date", "index_date", "age_at_index"])
    counts = {(r["site"], r["criterion"]): r["pat_cnt"] for r in results["attrition"].collect()}
    assert results["attrition"].columns == ATTRITION.names
    total = sum(counts[s, "eligible"] for s in SITES)
    assert total == people.count()
    assert sum(counts[s, "initial"] for s in SITES) == 240
    assert sum(counts[s, "exclude-dx"] for s in SITES) == 20


def test_endpoints(results):
    stack = results["endpoints"]
    names = {r["endpoint"] for r in stack.select("endpoint").distinct().collect()}
    assert names == set(D.ENDPOINTS)
    assert stack.filter("days < -30").count() == 0
    assert stack.filter("endpoint in ('censor', 'colectomy') and days < 0").count() == 0


def test_analysis_set(results):
    aset = results["analysis_set"]
    assert_unique(aset, study.KEYS)
    assert aset.filter("HT_Z is not null and BMI_ind = 0").count() == 0
    assert aset.filter("(hemoglobin is null) = (hemoglobin_ind = 1)").count() == 0
    assert aset.filter("status6 = 1 and trt1 <> 'standard'").count() == 0
    assert aset.filter("CRP > 5").count() == 0  # mg/L was divided by ten
    missing = set(D.MODEL_VARIABLES) - set(aset.columns)
    assert not missing


def test_tables(results):
    one = {r["summ_var"]: r.asDict() for r in results["table_one"].collect()}
    n = results["cohort"].count()
    assert one["1_N"]["ALL"] == f"{n} (100%)"
    counts = [int(one["1_N"][c].split()[0]) for c in ("SITE1", "SITE2")]
    assert sum(counts) == n
    ends = {r["summ_var"]: r.asDict() for r in results["endpoint_table"].collect()}
    with_, without = (int(ends[f"2_biologics_{k}"]["ALL"].split()[0]) for k in ("w", "wo"))
    assert with_ + without == n


def test_descriptions(results):
    curve = [r["survival"] for r in results["survival"].orderBy("time6").collect()]
    assert all(0 <= b <= a <= 1 for a, b in zip(curve, curve[1:]))
    rates = results["first_treatment"].collect()
    assert {r["var"] for r in rates} >= {"any", "standard"}
    for year in {r["index_year"] for r in rates}:
        parts = [r for r in rates if r["index_year"] == year and r["var"] != "any"]
        assert sum(r["n"] for r in parts) == parts[0]["n_year"]
    assert results["quartiles"].count() == 4
    assert results["six_numbers"].count() == 3
    assert results["missingness"].filter("p > 1 or p < 0").count() == 0
    assert results["contrast"].filter("p_value < 0 or p_value > 1").count() == 0
    assert results["summary"].count() > len(D.MODEL_VARIABLES)
    for name in ("yearly", "time_to_first", "survival_at"):
        assert results[name].count() > 0


def test_imputed_and_models(results):
    imputed = results["imputed"]
    chosen = study.modelling_cohort(results["analysis_set"]).count()
    assert {r["imp"]: r["count"] for r in imputed.groupBy("imp").count().collect()} == {1: chosen, 2: chosen}
    holes = imputed.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in D.IMPUTE_METHODS]).first()
    assert not any(holes)
    uni = {r["term"]: r for r in results["univariate"].collect()}
    assert {"hemoglobin", "sexM", "raceblack", "HT_Z"} <= set(uni)
    for r in uni.values():
        assert r["OR_ci_lower"] <= r["OR"] + 1e-3 and r["OR"] <= r["OR_ci_upper"] + 1e-3
        assert 0 <= r["pval_HR"] <= 1
    assert uni["hemoglobin"]["OR"] < 1
    for name in ("logistic_full", "cox_full"):
        assert results[name].count() == len(uni)
    for name in ("logistic_stepwise", "logistic_manual", "cox_stepwise", "cox_manual"):
        assert results[name].count() > 0
    manual = {r["term"] for r in results["cox_manual"].collect()}
    assert "raceblack" in manual and not manual & {"leukocyte", "basophil", "ESR", "HT_Z"}
