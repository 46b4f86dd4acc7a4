"""From source tables to pooled models.

Every step takes and returns DataFrames for all sites at once; person and site together are the
key. Tables that several later steps read (cohort, endpoints, analysis set) are written out once,
so the following joins know their true size.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.predicates import (
    code_matches,
    guarded_inclusion,
    starts_with_any,
    year_between,
)
from cohortloom.functions.skew import BROADCAST_ROWS, fits
from cohortloom.functions.values import age_years, days_between, event_date, recode, threshold_flag
from cohortloom.operators import covariates as C
from cohortloom.operators import summaries as S
from cohortloom.operators.codesets import build_drug_codeset, build_lab_codeset, crosswalk_codes
from cohortloom.operators.cohort import apply_exclusion, attrition, dedup_person, exclusion_set, index_event
from cohortloom.operators.cox import fit_cox
from cohortloom.operators.design import dummy_code, fill_constants, select_terms
from cohortloom.operators.endpoints import (
    ActivitySource,
    EventRule,
    censor_date,
    endpoint_stack,
    first_event_after_index,
    first_events,
    union_sources,
)
from cohortloom.operators.impute import mice_impute
from cohortloom.operators.models import (
    ModelSpec,
    coefficients,
    fit_logistic,
    joint_specs,
    univariate_specs,
)
from cohortloom.operators.pooling import paired_table, result_table, rubin_pool
from cohortloom.operators.stepwise import stepwise_cox, stepwise_logistic
from cohortloom.operators.survival import kaplan_meier, survival_at, with_log_ci
from cohortloom.operators.timelines import (
    after_first_flags,
    any_treatment_time,
    composite_endpoint,
    escalation_outcome,
    first_nonnegative_event,
    index_to_first,
    pivot_endpoints,
    status_time,
    transition_times,
    treatment_sequence,
)
from cohortloom.plans import definitions as D
from cohortloom.session import materialize
from cohortloom.sources.contracts import ATTRITION, COHORT, DIAGNOSES, ENCOUNTERS, LABS, VITALS, VITALS_INTEGER
from cohortloom.sources.tables import conform

KEYS = ["patid", "site"]


@dataclass(frozen=True)
class Sources:
    """Clinical tables with a ``site`` column, dictionaries, and growth curves by measure."""

    demographic: DataFrame
    diagnosis: DataFrame
    procedures: DataFrame
    prescribing: DataFrame
    dispensing: DataFrame
    med_admin: DataFrame
    vital: DataFrame
    obs_clin: DataFrame
    lab_result: DataFrame
    encounter: DataFrame
    drug_dictionary: DataFrame
    drug_attributes: DataFrame
    lab_dictionary: DataFrame
    curves: Mapping[str, DataFrame]


def codesets(src: Sources) -> dict[str, DataFrame]:
    drugs = materialize(build_drug_codeset(
        src.drug_dictionary, D.DRUG_RULES, "str", "tty", ["str", "rxcui", "suppress", "tty"]))
    ndc = crosswalk_codes(drugs.drop("suppress"), src.drug_attributes, "rxcui", D.CROSSWALK_FILTERS, "atv", "ndc",
                          ["therapy", "rxcui", "str"], ["suppress"])
    labs = build_lab_codeset(src.lab_dictionary, D.LAB_PATTERNS, "long_common_name",
                             ["loinc_num", "component", "long_common_name"])
    return {"drugs": drugs, "ndc": materialize(ndc), "labs": materialize(labs)}


def cohort(src: Sources, date_guard: str = "as_written") -> tuple[DataFrame, DataFrame]:
    """Eligible persons and the attrition counts per site."""
    dx = src.diagnosis.withColumns({"dx_date": F.to_date("dx_date"), "admit_date": F.to_date("admit_date")})
    dx = dx.withColumn("index_date", event_date(F.col("dx_date"), F.col("admit_date")))
    persons = src.demographic.select(
        *KEYS, F.to_date("birth_date").alias("birth_date"), "sex",
        recode(F.col("race"), D.RACE_LEVELS, "unk", "ot", D.UNKNOWN_CODES).alias("race"),
        recode(F.col("hispanic"), D.HISPANIC_LEVELS, "unk", "ot", D.UNKNOWN_CODES).alias("hispanic"))
    wanted = dx.filter(starts_with_any(F.col("dx"), [*D.INCLUDE_OPEN, *D.INCLUDE_GUARDED]))
    condition = guarded_inclusion(F.col("dx"), D.INCLUDE_OPEN, D.INCLUDE_GUARDED,
                                  F.col("dx_date") >= F.col("birth_date"), date_guard)
    first = index_event(wanted, persons, KEYS, "index_date", condition, ["enc_type"], ["enc_type"],
                        ["birth_date", "sex", "race", "hispanic"])
    birth, at = F.col("birth_date"), F.col("index_date")
    included = materialize(conform(first.withColumns({
        "age_at_index": age_years(birth, at), "age_at_index_days": days_between(birth, at),
        "enc_type_at_index": F.col("enc_type")}), COHORT))
    excluded = exclusion_set(src.diagnosis, starts_with_any(F.col("dx"), D.EXCLUDE), KEYS)
    eligible = apply_exclusion(included, excluded, KEYS, F.col("age_at_index") < D.AGE_LIMIT)
    counts = attrition(included, excluded, "patid", "site", "age_at_index", D.AGE_LIMIT,
                       src.demographic.select("site"))
    return materialize(dedup_person(eligible, ["patid"], "birth_date")), conform(counts, ATTRITION)


def endpoints(src: Sources, people: DataFrame, codes: Mapping[str, DataFrame]) -> DataFrame:
    """Long endpoint table: colectomy, first drugs per group and source, and censoring."""
    who = people.select(*KEYS, "index_date")
    small = fits(who, BROADCAST_ROWS)
    px = src.procedures.filter(code_matches(F.col("px"), D.COLECTOMY_CODES, D.COLECTOMY_PREFIXES))
    colectomy = first_event_after_index(who, px, KEYS, "index_date", "px_date", small=small)

    def drugs_of(events, *rules):
        return first_events(who, events, rules, KEYS, "index_date", "therapy", small=small).drop("source")

    def rule(source, code, set_name, set_code, date, condition=None):
        return EventRule(source, F.col(code), F.col(date), codes[set_name], set_code, condition, D.LOOKBACK_DAYS)

    kind = F.col("medadmin_type")
    drugs = union_sources(
        drugs_of(src.prescribing, rule("prescribed", "rxnorm_cui", "drugs", "rxcui", "rx_start_date")),
        drugs_of(src.dispensing, rule("dispensed", "ndc", "ndc", "ndc", "dispense_date")),
        drugs_of(src.med_admin, rule("given_rx", "medadmin_code", "drugs", "rxcui", "medadmin_start_date", kind == "RX"),
                 rule("given_nd", "medadmin_code", "ndc", "ndc", "medadmin_start_date", kind == "ND")))
    censor = censor_date(who, [
        ActivitySource(src.diagnosis, "admit_date", "dx_date"),
        ActivitySource(src.procedures, "admit_date", "px_date"),
        ActivitySource(src.prescribing, "rx_start_date", "rx_order_date")], KEYS, "index_date", small=small)
    return materialize(endpoint_stack({
        "colectomy": (colectomy, "first_date", None),
        "drugs": (drugs, "first_date", "therapy"),
        "censor": (censor, "censor_date", None)}, KEYS, "index_date"))


def covariates(src: Sources, people: DataFrame, codes: Mapping[str, DataFrame],
               integer_vitals: bool = False) -> dict[str, DataFrame]:
    """The four long covariate tables."""
    who = people.select(*KEYS, "index_date")
    small = fits(who, BROADCAST_ROWS)
    coded = src.obs_clin.filter(F.col("obsclin_type") == D.VITAL_CODE_TYPE)
    vitals = C.vitals_stack(who, src.vital, coded, KEYS, "index_date", D.VITAL_COLUMNS, "measure_date",
                            D.VITAL_CODES, "obsclin_code", "obsclin_result_num", "obsclin_result_unit",
                            "obsclin_start_date", small=small)
    dx = C.dx_groups(who, src.diagnosis, D.DX_GROUPS, KEYS, "index_date", "dx",
                     event_date(F.col("dx_date"), F.col("admit_date")), small=small)
    labs = C.lab_events(who, src.lab_result, codes["labs"].select("loinc_num", "lab_name").distinct(), KEYS,
                        "index_date", "lab_loinc", "loinc_num", "lab_name", D.LAB_DATES,
                        ["result_num", "result_qual", "result_unit", "norm_modifier_high"], small=small)
    stays = C.inpatient_encounters(who, src.encounter, KEYS, "index_date", "enc_type", D.STAY_TYPES,
                                   "admit_date", "discharge_date", small=small)
    return {"vitals": conform(vitals, VITALS_INTEGER if integer_vitals else VITALS),
            "diagnoses": conform(dx, DIAGNOSES), "labs": conform(labs, LABS),
            "encounters": conform(stays, ENCOUNTERS)}


def body_measures(vitals: DataFrame, people: DataFrame, curves: Mapping[str, DataFrame]) -> DataFrame:
    """Baseline height, weight and BMI of one day with their z-scores."""
    converted = C.convert_units(vitals, D.VITAL_UNITS, "vital_type", "vital_val", "vital_unit")
    sane = C.plausible_range(converted, D.VITAL_LIMITS, "vital_type", "vital_val")
    near = C.nearest_within(sane, [*KEYS, "vital_type"], F.col("days"),
                            ["measure_date", "vital_val", "vital_unit"], D.LATEST_DAY)
    day = C.same_day_pivot(near, KEYS, "days", "vital_type", "vital_val", ["HT", "WT", "BMI"], ["HT", "WT"])
    aged = C.growth_age(C.derived_bmi(day), people, ["patid"], "age_at_index_days", "sex", "days")
    scored = C.growth_zscores(
        aged, {"BMI": (curves["BMI"], 1.0), "HT": (curves["HT"], 100.0), "WT": (curves["WT"], 1.0)}, KEYS)
    return scored.select(*KEYS, "HT", "WT", "BMI", "HT_Z", "WT_Z", "BMI_Z")


def lab_values(labs: DataFrame) -> DataFrame:
    clean = C.clean_labs(labs, D.LAB_LIMITS, D.LAB_UNITS, "lab_name", "result_num", "result_unit")
    return C.lab_abstraction(clean, KEYS, "lab_name", "result_num", D.LAB_OFFSETS, D.LABS, D.LATEST_DAY,
                             ["result_unit"])


def endpoint_times(stack: DataFrame, mode: str = "rank") -> tuple[DataFrame, DataFrame]:
    """Wide day offsets per endpoint, and the order of treatments."""
    wide = materialize(pivot_endpoints(first_nonnegative_event(stack, KEYS), KEYS, D.ENDPOINTS))
    order = treatment_sequence(composite_endpoint(wide, "standard", D.FIRST_LINE), KEYS, D.TREATMENTS, mode=mode)
    return wide, after_first_flags(order, D.AFTER_FIRST)


def analysis_set(people: DataFrame, stack: DataFrame, tables: Mapping[str, DataFrame],
                 curves: Mapping[str, DataFrame], mode: str = "rank") -> DataFrame:
    """One row per person with outcome times and baseline covariates."""
    wide, order = endpoint_times(stack, mode)
    body = materialize(body_measures(tables["vitals"], people, curves))
    labs = materialize(lab_values(tables["labs"]))
    stays = C.inpatient_flags(people, tables["encounters"], KEYS, "enc_type_at_index", D.INPATIENT_TYPES)
    joined = C.analysis_set(people, wide, [
        order, body, C.presence_flags(people, body, KEYS, ["HT", "WT", "BMI"]), stays, labs,
        C.presence_flags(people, labs, KEYS, D.LABS),
        C.baseline_dx_flags(people, tables["diagnoses"], KEYS, list(D.DX_GROUPS))], KEYS, "index_date")
    timed = transition_times(status_time(joined, D.TIMED), D.TRANSITIONS)
    begun = index_to_first(timed, ["corticosteroids", "mesalazine"])
    return materialize(escalation_outcome(begun, "colectomy", ["immunomodulator", "biologics"]))


def in_scope(aset: DataFrame) -> DataFrame:
    return aset.filter(year_between(F.col("index_date"), *D.YEARS) & F.col("age_at_index").between(*D.AGES))


def modelling_cohort(aset: DataFrame) -> DataFrame:
    """Persons who began with the standard treatment, with a usable follow-up time."""
    return in_scope(aset).filter((F.col("trt1") == "standard") & (F.col("time6") >= 0)).withColumn(
        "age_12y", threshold_flag(F.col("age_at_index"), D.OLDER_FROM))


def describe(aset: DataFrame) -> dict[str, DataFrame]:
    """All descriptive tables of the analysis set."""
    scope = any_treatment_time(in_scope(aset), D.TIMED)
    yearly = S.yearly_denominators(scope, "patid", "index_year")
    rates = S.first_treatment_rates(scope, "patid", "index_year")
    chosen = materialize(modelling_cohort(aset))
    status = F.col("status6") == 1
    stepped = (F.col("status_immunomodulator") == 1) | (F.col("status_biologics") == 1)
    curve = kaplan_meier(chosen, "time6", "status6")
    variables = [*D.MODEL_VARIABLES, *D.IMPUTE_EXTRA, "age_12y", "25_OH_VD", *D.FLAG_VARIABLES]
    factors = [*D.MODEL_FACTORS, *D.IMPUTE_EXTRA, "age_12y", *D.FLAG_VARIABLES]
    return {
        "yearly": yearly,
        "first_treatment": S.any_treatment_rows(rates, yearly, "index_year"),
        "time_to_first": S.time_to_first(scope, "trt1_time"),
        "missingness": S.missingness_rates(scope, "patid", "index_year", D.FLAG_VARIABLES),
        "quartiles": S.quartiles_by_outcome(chosen, "patid", "time6", {
            "0": ~status, "1": status, "colectomy": status & (F.col("status_colectomy") == 1),
            "step_up": status & stepped & (F.col("status_colectomy") == 0)}),
        "six_numbers": S.six_numbers(chosen, {
            "time_idx2std": ("time_idx2std", F.lit(True)),
            "colectomy": ("time6", F.col("status_colectomy") == 1), "step_up": ("time6", stepped)}),
        "survival": with_log_ci(curve),
        "survival_at": survival_at(curve, D.SURVIVAL_DAYS, "time6"),
        "summary": S.univariate_summary(chosen, variables, factors),
        "contrast": S.univariate_summary(chosen, variables, factors, "status6"),
    }


def impute(aset: DataFrame, m: int = D.IMPUTATIONS, sweeps: int = 5, seed: int = 20, trees: int = 10) -> DataFrame:
    """Completed model inputs, factors coded, stacked over the imputations."""
    columns = [*D.MODEL_VARIABLES, *D.IMPUTE_EXTRA]
    filled = fill_constants(modelling_cohort(aset).select("patid", "status6", "time6", *columns), D.FILLS)
    coded, terms = dummy_code(materialize(filled), D.MODEL_FACTORS)
    fixed = [c for cols in terms.values() for c in cols]
    numeric = [c for c in columns if c not in D.MODEL_FACTORS and c not in D.IMPUTE_METHODS]
    counts = coded.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in D.IMPUTE_METHODS]).first()
    methods = {c: how for c, how in D.IMPUTE_METHODS.items() if counts[c]}
    complete = [c for c in D.IMPUTE_METHODS if c not in methods]
    if not methods:
        return coded.withColumn("imp", F.explode(F.sequence(F.lit(1), F.lit(m))))
    return mice_impute(coded, "patid", methods, [*fixed, *numeric, *complete], m, sweeps, seed, trees)


def model_terms(imputed: DataFrame) -> dict[str, list[str]]:
    """Design columns per model variable; a factor stands for its coded columns.

    Coded columns are those that are no variable themselves; each belongs to the factor with the longest name it begins with.
    """
    own = {*D.MODEL_VARIABLES, *D.IMPUTE_EXTRA, *D.IMPUTE_METHODS, "patid", "status6", "time6", "imp"}
    coded = {c: max((v for v in D.MODEL_FACTORS if c.startswith(v)), key=len, default=None) for c in imputed.columns if c not in own}
    return {v: [c for c, f in coded.items() if f == v] if v in D.MODEL_FACTORS else [v] for v in D.MODEL_VARIABLES}


def fit_models(imputed: DataFrame, m: int = D.IMPUTATIONS) -> dict[str, DataFrame]:
    """Pooled univariate, full, stepwise and hand-selected models of both families."""
    spark = imputed.sparkSession
    data = materialize(imputed)
    n = data.filter(F.col("imp") == 1).count()
    imps = list(range(1, m + 1))
    terms = {v: cols for v, cols in model_terms(data).items() if cols}

    def logistic(specs):
        return fit_logistic(data, "status6", specs, "imp")

    def cox(specs):
        return fit_cox(data, "time6", "status6", specs, "imp")

    def pool(fits, name=None):
        pooled = rubin_pool(coefficients(spark, fits), n, m)
        return pooled if name is None else result_table(pooled, name)

    def by_hand(selections, rule):
        return [ModelSpec("manual", tuple(c for v in select_terms(s.variables, **rule) for c in terms.get(v, [])),
                          s.imp) for s in selections]

    single, full = univariate_specs(terms, imps), joint_specs("full", terms, imps)
    chosen_lr = stepwise_logistic(data, "status6", terms, "imp", imps)
    chosen_cox = stepwise_cox(data, "time6", "status6", terms, "imp", imps)
    return {
        "univariate": paired_table(pool(logistic(single)), pool(cox(single))),
        "logistic_full": pool(logistic(full), "OR"),
        "logistic_stepwise": pool([s.fit for s in chosen_lr], "OR"),
        "logistic_manual": pool(logistic(by_hand(chosen_lr, D.HAND_LOGISTIC)), "OR"),
        "cox_full": pool(cox(full), "HR"),
        "cox_stepwise": pool([s.fit for s in chosen_cox], "HR"),
        "cox_manual": pool(cox(by_hand(chosen_cox, D.HAND_COX)), "HR"),
    }


def table_one(people: DataFrame, sites: list[str]) -> DataFrame:
    cells = S.table_one(people, "patid", "site", "age_at_index",
                        {"3_sex": "sex", "4_race": "race", "5_hispanic": "hispanic"})
    return S.pivot_sites(cells, "site", sites)


def endpoint_table(people: DataFrame, stack: DataFrame, sites: list[str]) -> DataFrame:
    return S.pivot_sites(S.endpoint_table(people, stack, "patid", "site"), "site", sites)


def run(src: Sources, sites: list[str], m: int = D.IMPUTATIONS, sweeps: int = 5, trees: int = 10) -> dict[str, DataFrame]:
    """The whole study; every result is a DataFrame."""
    codes = codesets(src)
    people, counts = cohort(src)
    stack = endpoints(src, people, codes)
    tables = covariates(src, people, codes)
    aset = analysis_set(people, stack, tables, src.curves)
    imputed = impute(aset, m, sweeps, trees=trees)
    return {"attrition": counts, "cohort": people, "endpoints": stack, **tables, "analysis_set": aset,
            "table_one": table_one(people, sites), "endpoint_table": endpoint_table(people, stack, sites),
            **describe(aset), "imputed": imputed, **fit_models(imputed, m)}
