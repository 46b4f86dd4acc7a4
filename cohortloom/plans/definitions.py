"""Fixed values of the built-in study: codes, patterns, units, limits and variable lists.

All of them must be as they are for the results to be right; other studies pass their own.
"""

from __future__ import annotations

from cohortloom.operators.codesets import DrugRule
from cohortloom.operators.covariates import PlausibleRule, UnitRule
from cohortloom.operators.timelines import Transition

# -- fixed values: cohort ---------------------------------------------------------------------------
INCLUDE_OPEN = ["556"]
INCLUDE_GUARDED = ["K51"]
EXCLUDE = ["556.2", "556.4", "K51.2", "K51.4"]
AGE_LIMIT = 18
RACE_LEVELS = {"white": ["05"], "black": ["03"]}
HISPANIC_LEVELS = {"hispanic": ["Y"], "non-hispanic": ["N"]}
UNKNOWN_CODES = ["UN", "NI"]

# -- fixed values: endpoints ------------------------------------------------------------------------
# 544206 is kept as it stands in the list the results were made with
COLECTOMY_CODES = [
    "44121", "44139", "44140", "44141", "44143", "44144", "44145", "44146", "44147",
    "44150", "44151", "44152", "44153", "44154", "44155", "44156", "44157", "44158", "44160",
    "44204", "44205", "544206", "44207", "44208", "44210", "44211", "44212", "44213",
]
COLECTOMY_PREFIXES = ["45.8", "17.3", "0DP", "0DT"]
LOOKBACK_DAYS = 30
ENDPOINTS = ["biologics", "censor", "colectomy", "corticosteroids", "immunomodulator", "mesalazine"]
FIRST_LINE = ["mesalazine", "corticosteroids"]
TREATMENTS = ["standard", "immunomodulator", "biologics", "colectomy"]
TIMED = ["colectomy", "corticosteroids", "immunomodulator", "mesalazine", "biologics"]
AFTER_FIRST = {
    "col_aft_trt1": "colectomy",
    "bio_aft_trt1": "biologics",
    "imm_aft_trt1": "immunomodulator",
}
TRANSITIONS = [
    Transition("time_std2bio", "standard", ("corticosteroids", "mesalazine"), "biologics"),
    Transition("time_std2imm", "standard", ("corticosteroids", "mesalazine"), "immunomodulator"),
    Transition("time_std2col", "standard", ("corticosteroids", "mesalazine"), "colectomy"),
    Transition("time_bio2imm", "biologics", ("biologics",), "immunomodulator"),
    Transition("time_bio2col", "biologics", ("biologics",), "colectomy"),
    Transition("time_imm2bio", "immunomodulator", ("immunomodulator",), "biologics"),
    Transition("time_imm2col", "immunomodulator", ("immunomodulator",), "colectomy"),
]

# -- fixed values: drug code sets -------------------------------------------------------------------
GENERIC_TYPES = {"type_prefixes": ("SCD",), "type_suffixes": ("IN",)}
BRAND_TYPES = {"type_prefixes": ("SBD",)}
DRUG_RULES = [
    DrugRule("corticosteroids", (
        "hydrocortisone", "cortisone", "ethamethasoneb", "prednisone", "prednisolone",
        "triamcinolone", "methylprednisolone", "dexamethasone", "fludrocortisone"), **GENERIC_TYPES),
    DrugRule("mesalazine", ("mesalazine", "mesalamine"), ("rectal", "enema"), **GENERIC_TYPES),
    DrugRule("mesalazine", (
        "pentasa", "apriso", "colazal", "asacol", "sulfasalaz", "lialda", "delzicol"),
        ("rectal", "enema"), **BRAND_TYPES),
    DrugRule("biologics", ("infliximab", "adalimumab", "vedolizumab", "ustekinumab"), **GENERIC_TYPES),
    DrugRule("biologics", (
        "humira", "amgevita", "hulio", "hadlima", "hyrimoz", "idacio", "irmaldi", "remicade",
        "inflectra", "renflexis", "avsola", "entyvio", "stelara"), **BRAND_TYPES),
    DrugRule("immunomodulator", ("azathioprine", "mercaptopurine", "methotrexate"), **GENERIC_TYPES),
]
CROSSWALK_FILTERS = {"atn": "NDC", "sab": "RXNORM"}

# -- fixed values: covariates -----------------------------------------------------------------------
VITAL_COLUMNS = {"HT": ("ht", "in"), "WT": ("wt", "lb"), "BMI": ("original_bmi", "kg/m2")}
VITAL_CODES = {"8302-2": "HT", "29463-7": "WT", "39156-5": "BMI"}
VITAL_CODE_TYPE = "LC"
DX_GROUPS = {
    "abdominal_pain": ["789", "R10"],
    "diarrhea": ["787.91", "R19.7"],
    "rectal_bleeding": ["569.3", "578.1", "578.9", "569.12", "K62.5"],
}
STAY_TYPES = ["IP", "EI", "IS"]
INPATIENT_TYPES = ["IP", "EI"]
LAB_PATTERNS = {
    "hemoglobin": "%hemoglobin%",
    "platelet_count": "%platelet%count%",
    "leukocyte": "%leukocyte%",
    "albumin": "%albumin%",
    "calprotectin": "%calprotectin%",
    "ESR": "%erythrocyte%sedimentation%rate%",
    "CRP": "%c%reactive%protein%",
    "25_OH_VD": "%25%hydroxyvitamin%d3%",
    "neutrophil": "%neutrophil%",
    "monocyte": "%monocyte%",
    "lymphocyte": "%lymphocyte%",
    "basophil": "%basophil%",
    "eosinophil": "%eosinophil%",
}
LABS = list(LAB_PATTERNS)
LAB_DATES = {"lab_order_date": "order_days", "specimen_date": "specimen_days", "result_date": "result_days"}
LAB_OFFSETS = ["specimen_days", "result_days", "order_days"]
VITAL_UNITS = [UnitRule("HT", 39.37, unit_contains="in", above=20), UnitRule("WT", 2.20462, unit_contains="lb")]
VITAL_LIMITS = [PlausibleRule("HT", below=3), PlausibleRule("WT", below=200), PlausibleRule("BMI", below=60)]
LAB_UNITS = [UnitRule("CRP", 10, unit_equals="mg/L")]
LAB_LIMITS = [
    PlausibleRule("leukocyte", at_most=1000, not_units=("%",)),
    PlausibleRule("neutrophil", at_most=100, units=("%",)),
    PlausibleRule("monocyte", at_most=100, units=("%",)),
    PlausibleRule("lymphocyte", at_most=100, units=("%",)),
    PlausibleRule("eosinophil", at_most=100, units=("%",)),
    PlausibleRule("basophil", at_most=100, units=("%",)),
    PlausibleRule("hemoglobin", units=("g/dL", "OT")),
    PlausibleRule("platelet_count", units=("10*3/uL", "OT", "10*9/L", "g/L")),
    PlausibleRule("albumin", units=("g/dL",)),
]
LATEST_DAY = 30

# -- fixed values: analysis -------------------------------------------------------------------------
YEARS = (2010, 2020)
AGES = (4, 17)
OLDER_FROM = 12
FILLS = {"albumin": 4, "basophil": 1}
MODEL_VARIABLES = [
    "age_at_index", "sex", "race", "hispanic", "IP_IND1", "HT_Z", "WT_Z", "BMI_Z", "hemoglobin",
    "platelet_count", "leukocyte", "ESR", "CRP", "albumin", "basophil", "eosinophil", "neutrophil",
    "monocyte", "lymphocyte",
]
MODEL_FACTORS = {"sex": None, "race": "white", "hispanic": "non-hispanic", "IP_IND1": "0"}
IMPUTE_EXTRA = ["IP_IND2", "IP_IND3"]
IMPUTE_METHODS = {
    "HT_Z": "norm.predict", "WT_Z": "norm.predict", "BMI_Z": "norm.predict",
    "neutrophil": "norm.predict", "hemoglobin": "norm.predict",
    "platelet_count": "rf", "leukocyte": "rf", "ESR": "rf", "CRP": "rf", "eosinophil": "rf",
    "monocyte": "rf", "lymphocyte": "rf",
}
FLAG_VARIABLES = ["BMI_ind"] + [f"{lab}_ind" for lab in (
    "hemoglobin", "platelet_count", "leukocyte", "ESR", "CRP", "albumin", "25_OH_VD", "basophil",
    "eosinophil", "neutrophil", "monocyte", "lymphocyte")]
HAND_LOGISTIC = {"drop_pattern": "race|leukocyte|ESR", "force": ["race", "hemoglobin", "BMI_Z"]}
HAND_COX = {"drop_pattern": "race|leukocyte|basophil|ESR|HT_Z", "force": ["race"]}
SURVIVAL_DAYS = [365 * i for i in range(1, 11)]
IMPUTATIONS = 10
