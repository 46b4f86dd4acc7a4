"""Study concepts mapped onto the star-schema tables.

Customers are persons and their market segment is the site. Orders are coded diagnoses, order
lines are prescriptions, dispensings, administrations and procedures, parts are the drug
dictionary. The event log gives a second cohort with labs, vitals and stays near its index date.
The ``*_SQL`` strings define the same frames for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortloom.functions.predicates import code_matches, guarded_inclusion, starts_with_any
from cohortloom.functions.skew import BROADCAST_ROWS, fits, lookup_join, marked, matching
from cohortloom.functions.values import age_years, days_between, event_date, recode
from cohortloom.operators.codesets import DrugRule, build_drug_codeset, crosswalk_codes
from cohortloom.operators.cohort import apply_exclusion, exclusion_set, index_event
from cohortloom.operators.endpoints import (
    ActivitySource,
    censor_date,
    code_events,
    endpoint_stack,
    first_event_after_index,
)
from cohortloom.operators.timelines import (
    Transition,
    after_first_flags,
    composite_endpoint,
    escalation_outcome,
    first_nonnegative_event,
    index_to_first,
    pivot_endpoints,
    status_time,
    transition_times,
    with_sequence,
)
from cohortloom.session import materialize

KEYS = ["person_id"]
SITES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

RULES = [
    DrugRule("base_a", ("ring", "bolt"), (), ("SMALL",), ("DIUM",)),
    DrugRule("base_b", ("red", "blue"), ("plate", "rod"), ("STAND",), ("OMY",)),
    DrugRule("base_b", ("widget", "gear"), ("cold",), ("PROMO",)),
    DrugRule("step_1", ("anvil",), (), ("LARGE",), ("ARD",)),
    DrugRule("step_2", ("gizmo",), (), ("ECON",)),
]
PX_EXACT = ["7", "17", "544", "1033"]
PX_PREFIXES = ["12", "45"]
ENDPOINTS = ["base_a", "base_b", "step_1", "step_2", "surgery", "censor"]
TREATMENTS = ["standard", "step_1", "step_2", "surgery"]
LABELS = {"standard": "std", "step_1": "s1", "step_2": "s2", "surgery": "sur"}
#: Every treatment but the last, to every other later in severity.
TRANSITIONS = [Transition(f"time_{LABELS[a]}{'2' if a == 'standard' else '_'}{LABELS[b]}", a, ("base_a", "base_b") if a == "standard" else (a,), b)
               for a in ("standard", "step_2", "step_1") for b in ("step_2", "step_1", "surgery") if a != b]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One table; its schema is read from the file footers once, as from a table catalog."""
    path = f"{sf.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# -- order cohort ---------------------------------------------------------------------------------

def persons(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("site"),
        F.date_add(F.lit("1978-01-01").cast("date"), (F.col("c_custkey") % 3650).cast("int")).alias("birth_date"),
        F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("sex"),
        recode(F.col("c_nationkey").cast("string"), {"white": ["1", "2", "3", "4", "5", "6", "7", "8"],
                                                     "black": ["9", "10"]},
               "unk", "ot", missing_codes=["20", "21"]).alias("race"),
        F.round("c_acctbal", 0).alias("balance"))


def diagnoses(spark: SparkSession, sf: str) -> DataFrame:
    admit = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("person_id"),
        F.col("o_orderpriority").alias("code"), F.col("o_orderstatus").alias("enc_type"),
        admit.alias("admit_date"),
        F.when(F.col("o_orderkey") % 7 != 0,
               F.date_add(admit, (F.col("o_orderkey") % 3).cast("int"))).alias("dx_date"))


def included(spark: SparkSession, sf: str, date_guard: str = "as_written", slim: bool = False) -> DataFrame:
    """Persons with a first wanted diagnosis; ``slim`` leaves out the attributes that neither dates nor ages need."""
    dx = diagnoses(spark, sf).withColumn("index_date", event_date(F.col("dx_date"), F.col("admit_date")))
    wanted = dx.filter(starts_with_any(F.col("code"), ["1-", "2-"]))
    cond = guarded_inclusion(F.col("code"), ["1-"], ["2-"], F.col("dx_date") >= F.col("birth_date"), date_guard)
    if slim:
        out = index_event(wanted, persons(spark, sf).select(*KEYS, "birth_date"), KEYS, "index_date", cond, person_keep=["birth_date"])
    else:
        out = index_event(wanted, persons(spark, sf), KEYS, "index_date", cond, event_keep=["enc_type"],
                          tiebreak=["event_id"],
                          person_keep=["birth_date", "site", "sex", "race", "balance"])
    birth, at = F.col("birth_date"), F.col("index_date")
    return out.withColumns({"age": age_years(birth, at), "age_days": days_between(birth, at)})


def excluded(spark: SparkSession, sf: str) -> DataFrame:
    cond = (F.col("enc_type") == "P") & F.col("code").startswith("5-")
    return exclusion_set(diagnoses(spark, sf), cond, KEYS)


def cohort(spark: SparkSession, sf: str, slim: bool = False) -> DataFrame:
    return apply_exclusion(included(spark, sf, slim=slim), excluded(spark, sf), KEYS, F.col("age") < 18)


COHORT_SQL = """
persons AS (
  SELECT c_custkey AS person_id, c_mktsegment AS site,
         DATE '1978-01-01' + CAST(c_custkey % 3650 AS INTEGER) AS birth_date,
         CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
         CASE WHEN c_nationkey BETWEEN 1 AND 8 THEN 'white' WHEN c_nationkey IN (9, 10) THEN 'black'
              WHEN c_nationkey IN (20, 21) OR c_nationkey IS NULL THEN 'unk' ELSE 'ot' END AS race,
         round(c_acctbal) AS balance
  FROM customer),
dx AS (
  SELECT o_orderkey AS event_id, o_custkey AS person_id, o_orderpriority AS code,
         o_orderstatus AS enc_type, CAST(o_orderdate AS DATE) AS admit_date,
         CASE WHEN o_orderkey % 7 <> 0
              THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) END AS dx_date
  FROM orders),
included0 AS (
  SELECT d.person_id, p.site, p.birth_date, p.sex, p.race, p.balance, d.enc_type,
         coalesce(d.dx_date, d.admit_date) AS index_date,
         row_number() OVER (PARTITION BY d.person_id
                            ORDER BY coalesce(d.dx_date, d.admit_date), d.event_id) AS rn
  FROM dx d JOIN persons p ON d.person_id = p.person_id
  WHERE d.code LIKE '1-%' OR d.code LIKE '2-%' AND d.dx_date >= p.birth_date),
included AS (
  SELECT person_id, site, birth_date, sex, race, balance, enc_type, index_date,
         CAST(round(date_diff('day', birth_date, index_date) / 365.25) AS INTEGER) AS age,
         CAST(date_diff('day', birth_date, index_date) AS INTEGER) AS age_days
  FROM included0 WHERE rn = 1),
excluded AS (SELECT DISTINCT person_id FROM dx WHERE enc_type = 'P' AND code LIKE '5-%'),
cohort AS (
  SELECT i.* FROM included i
  WHERE i.age < 18 AND NOT EXISTS (SELECT 1 FROM excluded e WHERE e.person_id = i.person_id))
"""

# -- drugs and procedures -------------------------------------------------------------------------


def codeset(spark: SparkSession, sf: str) -> DataFrame:
    return build_drug_codeset(table(spark, sf, "part"), RULES, "p_name", "p_type",
                              ["p_partkey", "p_name", "p_type"])


def attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute table of the dictionary: kind, source and a code of another system."""
    return table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") % 2 == 0, "NDC").otherwise("NOTE").alias("atn"),
        F.when(F.col("p_size") % 3 != 0, "MAIN").otherwise("SIDE").alias("sab"),
        F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("atv"))


def crosswalk(spark: SparkSession, sf: str, copies: int = 1, codes: DataFrame | None = None) -> DataFrame:
    return crosswalk_codes(codeset(spark, sf) if codes is None else codes, attributes(spark, sf), "p_partkey",
                           {"atn": "NDC", "sab": "MAIN"}, "atv", "ndc",
                           ["therapy", "p_partkey", "p_name"], copies=copies)


CODESET_SQL = """
arms AS (
  SELECT DISTINCT 0 AS arm, p_partkey, p_name, p_type, 'base_a' AS therapy FROM part
  WHERE (lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%')
    AND (p_type LIKE 'SMALL%' OR p_type LIKE '%DIUM')
  UNION ALL
  SELECT DISTINCT 1, p_partkey, p_name, p_type, 'base_b' FROM part
  WHERE (lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%blue%')
    AND lower(p_name) NOT LIKE '%plate%' AND lower(p_name) NOT LIKE '%rod%'
    AND (p_type LIKE 'STAND%' OR p_type LIKE '%OMY')
  UNION ALL
  SELECT DISTINCT 2, p_partkey, p_name, p_type, 'base_b' FROM part
  WHERE (lower(p_name) LIKE '%widget%' OR lower(p_name) LIKE '%gear%')
    AND lower(p_name) NOT LIKE '%cold%' AND p_type LIKE 'PROMO%'
  UNION ALL
  SELECT DISTINCT 3, p_partkey, p_name, p_type, 'step_1' FROM part
  WHERE lower(p_name) LIKE '%anvil%' AND (p_type LIKE 'LARGE%' OR p_type LIKE '%ARD')
  UNION ALL
  SELECT DISTINCT 4, p_partkey, p_name, p_type, 'step_2' FROM part
  WHERE lower(p_name) LIKE '%gizmo%' AND p_type LIKE 'ECON%'),
codeset AS (SELECT p_partkey, p_name, p_type, therapy FROM arms),
crosswalk AS (
  SELECT DISTINCT c.therapy, c.p_partkey, c.p_name, 'N' || CAST(p.p_partkey AS VARCHAR) AS ndc
  FROM codeset c JOIN part p ON c.p_partkey = p.p_partkey
  WHERE p.p_size % 2 = 0 AND p.p_size % 3 <> 0)
"""


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
        F.to_date("l_shipdate").alias("ship"))


def placed_orders(spark: SparkSession, sf: str, who: DataFrame | None = None) -> DataFrame:
    """Orders with their person, of the given persons or of all.

    Persons that do not fit are told by the bits of their keys, where these have any, which moves no order: a few orders of
    others stay then, and what reads the result must join ``who`` too, as every endpoint does.
    """
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person_id"),
        F.to_date("o_orderdate").alias("ordered"))
    if who is None:
        return o
    who = who.select(*KEYS)
    if fits(who, BROADCAST_ROWS):
        return o.join(F.broadcast(who), KEYS, "left_semi")
    few = matching(o, who, KEYS)
    return o.join(who, KEYS, "left_semi") if few is o else few


def lines(spark: SparkSession, sf: str, who: DataFrame | None = None) -> DataFrame:
    """Order lines with their person, of the given persons or of all."""
    return lookup_join(order_lines(spark, sf), placed_orders(spark, sf, who), ["l_orderkey"], selective=who is not None)


def activity(spark: SparkSession, sf: str, who: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """The dates of the persons' prescriptions and procedures, written once, with the code where an endpoint may read it.

    A line is its order, kind, day and that code in the join to the orders; with the drug ``codes``, nearly all prescriptions of
    other parts lose theirs before it. A substitute date is written where it may be asked for.
    """
    flag, ship, part = F.col("l_returnflag"), F.col("ship"), F.col("l_partkey")
    kind = F.when(flag == "R", 0).when(F.col("l_linenumber") % 2 == 0, 1).otherwise(2).cast("byte")
    li = order_lines(spark, sf).filter(flag.isin("R", "A"))
    drug = F.lit(True)
    if codes is not None:
        parts, drug = codes.select(F.col("p_partkey").alias("l_partkey")), F.col("_drug")
        if fits(parts, BROADCAST_ROWS):
            li = li.join(F.broadcast(parts.distinct().withColumn("_drug", F.lit(True))), "l_partkey", "left")
        else:
            li = marked(li, parts, ["l_partkey"], "_drug")
    read = ((flag == "R") & drug & started().isNotNull()) | ((flag == "A") & is_surgery(part.cast("string")))
    li = li.select("l_orderkey", kind.alias("kind"), F.when(flag == "R", started()).otherwise(ship).alias("day"),
                   F.when(read, part).alias("l_partkey"))
    rows = lookup_join(li, placed_orders(spark, sf, who), ["l_orderkey"])
    rx, day, ordered = F.col("kind") == 0, F.col("day"), F.col("ordered")
    admit = F.when(F.col("kind") == 1, ordered)
    return materialize(rows.select(
        *KEYS, F.when(rx, "R").otherwise("A").alias("l_returnflag"), "l_partkey", F.when(rx, day).alias("start_date"),
        F.when(rx & day.isNull(), ordered).alias("order_date"), admit.alias("admit_date"),
        F.when(~rx & (admit.isNull() | F.col("l_partkey").isNotNull()), day).alias("px_date")))


def started():
    """Start of a prescription: the day its line was shipped, unknown for every fifth line."""
    return F.when(F.col("l_linenumber") % 5 != 0, F.col("ship"))


def is_surgery(px):
    return code_matches(px, PX_EXACT, PX_PREFIXES)


def prescribing(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Prescriptions among all order lines or those given; rows of ``activity`` have their dates already."""
    rows = lines(spark, sf) if rows is None else rows
    if "start_date" not in rows.columns:
        rows = rows.withColumns({"start_date": started(), "order_date": F.col("ordered")})
    return rows.filter("l_returnflag = 'R'").select("person_id", F.col("l_partkey").alias("code"), "start_date", "order_date")


def procedures(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Procedures among all order lines or those given, as ``prescribing``."""
    rows = lines(spark, sf) if rows is None else rows
    if "px_date" not in rows.columns:
        rows = rows.withColumns({"px_date": F.col("ship"), "admit_date": F.when(F.col("l_linenumber") % 2 == 0, F.col("ordered"))})
    return rows.filter("l_returnflag = 'A'").select("person_id", F.col("l_partkey").cast("string").alias("px"), "px_date", "admit_date")


EVENTS_SQL = """
lines AS (
  SELECT o.o_custkey AS person_id, l.l_partkey, l.l_linenumber, l.l_returnflag, l.l_linestatus,
         CAST(l.l_shipdate AS DATE) AS ship, CAST(o.o_orderdate AS DATE) AS ordered
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
prescribing AS (
  SELECT person_id, l_partkey AS code, CASE WHEN l_linenumber % 5 <> 0 THEN ship END AS start_date,
         ordered AS order_date FROM lines WHERE l_returnflag = 'R'),
dispensing AS (
  SELECT person_id, 'N' || CAST(l_partkey AS VARCHAR) AS ndc, ship AS dispense_date
  FROM lines WHERE l_returnflag = 'A'),
med_admin AS (
  SELECT person_id, CASE WHEN l_linestatus = 'O' THEN 'RX' ELSE 'ND' END AS kind,
         CASE WHEN l_linestatus = 'O' THEN CAST(l_partkey AS VARCHAR)
              ELSE 'N' || CAST(l_partkey AS VARCHAR) END AS code, ship AS start_date
  FROM lines WHERE l_returnflag = 'N'),
procedures AS (
  SELECT person_id, CAST(l_partkey AS VARCHAR) AS px, ship AS px_date,
         CASE WHEN l_linenumber % 2 = 0 THEN ordered END AS admit_date
  FROM lines WHERE l_returnflag = 'A')
"""

# -- endpoints ------------------------------------------------------------------------------------


def surgery(spark: SparkSession, sf: str, who: DataFrame, small: bool | None = None,
            rows: DataFrame | None = None) -> DataFrame:
    px = procedures(spark, sf, rows).filter(is_surgery(F.col("px")))
    return first_event_after_index(who, px, KEYS, "index_date", "px_date", small=small)


def first_prescriptions(spark: SparkSession, sf: str, who: DataFrame,
                        small: bool | None = None, codes: DataFrame | None = None,
                        rows: DataFrame | None = None) -> DataFrame:
    codes = codeset(spark, sf) if codes is None else codes
    rx = code_events(prescribing(spark, sf, rows), codes, "code", "p_partkey", "therapy")
    return first_event_after_index(who, rx, KEYS, "index_date", "start_date", ["therapy"], 30, small=small)


def censoring(spark: SparkSession, sf: str, who: DataFrame, small: bool | None = None,
              rows: DataFrame | None = None) -> DataFrame:
    rows = activity(spark, sf, who) if rows is None else rows
    small = fits(who.select(*KEYS, "index_date"), BROADCAST_ROWS) if small is None else small
    dx = diagnoses(spark, sf) if small else matching(diagnoses(spark, sf), who, KEYS)
    sources = [ActivitySource(dx, "admit_date", "dx_date"),
               ActivitySource(rows, "admit_date", "px_date"), ActivitySource(rows, "start_date", "order_date")]
    return censor_date(who, sources, KEYS, "index_date", small=small)


def stack(spark: SparkSession, sf: str, who: DataFrame | None = None) -> DataFrame:
    # the cohort feeds five joins, so it is persisted as a table first, as a study would
    who = materialize(cohort(spark, sf, True).select(*KEYS, "index_date")) if who is None else who
    small = fits(who, BROADCAST_ROWS)
    codes = materialize(codeset(spark, sf).select("p_partkey", "therapy"))
    # so do the cohort's lines: they are scanned and joined once, those that no endpoint reads not at all
    rows = activity(spark, sf, who, codes)
    return endpoint_stack({
        "surgery": (surgery(spark, sf, who, small, rows), "first_date", None),
        "drug": (first_prescriptions(spark, sf, who, small, codes, rows), "first_date", "therapy"),
        "censor": (censoring(spark, sf, who, small, rows), "censor_date", None),
    }, KEYS, "index_date")


STACK_SQL = """
ep_surgery AS (
  SELECT a.person_id, a.index_date, min(p.px_date) AS first_date
  FROM cohort a JOIN procedures p ON a.person_id = p.person_id
  WHERE (p.px IN ('7', '17', '544', '1033') OR p.px LIKE '12%' OR p.px LIKE '45%')
    AND p.px_date >= a.index_date
  GROUP BY 1, 2),
ep_rx AS (
  SELECT a.person_id, a.index_date, c.therapy, min(p.start_date) AS first_date
  FROM cohort a JOIN prescribing p ON a.person_id = p.person_id
  JOIN codeset c ON p.code = c.p_partkey
  WHERE p.start_date >= a.index_date - 30
  GROUP BY 1, 2, 3),
ep_censor AS (
  SELECT person_id, index_date, max(censor_date) AS censor_date FROM (
    SELECT a.person_id, a.index_date, coalesce(max(e.admit_date), max(e.dx_date)) AS censor_date
    FROM cohort a JOIN dx e ON a.person_id = e.person_id
    WHERE coalesce(e.admit_date, e.dx_date) >= a.index_date GROUP BY 1, 2
    UNION ALL
    SELECT a.person_id, a.index_date, coalesce(max(e.admit_date), max(e.px_date))
    FROM cohort a JOIN procedures e ON a.person_id = e.person_id
    WHERE coalesce(e.admit_date, e.px_date) >= a.index_date GROUP BY 1, 2
    UNION ALL
    SELECT a.person_id, a.index_date, coalesce(max(e.start_date), max(e.order_date))
    FROM cohort a JOIN prescribing e ON a.person_id = e.person_id
    WHERE coalesce(e.start_date, e.order_date) >= a.index_date GROUP BY 1, 2)
  GROUP BY 1, 2),
stack AS (
  SELECT person_id, index_date, 'surgery' AS endpoint, first_date AS endpoint_date,
         CAST(date_diff('day', index_date, first_date) AS INTEGER) AS days FROM ep_surgery
  UNION
  SELECT person_id, index_date, therapy, first_date,
         CAST(date_diff('day', index_date, first_date) AS INTEGER) FROM ep_rx
  UNION
  SELECT person_id, index_date, 'censor', censor_date,
         CAST(date_diff('day', index_date, censor_date) AS INTEGER) FROM ep_censor)
"""

# -- timelines ------------------------------------------------------------------------------------


def wide(spark: SparkSession, sf: str, who: DataFrame | None = None) -> DataFrame:
    firsts = first_nonnegative_event(stack(spark, sf, who), KEYS)
    return composite_endpoint(pivot_endpoints(firsts, KEYS, ENDPOINTS), "standard", ["base_a", "base_b"])


def timeline(spark: SparkSession, sf: str, who: DataFrame | None = None) -> DataFrame:
    """Wide endpoints with order, status and time columns, transitions and the outcome."""
    w = wide(spark, sf, who)
    seq = after_first_flags(with_sequence(w, TREATMENTS), {
        "surgery_after": "surgery", "step_1_after": "step_1", "step_2_after": "step_2"})
    out = status_time(seq, ENDPOINTS[:-1])
    out = transition_times(out, TRANSITIONS)
    return escalation_outcome(index_to_first(out, ["base_a", "base_b"]), "surgery", ["step_1", "step_2"])


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Persons who began with the standard treatment, with their outcome and covariates."""
    people = materialize(cohort(spark, sf).select(*KEYS, "site", "sex", "race", "age", "balance", "index_date"))
    kept = timeline(spark, sf, people.select(*KEYS, "index_date")).filter((F.col("trt1") == "standard") & (F.col("time6") >= 0))
    return people.join(kept, KEYS).withColumn("index_year", F.year("index_date"))


TIMELINE_SQL = """
wide0 AS (
  SELECT person_id,
         min(CASE WHEN endpoint = 'base_a' THEN days END) AS base_a,
         min(CASE WHEN endpoint = 'base_b' THEN days END) AS base_b,
         min(CASE WHEN endpoint = 'step_1' THEN days END) AS step_1,
         min(CASE WHEN endpoint = 'step_2' THEN days END) AS step_2,
         min(CASE WHEN endpoint = 'surgery' THEN days END) AS surgery,
         min(CASE WHEN endpoint = 'censor' THEN days END) AS censor
  FROM stack WHERE days >= 0 GROUP BY 1),
wide AS (SELECT *, least(base_a, base_b) AS standard FROM wide0 WHERE censor IS NOT NULL),
ordered AS (
  SELECT person_id, name, row_number() OVER (PARTITION BY person_id ORDER BY val, pos) AS ord
  FROM (SELECT person_id, 'standard' AS name, 1 AS pos, standard AS val FROM wide
        UNION ALL SELECT person_id, 'step_1', 2, step_1 FROM wide
        UNION ALL SELECT person_id, 'step_2', 3, step_2 FROM wide
        UNION ALL SELECT person_id, 'surgery', 4, surgery FROM wide)
  WHERE val IS NOT NULL),
seq AS (
  SELECT person_id, max(CASE WHEN ord = 1 THEN name END) AS trt1,
         max(CASE WHEN ord = 2 THEN name END) AS trt2,
         max(CASE WHEN ord = 3 THEN name END) AS trt3,
         max(CASE WHEN ord = 4 THEN name END) AS trt4
  FROM ordered GROUP BY 1),
st AS (
  SELECT w.*, s.trt1, s.trt2, s.trt3, s.trt4,
         CAST(base_a IS NOT NULL AS INTEGER) AS status_base_a, coalesce(base_a, censor) AS time_base_a,
         CAST(base_b IS NOT NULL AS INTEGER) AS status_base_b, coalesce(base_b, censor) AS time_base_b,
         CAST(step_1 IS NOT NULL AS INTEGER) AS status_step_1, coalesce(step_1, censor) AS time_step_1,
         CAST(step_2 IS NOT NULL AS INTEGER) AS status_step_2, coalesce(step_2, censor) AS time_step_2,
         CAST(surgery IS NOT NULL AS INTEGER) AS status_surgery, coalesce(surgery, censor) AS time_surgery
  FROM wide w LEFT JOIN seq s ON w.person_id = s.person_id),
outcome0 AS (
  SELECT *, CASE WHEN trt1 = 'standard' THEN least(time_base_a, time_base_b) ELSE 0 END AS time_idx2std,
         CAST(trt1 = 'standard' AND status_surgery + status_step_1 + status_step_2 > 0 AS INTEGER) AS status6,
         CAST(trt1 = 'standard' AND status_surgery > 0 AS INTEGER) AS status6_col,
         CAST(trt1 = 'standard' AND status_step_1 + status_step_2 > 0 AS INTEGER) AS status_bio_imm
  FROM st),
timeline AS (
  SELECT *, CASE WHEN status6 = 1 THEN least(time_surgery, time_step_1, time_step_2) - time_idx2std
                 ELSE censor - time_idx2std END AS time6
  FROM outcome0),
outcomes AS (
  SELECT t.*, c.site, c.sex, c.race, c.age, c.balance, c.index_date,
         CAST(year(c.index_date) AS INTEGER) AS index_year
  FROM timeline t JOIN cohort c ON t.person_id = c.person_id
  WHERE t.trt1 = 'standard' AND t.time6 >= 0)
"""


def sql(select: str, *parts: str) -> str:
    """A statement over the named definitions above, in dependency order."""
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts) + "\n" + select


def sql_cohort(select: str, *more: str) -> str:
    return sql(select, COHORT_SQL, *more)


def sql_stack(select: str, *more: str) -> str:
    return sql(select, COHORT_SQL, CODESET_SQL, EVENTS_SQL, STACK_SQL, *more)


def sql_timeline(select: str, *more: str) -> str:
    return sql_stack(select, TIMELINE_SQL, *more)


# -- event-log cohort -----------------------------------------------------------------------------


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("person_id"), "event_type", "value",
        F.to_date("ts").alias("day"),
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"))


def visitors(spark: SparkSession, sf: str) -> DataFrame:
    """Second cohort: first late sign-up per user, with age and sex."""
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("site"),
        F.date_add(F.lit("2008-01-01").cast("date"),
                   ((F.col("c_custkey") * 37) % 4000).cast("int")).alias("birth_date"),
        F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("sex"))
    ev = log(spark, sf).filter((F.col("event_type") == "signup") & (F.col("k") >= 50)).select(
        "person_id", F.col("day").alias("index_date"), "event_id",
        stay_type(F.col("k")).alias("enc_type"))
    out = index_event(ev, people, KEYS, "index_date", F.lit(True), ["enc_type"], ["event_id"],
                      ["site", "birth_date", "sex"])
    return out.withColumn("age_days", days_between(F.col("birth_date"), F.col("index_date")))


def stay_type(k):
    return F.element_at(F.array(*[F.lit(x) for x in ("IP", "EI", "IS", "AV", "ED")]), (k % 5 + 1))


LOG_SQL = r"""
log AS (
  SELECT event_id, user_id AS person_id, event_type, value, CAST(ts AS DATE) AS day,
         CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k FROM events),
visitors0 AS (
  SELECT l.person_id, l.day AS index_date, c.c_mktsegment AS site,
         ['IP', 'EI', 'IS', 'AV', 'ED'][l.k % 5 + 1] AS enc_type,
         DATE '2008-01-01' + CAST((c.c_custkey * 37) % 4000 AS INTEGER) AS birth_date,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
         row_number() OVER (PARTITION BY l.person_id ORDER BY l.day, l.event_id) AS rn
  FROM log l JOIN customer c ON l.person_id = c.c_custkey
  WHERE l.event_type = 'signup' AND l.k >= 50),
visitors AS (
  SELECT person_id, index_date, site, enc_type, birth_date, sex,
         CAST(date_diff('day', birth_date, index_date) AS INTEGER) AS age_days
  FROM visitors0 WHERE rn = 1)
"""
