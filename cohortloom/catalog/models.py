"""Imputation, regression and pooling on customers and on the escalation outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog import query, star
from cohortloom.catalog.newton_sql import aic_walk, cox_subsets, logistic_subsets, pooled
from cohortloom.catalog.star import sql, sql_timeline, table
from cohortloom.operators import models as M
from cohortloom.operators.cox import fit_cox
from cohortloom.operators.design import dummy_code, fill_constants, select_terms
from cohortloom.operators.impute import complete_long, mice_impute
from cohortloom.operators.pooling import paired_table, result_table, rubin_pool
from cohortloom.operators.stepwise import selection_path, stepwise_cox, stepwise_logistic
from cohortloom.operators.summaries import imputation_check
from cohortloom.session import materialize

IMPS = [1, 2, 3]


@query("fill_constants", """
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 4) AS albumin,
       coalesce(CASE WHEN c_nationkey > 12 THEN c_nationkey END, 1) AS basophil FROM customer""")
def q_fill_constants(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("albumin"),
        F.when(F.col("c_nationkey") > 12, F.col("c_nationkey")).alias("basophil"))
    return fill_constants(c, {"albumin": 4, "basophil": 1})


@query("dummy_code", star.sql("""
SELECT person_id, CAST(race = 'black' AS DOUBLE) AS raceblack, CAST(race = 'ot' AS DOUBLE) AS raceot,
       CAST(race = 'unk' AS DOUBLE) AS raceunk, CAST(sex = 'M' AS DOUBLE) AS sexM FROM persons""", star.COHORT_SQL))
def q_dummy_code(spark, sf):
    coded, terms = dummy_code(star.persons(spark, sf), {"race": "white", "sex": "F"})
    return coded.select("person_id", *terms["race"], *terms["sex"])


# -- logistic models: three stacked data sets that differ in one regressor ---------------------------

SITES = star.SITES


def _stacked(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("site"),
        (F.col("c_custkey") % 2).cast("double").alias("odd"), F.col("c_acctbal").alias("balance"),
        F.explode(F.array(*[F.lit(i) for i in IMPS])).alias("imp"))
    high = (table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("person_id"))
            .agg((F.max("o_totalprice") > 450000).cast("double").alias("y"),
                 F.count_if(F.col("o_orderpriority").startswith("1-")).cast("double").alias("urgent")))
    return c.join(high, "person_id").withColumns({
        "rich": (F.col("balance") > 1000 * F.col("imp")).cast("double"),
        "balance": F.col("balance") / 1000})


STACKED_SQL = """
high AS (SELECT o_custkey AS person_id, CAST(max(o_totalprice) > 450000 AS INTEGER) AS y FROM orders GROUP BY 1),
stacked AS (
  SELECT c.c_custkey AS person_id, c.c_mktsegment AS site, c.c_custkey % 2 AS odd, i.imp, h.y,
         CAST(c.c_acctbal > 1000 * i.imp AS INTEGER) AS rich
  FROM customer c JOIN high h ON h.person_id = c.c_custkey, (VALUES (1), (2), (3)) i(imp)),
tab AS (
  SELECT imp, term, CAST(count(*) FILTER (x = 1 AND y = 1) AS DOUBLE) AS a,
         CAST(count(*) FILTER (x = 1 AND y = 0) AS DOUBLE) AS b,
         CAST(count(*) FILTER (x = 0 AND y = 1) AS DOUBLE) AS c,
         CAST(count(*) FILTER (x = 0 AND y = 0) AS DOUBLE) AS d
  FROM (SELECT imp, 'odd' AS term, odd AS x, y FROM stacked UNION ALL SELECT imp, 'rich', rich, y FROM stacked)
  GROUP BY 1, 2),
uni AS (SELECT imp, term, ln(a * d / (b * c)) AS estimate, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS std_error FROM tab)
"""


def _univariate(spark, sf):
    fits = M.fit_logistic(_stacked(spark, sf), "y", M.univariate_specs({"odd": ["odd"], "rich": ["rich"]}, IMPS), "imp")
    return fits


@query("logistic_univariate", sql("""
SELECT CAST(imp AS INTEGER) AS imp, term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error,
       round(exp(estimate), 6) AS exp_estimate FROM uni""", STACKED_SQL))
def q_logistic_univariate(spark, sf):
    return M.coefficients(spark, _univariate(spark, sf)).select(
        "imp", "term", *[F.round(c, 6).alias(c) for c in ("estimate", "std_error", "exp_estimate")])


IRLS_SQL = """
points AS (SELECT s.imp, s.y, c.c_acctbal / 1000 AS x FROM stacked s JOIN customer c ON c.c_custkey = s.person_id),
irls(imp, i, b0, b1, v1) AS (
  SELECT DISTINCT imp, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM points
  UNION ALL
  SELECT imp, i + 1, b0 + (sxx * g0 - sx * g1) / (s * sxx - sx * sx), b1 + (s * g1 - sx * g0) / (s * sxx - sx * sx),
         s / (s * sxx - sx * sx)
  FROM (SELECT imp, i, b0, b1, sum(p * (1 - p)) AS s, sum(p * (1 - p) * x) AS sx, sum(p * (1 - p) * x * x) AS sxx,
               sum(y - p) AS g0, sum((y - p) * x) AS g1
        FROM (SELECT r.imp, r.i, r.b0, r.b1, q.x, q.y, 1 / (1 + exp(-(r.b0 + r.b1 * q.x))) AS p
              FROM irls r JOIN points q ON q.imp = r.imp WHERE r.i < 12) GROUP BY imp, i, b0, b1))
"""


@query("logistic_continuous", sql("""
SELECT CAST(imp AS INTEGER) AS imp, 'balance' AS term, round(b1, 6) AS estimate, round(sqrt(v1), 6) AS std_error FROM irls WHERE i = 12
""", STACKED_SQL, IRLS_SQL))
def q_logistic_continuous(spark, sf):
    specs = [M.ModelSpec("balance", ("balance",), i) for i in IMPS]
    return M.coefficients(spark, M.fit_logistic(_stacked(spark, sf), "y", specs, "imp")).select(
        "imp", "term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


FACTOR_SQL = """
cell AS (SELECT imp, site, CAST(sum(y) AS DOUBLE) AS a, CAST(count(*) - sum(y) AS DOUBLE) AS b
         FROM stacked GROUP BY 1, 2)
"""


@query("logistic_factor_model", sql("""
SELECT CAST(c.imp AS INTEGER) AS imp, 'site' || c.site AS term, round(ln(c.a / c.b) - ln(r.a / r.b), 6) AS estimate,
       round(sqrt(1 / c.a + 1 / c.b + 1 / r.a + 1 / r.b), 6) AS std_error
FROM cell c JOIN cell r ON r.imp = c.imp AND r.site = 'BUILDING' WHERE c.site <> 'BUILDING'
UNION ALL SELECT CAST(imp AS INTEGER), '(Intercept)', round(ln(a / b), 6), round(sqrt(1 / a + 1 / b), 6)
FROM cell WHERE site = 'BUILDING'""", STACKED_SQL, FACTOR_SQL))
def q_logistic_factor_model(spark, sf):
    coded, terms = dummy_code(_stacked(spark, sf), {"site": "BUILDING"}, {"site": SITES})
    fits = M.fit_logistic(coded, "y", M.joint_specs("site", terms, IMPS), "imp")
    return M.coefficients(spark, fits, intercept=True).select(
        "imp", "term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


def _full(spark, sf):
    coded, terms = dummy_code(_stacked(spark, sf), {"site": "BUILDING"}, {"site": SITES})
    return coded, {"odd": ["odd"], "rich": ["rich"], "balance": ["balance"], "urgent": ["urgent"], **terms}


FULL_COLUMNS = ["(Intercept)", "odd", "rich", "balance", "urgent", *[f"site{s}" for s in SITES if s != "BUILDING"]]
FULL_TERMS = {"odd": [1], "rich": [2], "balance": [3], "urgent": [4], "site": [5, 6, 7, 8]}
FULL_SQL = f"""
urgent AS (SELECT o_custkey AS person_id, count(*) FILTER (o_orderpriority LIKE '1-%') AS urgent FROM orders GROUP BY 1),
wide_points AS (
  SELECT s.imp, CAST(s.y AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS x0, CAST(s.odd AS DOUBLE) AS x1, CAST(s.rich AS DOUBLE) AS x2,
         c.c_acctbal / 1000 AS x3, CAST(u.urgent AS DOUBLE) AS x4,
         {', '.join(f"CAST(s.site = '{n[4:]}' AS DOUBLE) AS x{j}" for j, n in enumerate(FULL_COLUMNS) if j > 4)}
  FROM stacked s JOIN customer c ON c.c_custkey = s.person_id JOIN urgent u ON u.person_id = s.person_id),
column_names(place, term) AS (VALUES {', '.join(f"({j}, '{n}')" for j, n in enumerate(FULL_COLUMNS))})
"""
FULL_FITS = logistic_subsets("wide_points", list(FULL_TERMS.values()), len(FULL_COLUMNS))
ALL_TERMS = (1 << len(FULL_TERMS)) - 1


def _estimates(spark, fits):
    return M.coefficients(spark, fits).select(
        "imp", "term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


@query("logistic_full_model", sql(f"""
SELECT CAST(f.imp AS INTEGER) AS imp, n.term, round(f.b, 6) AS estimate, round(f.se, 6) AS std_error
FROM fitted f JOIN column_names n ON n.place = f.place WHERE f.mask = {ALL_TERMS} AND f.place > 0
""", STACKED_SQL, FULL_SQL, FULL_FITS))
def q_logistic_full_model(spark, sf):
    coded, terms = _full(spark, sf)
    return _estimates(spark, M.fit_logistic(coded, "y", M.joint_specs("full", terms, IMPS), "imp"))


@query("stepwise_logistic", sql("""
SELECT CAST(imp AS INTEGER) AS imp, CAST(step AS INTEGER) AS step, action, round(aic, 4) AS aic FROM walk
""", STACKED_SQL, FULL_SQL, FULL_FITS, aic_walk(list(FULL_TERMS))))
def q_stepwise_logistic(spark, sf):
    coded, terms = _full(spark, sf)
    path = selection_path(spark, stepwise_logistic(coded, "y", terms, "imp", IMPS))
    return path.withColumn("aic", F.round("aic", 4))


def _hand_picked(coded, terms, selections, drop, force, fit):
    specs = []
    for s in selections:
        names = select_terms(s.variables, drop, force)
        specs.append(M.ModelSpec("manual", tuple(c for v in names for c in terms[v]), s.imp))
    return fit(specs)


@query("hand_selected_logistic", sql("""
SELECT CAST(f.imp AS INTEGER) AS imp, n.term, round(f.b, 6) AS estimate, round(f.se, 6) AS std_error
FROM (SELECT imp, arg_max(mask, step) AS mask FROM walk GROUP BY 1) w
JOIN fitted f ON f.imp = w.imp AND f.mask = ((w.mask & 11) | 3) JOIN column_names n ON n.place = f.place
WHERE f.place > 0""", STACKED_SQL, FULL_SQL, FULL_FITS, aic_walk(list(FULL_TERMS))))
def q_hand_selected_logistic(spark, sf):
    coded, terms = _full(spark, sf)
    coded = materialize(coded)
    picked = stepwise_logistic(coded, "y", terms, "imp", IMPS)
    return _estimates(spark, _hand_picked(coded, terms, picked, "site|balance", ["odd", "rich"],
                                          lambda specs: M.fit_logistic(coded, "y", specs, "imp")))


@query("linear_fit", """
SELECT 'price' AS model, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def q_linear_fit(spark, sf):
    fit = M.fit_linear(table(spark, sf, "lineitem"), "l_extendedprice", [M.ModelSpec("price", ("l_quantity",))])
    return M.coefficients(spark, fit, intercept=True).groupBy(F.col("model_id").alias("model")).agg(
        F.round(F.max(F.when(F.col("term") == "l_quantity", F.col("estimate"))), 4).alias("slope"),
        F.round(F.max(F.when(F.col("term") == "(Intercept)", F.col("estimate"))), 4).alias("intercept"))


# -- proportional hazards ---------------------------------------------------------------------------

COX_SQL = """
surv AS (SELECT time6 AS t, status6 AS s, CAST(sex = 'M' AS INTEGER) AS x FROM outcomes),
surv_day AS (
  SELECT t, count(*) FILTER (x = 0) AS n0, count(*) FILTER (x = 1) AS n1,
         count(*) FILTER (x = 0 AND s = 1) AS d0, count(*) FILTER (x = 1 AND s = 1) AS d1 FROM surv GROUP BY 1),
risk AS (
  SELECT t, d0, d1, CAST(sum(n0) OVER (ORDER BY t DESC) AS DOUBLE) AS r0,
         CAST(sum(n1) OVER (ORDER BY t DESC) AS DOUBLE) AS r1 FROM surv_day),
ties AS (SELECT r0, r1, d0, d1, r / (d0 + d1) AS f
         FROM (SELECT *, unnest(range(d0 + d1)) AS r FROM risk WHERE d0 + d1 > 0)),
newton(i, b, se) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT i + 1, b + ((SELECT sum(d1) FROM risk) - sum(p)) / sum(p * (1 - p)), 1 / sqrt(sum(p * (1 - p)))
  FROM (SELECT n.i, n.b, (t.r1 - t.f * t.d1) * exp(n.b)
                         / (t.r0 - t.f * t.d0 + (t.r1 - t.f * t.d1) * exp(n.b)) AS p
        FROM newton n, ties t WHERE n.i < 15)
  GROUP BY i, b)
"""


@query("cox_univariate", sql_timeline("""
SELECT 'male' AS term, round(b, 6) AS estimate, round(se, 6) AS std_error FROM newton WHERE i = 15""", COX_SQL))
def q_cox_univariate(spark, sf):
    df = star.outcomes(spark, sf).withColumn("male", (F.col("sex") == "M").cast("double"))
    fits = fit_cox(df, "time6", "status6", [M.ModelSpec("male", ("male",))])
    return M.coefficients(spark, fits).select(
        "term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


def _cox_frame(spark, sf):
    """Outcome rows in three stacked data sets that differ in one regressor."""
    rows = star.outcomes(spark, sf).select(
        "person_id", "time6", "status6", "sex", "race", F.col("age").cast("double").alias("age"),
        F.explode(F.array(*[F.lit(i) for i in IMPS])).alias("imp"), "balance")
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.count(F.lit(1)).cast("double").alias("orders"))
    rows = rows.join(orders, "person_id").withColumn(
        "rich", (F.col("balance") > 1000 * F.col("imp")).cast("double"))
    coded, factors = dummy_code(materialize(rows), {"sex": "F", "race": "white"},
                                {"sex": ["F", "M"], "race": ["black", "ot", "unk", "white"]})
    return coded, {"age": ["age"], "rich": ["rich"], "orders": ["orders"], **factors}


COX_COLUMNS = ["age", "rich", "orders", "sexM", "raceblack", "raceot", "raceunk"]
COX_TERMS = {"age": [0], "rich": [1], "orders": [2], "sex": [3], "race": [4, 5, 6]}
COX_POINTS_SQL = f"""
cox_points AS (
  SELECT i.imp, r.time6 AS t, r.status6 AS s, CAST(r.age AS DOUBLE) AS x0, CAST(r.balance > 1000 * i.imp AS DOUBLE) AS x1,
         CAST(n.orders AS DOUBLE) AS x2, CAST(r.sex = 'M' AS DOUBLE) AS x3, CAST(r.race = 'black' AS DOUBLE) AS x4,
         CAST(r.race = 'ot' AS DOUBLE) AS x5, CAST(r.race = 'unk' AS DOUBLE) AS x6
  FROM outcomes r JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) n ON n.o_custkey = r.person_id,
       (VALUES (1), (2), (3)) i(imp)),
column_names(place, term) AS (VALUES {', '.join(f"({j}, '{n}')" for j, n in enumerate(COX_COLUMNS))})
"""
COX_FITS = cox_subsets("cox_points", list(COX_TERMS.values()), len(COX_COLUMNS))


@query("cox_full_model", sql_timeline("""
SELECT CAST(f.imp AS INTEGER) AS imp, n.term, round(f.b, 6) AS estimate, round(f.se, 6) AS std_error
FROM fitted f JOIN column_names n ON n.place = f.place WHERE f.mask = 31""", COX_POINTS_SQL, COX_FITS))
def q_cox_full_model(spark, sf):
    coded, terms = _cox_frame(spark, sf)
    return _estimates(spark, fit_cox(coded, "time6", "status6", M.joint_specs("full", terms, IMPS), "imp"))


@query("stepwise_cox", sql_timeline("""
SELECT CAST(imp AS INTEGER) AS imp, CAST(step AS INTEGER) AS step, action, round(aic, 4) AS aic FROM walk
""", COX_POINTS_SQL, COX_FITS, aic_walk(list(COX_TERMS))))
def q_stepwise_cox(spark, sf):
    coded, terms = _cox_frame(spark, sf)
    return selection_path(spark, stepwise_cox(coded, "time6", "status6", terms, "imp", IMPS)).withColumn("aic", F.round("aic", 4))


@query("hand_selected_cox", sql_timeline("""
SELECT CAST(f.imp AS INTEGER) AS imp, n.term, round(f.b, 6) AS estimate, round(f.se, 6) AS std_error
FROM (SELECT imp, arg_max(mask, step) AS mask FROM walk GROUP BY 1) w
JOIN fitted f ON f.imp = w.imp AND f.mask = ((w.mask & 14) | 16) JOIN column_names n ON n.place = f.place
""", COX_POINTS_SQL, COX_FITS, aic_walk(list(COX_TERMS))))
def q_hand_selected_cox(spark, sf):
    coded, terms = _cox_frame(spark, sf)
    picked = stepwise_cox(coded, "time6", "status6", terms, "imp", IMPS)
    return _estimates(spark, _hand_picked(coded, terms, picked, "age|race", ["race"],
                                          lambda specs: fit_cox(coded, "time6", "status6", specs, "imp")))


# -- pooling ----------------------------------------------------------------------------------------

POOL_SQL = """
pool0 AS (
  SELECT term, avg(estimate) AS est, var_samp(estimate) AS vb, avg(std_error * std_error) AS vw,
         (SELECT count(*) FROM high) - 2 AS dof FROM uni GROUP BY 1),
pool AS (SELECT *, vw + vb + vb / 3 AS vt, (vb + vb / 3) / (vw + vb + vb / 3) AS lam FROM pool0),
pool2 AS (SELECT *, CASE WHEN lam > 1e-20 THEN 2 / (lam * lam) END AS df_old,
                 ((dof + 1) / (dof + 3)) * dof * (1 - lam) AS df_obs FROM pool)
"""


@query("rubin_pool", sql("""
SELECT term, round(est, 6) AS estimate, round(vw, 8) AS var_within, round(vb, 8) AS var_between,
       round(vt, 8) AS var_total, round(lam, 6) AS "lambda", round(df_obs, 4) AS df_obs,
       round(CASE WHEN df_old IS NULL THEN df_obs ELSE 1 / (1 / df_old + 1 / df_obs) END, 4) AS df_adj,
       round(est / sqrt(vt), 6) AS wald, round(exp(est), 6) AS ratio FROM pool2""", STACKED_SQL, POOL_SQL))
def q_rubin_pool(spark, sf):
    n = table(spark, sf, "orders").agg(F.countDistinct("o_custkey")).first()[0]
    out = rubin_pool(M.coefficients(spark, _univariate(spark, sf)), n, 3)
    digits = {"estimate": 6, "var_within": 8, "var_between": 8, "var_total": 8, "lambda": 6, "df_obs": 4,
              "df_adj": 4, "wald": 6, "ratio": 6}
    return out.select("term", *[F.round(c, d).alias(c) for c, d in digits.items()])


ODDS_POINTS_SQL = """
odds_points AS (SELECT imp, CAST(s AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS x0, x0 AS x1, x1 AS x2, x2 AS x3, x3 AS x4, x4 AS x5,
                       x5 AS x6, x6 AS x7 FROM cox_points)
"""
ODDS_FITS = logistic_subsets("odds_points", [[c + 1 for c in cs] for cs in COX_TERMS.values()], len(COX_COLUMNS) + 1, name="odds_")
ONE_SET = "SELECT count(*) FROM cox_points WHERE imp = 1"


def _sql_pooled(masks: str) -> tuple[str, ...]:
    """Pooled odds and hazards of the models whose ``mask`` is asked for."""
    odds = f"SELECT n.term, f.b, f.se FROM odds_fitted f JOIN column_names n ON n.place + 1 = f.place WHERE f.place > 0 AND f.mask IN ({masks})"
    hazards = f"SELECT n.term, f.b, f.se FROM fitted f JOIN column_names n ON n.place = f.place WHERE f.mask IN ({masks})"
    return (COX_POINTS_SQL, COX_FITS, ODDS_POINTS_SQL, ODDS_FITS, pooled(odds, ONE_SET, len(IMPS), "odds_"), pooled(hazards, ONE_SET, len(IMPS), "hazards_"))


def _sql_ratio(name: str, table: str) -> str:
    return (f"round_even({table}.ratio, 3) AS \"{name}\", round({table}.lower, 4) AS {name}_ci_lower, round({table}.upper, 4) AS {name}_ci_upper, "
            f"round({table}.p, 6) AS pval_{name}, true AS converged_{name}")


PAIRED_SQL = f"""
SELECT o.term, {_sql_ratio('OR', 'o')}, {_sql_ratio('HR', 'h')} FROM odds_pooled o LEFT JOIN hazards_pooled h ON h.term = o.term"""


def _rounded(table):
    """Intervals and p-values to the digits that are compared."""
    digits = {c: 4 if "_ci_" in c else 6 for c in table.columns if "_ci_" in c or c.startswith("pval_")}
    return table.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _pooled_pair(spark, sf, specs_of):
    coded, terms = _cox_frame(spark, sf)
    coded = materialize(coded)
    n = coded.filter("imp = 1").count()
    specs = specs_of(terms)
    odds = M.coefficients(spark, M.fit_logistic(coded, "status6", specs, "imp"))
    hazards = M.coefficients(spark, fit_cox(coded, "time6", "status6", specs, "imp"))
    return _rounded(paired_table(rubin_pool(odds, n, len(IMPS)), rubin_pool(hazards, n, len(IMPS))))


@query("pooled_univariate_table", sql_timeline(PAIRED_SQL, *_sql_pooled("1, 2, 4, 8, 16")))
def q_pooled_univariate_table(spark, sf):
    """Odds and hazard ratios of every single-variable model, pooled over the data sets."""
    return _pooled_pair(spark, sf, lambda terms: M.univariate_specs(terms, IMPS))


@query("pooled_full_tables", sql_timeline(PAIRED_SQL, *_sql_pooled("31")))
def q_pooled_full_tables(spark, sf):
    """Pooled full logistic and Cox models of the outcome."""
    return _pooled_pair(spark, sf, lambda terms: M.joint_specs("full", terms, IMPS))


@query("pooled_selected_table", sql(f"""
SELECT term, {_sql_ratio('OR', 'p')} FROM odds_pooled p""", STACKED_SQL, FULL_SQL, FULL_FITS, aic_walk(list(FULL_TERMS)),
    pooled("""SELECT n.term, f.b, f.se FROM (SELECT imp, arg_max(mask, step) AS mask FROM walk GROUP BY 1) w
              JOIN fitted f ON f.imp = w.imp AND f.mask = w.mask JOIN column_names n ON n.place = f.place WHERE f.place > 0""",
           "SELECT count(*) FROM wide_points WHERE imp = 1", len(IMPS), "odds_")))
def q_pooled_selected_table(spark, sf):
    """Pooled coefficients of the stepwise logistic models."""
    coded, terms = _full(spark, sf)
    coded = materialize(coded)
    n = coded.filter("imp = 1").count()
    fits = [s.fit for s in stepwise_logistic(coded, "y", terms, "imp", IMPS)]
    return _rounded(result_table(rubin_pool(M.coefficients(spark, fits), n, len(IMPS)), "OR"))


COX_CHOSEN = "(SELECT imp, arg_max(mask, step) AS mask FROM walk GROUP BY 1) w JOIN fitted f ON f.imp = w.imp"


def _sql_pooled_hazards(chosen: str) -> tuple[str, ...]:
    """Pooled hazards of each data set's selected model, its mask as ``chosen``."""
    rows = f"SELECT n.term, f.b, f.se FROM {COX_CHOSEN} AND f.mask = {chosen} JOIN column_names n ON n.place = f.place"
    return (COX_POINTS_SQL, COX_FITS, aic_walk(list(COX_TERMS)), pooled(rows, ONE_SET, len(IMPS), "hazards_"))


def _pooled_hazards(spark, sf, choose):
    coded, terms = _cox_frame(spark, sf)
    coded = materialize(coded)
    fits = choose(coded, terms, stepwise_cox(coded, "time6", "status6", terms, "imp", IMPS))
    return _rounded(result_table(rubin_pool(M.coefficients(spark, fits), coded.filter("imp = 1").count(), len(IMPS)), "HR"))


@query("pooled_selected_cox_table", sql_timeline(f"""
SELECT term, {_sql_ratio('HR', 'p')} FROM hazards_pooled p""", *_sql_pooled_hazards("w.mask")))
def q_pooled_selected_cox_table(spark, sf):
    """Pooled coefficients of the stepwise Cox models."""
    return _pooled_hazards(spark, sf, lambda coded, terms, picked: [s.fit for s in picked])


@query("pooled_hand_selected_cox_table", sql_timeline(f"""
SELECT term, {_sql_ratio('HR', 'p')} FROM hazards_pooled p""", *_sql_pooled_hazards("((w.mask & 14) | 16)")))
def q_pooled_hand_selected_cox_table(spark, sf):
    """Pooled coefficients of the hand-selected Cox models."""
    def choose(coded, terms, picked):
        return _hand_picked(coded, terms, picked, "age|race", ["race"], lambda specs: fit_cox(coded, "time6", "status6", specs, "imp"))

    return _pooled_hazards(spark, sf, choose)


# -- imputation -------------------------------------------------------------------------------------


def _incomplete(spark, sf):
    """Parts with gaps in the price: every fifth key lacks it."""
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("size"),
        F.length("p_name").cast("double").alias("len"),
        F.when(F.col("p_partkey") % 5 != 0, F.round(F.col("p_retailprice") + F.col("p_size") * 3, 1)).alias("price"))


INCOMPLETE_SQL = """
gaps AS (
  SELECT p_partkey, CAST(p_size AS DOUBLE) AS size,
         CASE WHEN p_partkey % 5 <> 0 THEN round(p_retailprice + p_size * 3, 1) END AS price FROM part),
done AS (
  SELECT i.imp, g.p_partkey, g.size,
         coalesce(g.price, (SELECT regr_intercept(price, size) FROM gaps)
                           + (SELECT regr_slope(price, size) FROM gaps) * g.size) AS price
  FROM gaps g, (VALUES (1), (2)) i(imp))
"""


@query("impute_norm_predict", sql("""
SELECT CAST(imp AS INTEGER) AS imp, p_partkey, round(price, 5) AS price FROM done""", INCOMPLETE_SQL))
def q_impute_norm_predict(spark, sf):
    out = mice_impute(_incomplete(spark, sf), "p_partkey", {"price": "norm.predict"}, ["size"], m=2, sweeps=2)
    return out.select("imp", "p_partkey", F.round("price", 5).alias("price"))


@query("impute_random_forest", """
SELECT CAST(i.imp AS INTEGER) AS imp, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS left_missing,
       CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS not_observed
FROM part, (VALUES (1), (2)) i(imp) GROUP BY 1""")
def q_impute_random_forest(spark, sf):
    """Properties of the donor draw: nothing left missing, observed values kept, donors observed."""
    df = _incomplete(spark, sf)
    out = mice_impute(df, "p_partkey", {"price": "rf"}, ["size", "len"], m=2, sweeps=1, trees=4)
    seen = df.filter("price is not null").select(F.col("price").alias("donor")).distinct()
    both = (out.join(df.select("p_partkey", F.col("price").alias("before")), "p_partkey")
            .join(seen, F.col("price") == F.col("donor"), "left"))
    return both.groupBy("imp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("price").isNull()).alias("left_missing"),
        F.count_if(F.col("before") != F.col("price")).alias("changed"),
        F.count_if(F.col("donor").isNull()).alias("not_observed"))


#: Where the chain over two incomplete columns begins.
CHAIN_STARTS = {"price": 1000.0, "weight": 100.0}


def _chain_sql(sweeps: int) -> str:
    """Two columns that predict each other beside a complete one: least squares with two predictors in closed form."""
    out = ["""WITH holes AS (
  SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 5 <> 0 THEN round(p_retailprice + p_size * 3, 1) END AS price0,
         CASE WHEN p_partkey % 4 <> 1 THEN CAST(length(p_name) * 10 + p_partkey % 7 AS DOUBLE) END AS weight0 FROM part)""",
           f"step0 AS (SELECT *, coalesce(price0, {CHAIN_STARTS['price']}) AS price, coalesce(weight0, {CHAIN_STARTS['weight']}) AS weight FROM holes)"]
    for k in range(2 * sweeps):
        y, x = ("price", "weight") if k % 2 == 0 else ("weight", "price")
        out.append(f"""sums{k} AS (
  SELECT avg({y}0) AS my, avg(size) AS m1, avg({x}) AS m2, var_pop(size) AS v1, var_pop({x}) AS v2, covar_pop(size, {x}) AS c12,
         covar_pop({y}0, size) AS c1, covar_pop({y}0, {x}) AS c2 FROM step{k} WHERE {y}0 IS NOT NULL)""")
        out.append(f"""fit{k} AS (
  SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM sums{k})""")
        out.append(f"""step{k + 1} AS (
  SELECT p_partkey, size, price0, weight0, coalesce({y}0, my + b1 * (size - m1) + b2 * ({x} - m2)) AS {y}, {x} FROM step{k}, fit{k})""")
    return ", ".join(out) + f"""
SELECT CAST(i.imp AS INTEGER) AS imp, p_partkey, round(price, 4) AS price, round(weight, 4) AS weight
FROM step{2 * sweeps}, (VALUES (1), (2)) i(imp)"""


@query("impute_chained", _chain_sql(2))
def q_impute_chained(spark, sf):
    """Two incomplete columns, each predicted by the other and a complete one, over two sweeps."""
    df = _incomplete(spark, sf).drop("len").join(
        table(spark, sf, "part").select("p_partkey", F.when(
            F.col("p_partkey") % 4 != 1, (F.length("p_name") * 10 + F.col("p_partkey") % 7).cast("double")).alias("weight")), "p_partkey")
    out = mice_impute(df, "p_partkey", dict.fromkeys(CHAIN_STARTS, "norm.predict"), ["size"], m=2, sweeps=2, starts=CHAIN_STARTS)
    return out.select("imp", "p_partkey", F.round("price", 4).alias("price"), F.round("weight", 4).alias("weight"))


@query("complete_long", sql("""
SELECT CAST(imp AS INTEGER) AS imp, p_partkey, size, round(price, 5) AS price FROM done""", INCOMPLETE_SQL))
def q_complete_long(spark, sf):
    out = mice_impute(_incomplete(spark, sf), "p_partkey", {"price": "norm.predict"}, ["size"], m=2, sweeps=1)
    return complete_long(out, ["p_partkey", "size", "price"]).withColumn("price", F.round("price", 5))


@query("imputation_check", sql("""
SELECT imp, 'price' AS var, CAST(unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS DOUBLE) AS prob,
       round(unnest(quantile_cont(price, [0.0, 0.25, 0.5, 0.75, 1.0])), 4) AS value
FROM (SELECT CAST(imp AS INTEGER) AS imp, price FROM done
      UNION ALL SELECT 0, price FROM gaps WHERE price IS NOT NULL) GROUP BY 1""", INCOMPLETE_SQL))
def q_imputation_check(spark, sf):
    df = _incomplete(spark, sf)
    done = mice_impute(df, "p_partkey", {"price": "norm.predict"}, ["size"], m=2, sweeps=1)
    return imputation_check(df, done, ["price"]).withColumn("value", F.round("value", 4))
