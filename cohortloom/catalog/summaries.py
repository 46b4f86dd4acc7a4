"""Descriptive tables and survival curves of the order cohort."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.catalog import query, star
from cohortloom.catalog.star import SITES, sql_cohort, sql_stack, sql_timeline
from cohortloom.functions.quantiles import grouped_quantiles
from cohortloom.functions.values import mean_sd, n_pct
from cohortloom.operators import summaries as S
from cohortloom.operators.survival import kaplan_meier, survival_at, with_log_ci
from cohortloom.operators.timelines import any_treatment_time
from cohortloom.session import materialize

CATEGORIES = {"3_sex": "sex", "4_race": "race"}

N_SQL = """
site_n AS (SELECT site, count(DISTINCT person_id) AS n FROM cohort GROUP BY 1
           UNION ALL SELECT 'ALL', count(DISTINCT person_id) FROM cohort),
both_sites AS (SELECT *, site AS s FROM cohort UNION ALL SELECT *, 'ALL' FROM cohort)
"""


def _cell(n, total):
    return (f"CAST({n} AS VARCHAR) || ' (' || CAST(CAST(round({n} / {total} * 100) AS BIGINT) AS VARCHAR) || '%)'")


TABLE_ONE_SQL = f"""
cells AS (
  SELECT '1_N' AS summ_var, b.s AS site, {_cell('count(DISTINCT b.person_id)', 'max(t.n)')} AS summ_val
  FROM both_sites b JOIN site_n t ON b.s = t.site GROUP BY b.s
  UNION SELECT '2_age', s, CAST(CAST(round(avg(age)) AS BIGINT) AS VARCHAR) || ' (' ||
        CAST(CAST(round(stddev_samp(age), 1) AS DECIMAL(18, 1)) AS VARCHAR) || ')' FROM both_sites GROUP BY s
  UNION SELECT '3_sex:' || b.sex, b.s, {_cell('count(DISTINCT b.person_id)', 'max(t.n)')}
  FROM both_sites b JOIN site_n t ON b.s = t.site GROUP BY b.sex, b.s
  UNION SELECT '4_race:' || b.race, b.s, {_cell('count(DISTINCT b.person_id)', 'max(t.n)')}
  FROM both_sites b JOIN site_n t ON b.s = t.site GROUP BY b.race, b.s)
"""


def _pivot_sql(source):
    picks = ", ".join(f"max(CASE WHEN site = '{s}' THEN summ_val END) AS SITE{i}" for i, s in enumerate(SITES, 1))
    return f"SELECT summ_var, {picks}, max(CASE WHEN site = 'ALL' THEN summ_val END) AS \"ALL\" FROM {source} GROUP BY 1"


@query("denominators", sql_cohort("SELECT site, CAST(n AS BIGINT) AS n FROM site_n", N_SQL))
def q_denominators(spark, sf):
    return S.denominators(star.cohort(spark, sf), "person_id", "site")


@query("n_pct_cell", f"""
SELECT c_mktsegment AS site, {_cell('count(*)', 'max(t.n)')} AS cell
FROM customer, (SELECT count(*) AS n FROM customer) t GROUP BY 1""")
def q_n_pct_cell(spark, sf):
    by = star.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("site")).count()
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))  # one row per site only
    return by.select("site", n_pct(F.col("count"), total).alias("cell"))


@query("mean_sd_cell", """
SELECT o_orderpriority AS code, CAST(CAST(round(avg(o_totalprice)) AS BIGINT) AS VARCHAR) || ' (' ||
       CAST(CAST(round(stddev_samp(o_totalprice), 1) AS DECIMAL(18, 1)) AS VARCHAR) || ')' AS cell
FROM orders GROUP BY 1""")
def q_mean_sd_cell(spark, sf):
    o = star.table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("code")).agg(
        mean_sd(F.avg("o_totalprice"), F.stddev_samp("o_totalprice")).alias("cell"))


@query("table_one", sql_cohort("SELECT summ_var, site, summ_val FROM cells", N_SQL, TABLE_ONE_SQL))
def q_table_one(spark, sf):
    who = materialize(star.cohort(spark, sf).select("person_id", "site", "age", "sex", "race"))
    return S.table_one(who, "person_id", "site", "age", CATEGORIES)


@query("pivot_sites", sql_cohort(_pivot_sql("cells"), N_SQL, TABLE_ONE_SQL))
def q_pivot_sites(spark, sf):
    return S.pivot_sites(q_table_one(spark, sf), "site", SITES)


ENDPOINT_TABLE_SQL = f"""
ep AS (SELECT DISTINCT s.person_id, s.endpoint, b.s AS site
       FROM stack s JOIN both_sites b ON s.person_id = b.person_id),
ep_n AS (SELECT e.endpoint, e.site, count(DISTINCT e.person_id) AS k, max(t.n) AS n
         FROM ep e JOIN site_n t ON e.site = t.site GROUP BY 1, 2),
cells AS (
  SELECT '1_N' AS summ_var, site, {_cell('n', 'n')} AS summ_val FROM site_n
  UNION SELECT '2_' || endpoint || '_w', site, {_cell('k', 'n')} FROM ep_n
  UNION SELECT '2_' || endpoint || '_wo', site, CAST(n - k AS VARCHAR) || ' (' ||
        CAST(CAST(round((1 - k / n) * 100) AS BIGINT) AS VARCHAR) || '%)' FROM ep_n)
"""


@query("endpoint_table", sql_stack(_pivot_sql("cells"), N_SQL, ENDPOINT_TABLE_SQL))
def q_endpoint_table(spark, sf):
    who = materialize(star.cohort(spark, sf).select("person_id", "site", "index_date"))
    stack = star.stack(spark, sf, who.select("person_id", "index_date")).join(
        who.select("person_id", "site"), "person_id")
    return S.pivot_sites(S.endpoint_table(who, stack, "person_id", "site"), "site", SITES)


@query("yearly_denominators", sql_cohort("""
SELECT CAST(year(index_date) AS INTEGER) AS index_year, CAST(count(DISTINCT person_id) AS BIGINT) AS n_year
FROM included GROUP BY 1"""))
def q_yearly_denominators(spark, sf):
    inc = star.included(spark, sf).withColumn("index_year", F.year("index_date"))
    return S.yearly_denominators(inc, "person_id", "index_year")


def _dated(spark, sf):
    people = materialize(star.cohort(spark, sf).select("person_id", "index_date"))
    years = people.select("person_id", F.year("index_date").alias("index_year"))
    return star.timeline(spark, sf, people).join(years, "person_id")


DATED_SQL = """
dated AS (SELECT t.*, CAST(year(c.index_date) AS INTEGER) AS index_year
          FROM timeline t JOIN cohort c ON t.person_id = c.person_id),
rates AS (
  SELECT a.index_year, b.n_year, a.var, a.n, round_even(a.n / b.n_year, 3) AS p FROM (
    SELECT index_year, trt1 AS var, CAST(count(DISTINCT person_id) AS BIGINT) AS n FROM dated
    WHERE trt1 IS NOT NULL GROUP BY 1, 2) a
  JOIN (SELECT index_year, CAST(count(DISTINCT person_id) AS BIGINT) AS n_year FROM dated
        WHERE trt1 IS NOT NULL GROUP BY 1) b ON a.index_year = b.index_year)
"""


@query("first_treatment_rates", sql_timeline("SELECT index_year, n_year, var, n, p FROM rates", DATED_SQL))
def q_first_treatment_rates(spark, sf):
    return S.first_treatment_rates(_dated(spark, sf), "person_id", "index_year")


@query("any_treatment_rows", sql_timeline("""
SELECT index_year, n_year, var, n, p FROM rates
UNION ALL
SELECT r.index_year, d.n_year, 'any', r.n_year, round_even(r.n_year / d.n_year, 3)
FROM (SELECT DISTINCT index_year, n_year FROM rates) r
LEFT JOIN (SELECT index_year, CAST(count(DISTINCT person_id) AS BIGINT) AS n_year FROM dated GROUP BY 1) d
  ON r.index_year = d.index_year""", DATED_SQL))
def q_any_treatment_rows(spark, sf):
    df = materialize(_dated(spark, sf).select("person_id", "index_year", "trt1"))
    return S.any_treatment_rows(S.first_treatment_rates(df, "person_id", "index_year"),
                                S.yearly_denominators(df, "person_id", "index_year"), "index_year")


@query("time_to_first", sql_timeline("""
SELECT trt1, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(t, 0.0), 4) AS q0,
       round(quantile_cont(t, 0.25), 4) AS q25, round(quantile_cont(t, 0.5), 4) AS q50,
       round(quantile_cont(t, 0.75), 4) AS q75, round(quantile_cont(t, 1.0), 4) AS q100
FROM (SELECT trt1, CAST(least(time_base_a, time_base_b, time_step_1, time_step_2, time_surgery) AS DOUBLE) AS t
      FROM timeline WHERE trt1 IS NOT NULL) WHERE t <= 365 GROUP BY 1"""))
def q_time_to_first(spark, sf):
    out = S.time_to_first(any_treatment_time(star.timeline(spark, sf), star.ENDPOINTS[:-1]), "trt1_time")
    return out.select("trt1", "n", *[F.round(c, 4).alias(c) for c in ("q0", "q25", "q50", "q75", "q100")])


FLAGS = {"base_a_ind": "base_a", "base_b_ind": "base_b", "step_1_ind": "step_1", "step_2_ind": "step_2",
         "surgery_ind": "surgery"}
MISSING_SQL = " UNION ALL ".join(f"""
SELECT index_year, CAST(count(DISTINCT person_id) AS BIGINT) AS n_year, '{f}' AS var,
       CAST(count({c}) AS BIGINT) AS n, round_even(count({c}) / count(DISTINCT person_id), 3) AS p
FROM dated GROUP BY 1""" for f, c in FLAGS.items())


@query("missingness_rates", sql_timeline(MISSING_SQL, DATED_SQL))
def q_missingness_rates(spark, sf):
    flagged = _dated(spark, sf).select("person_id", "index_year", *[
        F.col(c).isNotNull().cast("int").alias(f) for f, c in FLAGS.items()])
    return S.missingness_rates(flagged, "person_id", "index_year", list(FLAGS))


GROUPS = {
    "censored": "status6 = 0",
    "escalated": "status6 = 1",
    "surgery": "status6 = 1 AND status_surgery = 1",
    "step_up_only": "status6 = 1 AND (status_step_1 = 1 OR status_step_2 = 1) AND status_surgery = 0",
}
QUARTILES_SQL = " UNION ALL ".join(f"""
SELECT '{g}' AS grp, CAST(count(DISTINCT person_id) AS BIGINT) AS n,
       round(count(DISTINCT person_id) / (SELECT count(*) FROM outcomes), 6) AS p,
       round(quantile_cont(CAST(time6 AS DOUBLE), 0.5), 4) AS med,
       round(quantile_cont(CAST(time6 AS DOUBLE), 0.25), 4) AS q1,
       round(quantile_cont(CAST(time6 AS DOUBLE), 0.75), 4) AS q3
FROM outcomes WHERE {c}""" for g, c in GROUPS.items())


@query("quartiles_by_outcome", sql_timeline(QUARTILES_SQL))
def q_quartiles_by_outcome(spark, sf):
    out = S.quartiles_by_outcome(star.outcomes(spark, sf), "person_id", "time6",
                                 {g: F.expr(c) for g, c in GROUPS.items()})
    return out.select("grp", "n", F.round("p", 6).alias("p"),
                      *[F.round(c, 4).alias(c) for c in ("med", "q1", "q3")])


SUBSETS = {
    "start": ("time_idx2std", "time_idx2std IS NOT NULL"),
    "surgery": ("time6", "status_surgery = 1"),
    "step_up": ("time6", "status_step_1 = 1 OR status_step_2 = 1"),
}
SIX_SQL = " UNION ALL ".join(f"""
SELECT '{s}' AS subset, CAST(count(*) AS BIGINT) AS n, CAST(min({c}) AS DOUBLE) AS min,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(avg({c}), 4) AS mean,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3, CAST(max({c}) AS DOUBLE) AS max
FROM outcomes WHERE {w}""" for s, (c, w) in SUBSETS.items())


@query("six_numbers", sql_timeline(SIX_SQL))
def q_six_numbers(spark, sf):
    out = S.six_numbers(star.outcomes(spark, sf), {s: (c, F.expr(w)) for s, (c, w) in SUBSETS.items()})
    return out.select("subset", "n", "min", F.round("q1", 4).alias("q1"), F.round("median", 4).alias("median"),
                      F.round("mean", 4).alias("mean"), F.round("q3", 4).alias("q3"), "max")


KM_SQL = """
per_day AS (SELECT sex, time6, CAST(sum(status6) AS BIGINT) AS d, CAST(count(*) AS BIGINT) AS c
            FROM outcomes GROUP BY 1, 2),
at_risk AS (SELECT *, CAST(sum(c) OVER (PARTITION BY sex ORDER BY time6 DESC) AS BIGINT) AS n FROM per_day),
km AS (
  SELECT sex, time6, n AS n_risk, d AS n_event, c - d AS n_censor,
         CASE WHEN max(CAST(d = n AS INTEGER)) OVER w = 1 THEN CAST(0.0 AS DOUBLE)
              ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END AS survival,
         CASE WHEN max(CAST(d = n AS INTEGER)) OVER w = 0
              THEN sqrt(sum(CASE WHEN d < n THEN CAST(d AS DOUBLE) / (n * (n - d)) ELSE 0 END) OVER w) END AS se
  FROM at_risk WINDOW w AS (PARTITION BY sex ORDER BY time6))
"""


@query("kaplan_meier", sql_timeline("""
SELECT sex, time6, n_risk, n_event, n_censor, round(survival, 8) AS survival, round(se, 8) AS std_err_log,
       round(survival * exp(-1.959963984540054 * se), 8) AS lower,
       round(CASE WHEN se IS NOT NULL THEN least(1, survival * exp(1.959963984540054 * se)) END, 8) AS upper
FROM km""", KM_SQL))
def q_kaplan_meier(spark, sf):
    out = with_log_ci(kaplan_meier(star.outcomes(spark, sf), "time6", "status6", ["sex"]))
    digits = ["survival", "std_err_log", "lower", "upper"]
    return out.select("sex", "time6", "n_risk", "n_event", "n_censor",
                      *[F.round(c, 8).alias(c) for c in digits])


YEARS = [365 * i for i in range(1, 11)]


@query("survival_at", sql_timeline("""
SELECT t.sex, t.at, CAST(coalesce(r.n_risk, 0) AS BIGINT) AS n_risk, round(coalesce(k.survival, 1), 8) AS survival,
       round(CASE WHEN k.survival IS NULL THEN 1 ELSE k.survival * exp(-1.959963984540054 * k.se) END, 8) AS lower,
       round(CASE WHEN k.survival IS NULL THEN 1 WHEN k.se IS NOT NULL THEN least(1, k.survival * exp(1.959963984540054 * k.se)) END, 8) AS upper
FROM (SELECT DISTINCT a.sex, g.at FROM km a, (SELECT CAST(365 * i AS INTEGER) AS at FROM range(1, 11) x(i)) g
      WHERE g.at <= (SELECT max(time6) FROM km b WHERE b.sex = a.sex)) t
LEFT JOIN (SELECT g.at, a.sex, arg_max(survival, time6) AS survival, arg_max_null(se, time6) AS se
           FROM km a JOIN (SELECT 365 * i AS at FROM range(1, 11) x(i)) g ON a.time6 <= g.at GROUP BY 1, 2) k
  ON k.at = t.at AND k.sex = t.sex
LEFT JOIN (SELECT g.at, a.sex, max(n_risk) AS n_risk
           FROM km a JOIN (SELECT 365 * i AS at FROM range(1, 11) x(i)) g ON a.time6 >= g.at GROUP BY 1, 2) r
  ON r.at = t.at AND r.sex = t.sex""", KM_SQL))
def q_survival_at(spark, sf):
    curve = kaplan_meier(star.outcomes(spark, sf), "time6", "status6", ["sex"])
    return survival_at(curve, YEARS, "time6", ["sex"]).select(
        "sex", "at", "n_risk", *[F.round(c, 8).alias(c) for c in ("survival", "lower", "upper")])


def _number(var, grp, where="TRUE", by=""):
    return f"""
SELECT '{var}' AS var, CAST(NULL AS VARCHAR) AS level, {grp} AS grp, CAST(count({var}) AS BIGINT) AS n,
       CAST(sum(CAST({var} IS NULL AS INTEGER)) AS BIGINT) AS missing, round(avg({var}), 6) AS mean,
       round(stddev_samp({var}), 6) AS sd, CAST(NULL AS DOUBLE) AS share FROM base {by}"""


def _levels(var, grp, join, by):
    return f"""
SELECT '{var}' AS var, b.{var} AS level, {grp} AS grp, CAST(count(*) AS BIGINT) AS n,
       CAST(max(t.missing) AS BIGINT) AS missing, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS sd,
       round(count(*) / max(t.known), 6) AS share
FROM base b JOIN (SELECT {grp.replace('b.', '')} AS g, count({var}) AS known,
                         sum(CAST({var} IS NULL AS INTEGER)) AS missing FROM base GROUP BY 1) t ON t.g = {grp}
WHERE b.{var} IS NOT NULL GROUP BY 1, 2, 3"""


BASE_SQL = """
base AS (SELECT CAST(age AS DOUBLE) AS age, CASE WHEN balance > 0 THEN balance END AS balance, sex,
                nullif(race, 'unk') AS race, CAST(status6 AS VARCHAR) AS grp FROM outcomes)
"""


def _base(spark, sf):
    return star.outcomes(spark, sf).select(
        "age", F.when(F.col("balance") > 0, F.col("balance")).alias("balance"), "sex",
        F.nullif(F.col("race"), F.lit("unk")).alias("race"), "status6")


SUMMARY_SQL = " UNION ALL ".join([
    _number("age", "'ALL'"), _number("balance", "'ALL'"),
    _levels("sex", "'ALL'", "", ""), _levels("race", "'ALL'", "", "")])


@query("univariate_summary", sql_timeline(SUMMARY_SQL, BASE_SQL))
def q_univariate_summary(spark, sf):
    out = S.univariate_summary(_base(spark, sf), ["age", "balance", "sex", "race"], ["sex", "race"])
    return out.select("var", "level", "grp", "n", "missing", F.round("mean", 6).alias("mean"),
                      F.round("sd", 6).alias("sd"), F.round("share", 6).alias("share"))


CONTRAST_SQL = " UNION ALL ".join([
    _number("age", "'ALL'"), _number("balance", "'ALL'"), _levels("sex", "'ALL'", "", ""),
    _levels("race", "'ALL'", "", ""), _number("age", "grp", by="GROUP BY grp"),
    _number("balance", "grp", by="GROUP BY grp"), _levels("sex", "b.grp", "", ""),
    _levels("race", "b.grp", "", "")])
TESTS_SQL = BASE_SQL + """,
f_stat AS (""" + " UNION ALL ".join(f"""
  SELECT '{v}' AS var, 'F' AS test,
         (sum(n * (m - gm) * (m - gm)) / nullif(count(*) - 1, 0))
         / nullif(sum(n * vp) / nullif(sum(n) - count(*), 0), 0) AS statistic,
         CAST(count(*) - 1 AS DOUBLE) AS df1, CAST(sum(n) - count(*) AS DOUBLE) AS df2
  FROM (SELECT grp, count({v}) AS n, avg({v}) AS m, var_pop({v}) AS vp FROM base GROUP BY 1),
       (SELECT avg({v}) AS gm FROM base)""" for v in ("age", "balance")) + """),
x_stat AS (""" + " UNION ALL ".join(f"""
  SELECT '{v}' AS var, 'chi2' AS test, sum((coalesce(o.n, 0) - r.n * c.n / t.n) * (coalesce(o.n, 0) - r.n * c.n / t.n)
             / (r.n * c.n / t.n)) AS statistic,
         CAST((count(DISTINCT r.level) - 1) * (count(DISTINCT c.grp) - 1) AS DOUBLE) AS df1,
         CAST(NULL AS DOUBLE) AS df2
  FROM (SELECT {v} AS level, count(*) AS n FROM base WHERE {v} IS NOT NULL GROUP BY 1) r
  CROSS JOIN (SELECT grp, count(*) AS n FROM base WHERE {v} IS NOT NULL GROUP BY 1) c
  CROSS JOIN (SELECT count(*) AS n FROM base WHERE {v} IS NOT NULL) t
  LEFT JOIN (SELECT {v} AS level, grp, count(*) AS n FROM base GROUP BY 1, 2) o
    ON o.level = r.level AND o.grp = c.grp""" for v in ("sex", "race")) + ")"


@query("univariate_contrast", sql_timeline(f"""
SELECT s.*, t.test, round(t.statistic, 6) AS statistic, t.df1, t.df2
FROM ({CONTRAST_SQL}) s JOIN (SELECT * FROM f_stat UNION ALL SELECT * FROM x_stat) t ON s.var = t.var
""", TESTS_SQL))
def q_univariate_contrast(spark, sf):
    out = S.univariate_summary(materialize(_base(spark, sf)), ["age", "balance", "sex", "race"],
                               ["sex", "race"], "status6")
    return out.select("var", "level", "grp", "n", "missing", F.round("mean", 6).alias("mean"),
                      F.round("sd", 6).alias("sd"), F.round("share", 6).alias("share"), "test",
                      F.round("statistic", 6).alias("statistic"), "df1", "df2")


@query("grouped_quantiles", """
SELECT l_returnflag AS flag, CAST(unnest([0.05, 0.25, 0.5, 0.9]) AS DOUBLE) AS prob,
       round(unnest(quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.9])), 4) AS value
FROM lineitem GROUP BY 1""")
def q_grouped_quantiles(spark, sf):
    li = star.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    out = grouped_quantiles(li, ["flag"], "l_extendedprice", [0.05, 0.25, 0.5, 0.9])
    return out.select("flag", "prob", F.round("value", 4).alias("value"))
