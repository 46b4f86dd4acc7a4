"""Rubin's rules over the coefficient tables of several completed data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.distributions import t_quantile_udf, t_two_sided_udf


def rubin_pool(coefs: DataFrame, n_obs: int, m: int | None = None, keys: Sequence[str] = ("term",),
               estimate: str = "estimate", std_error: str = "std_error", params: int = 2,
               level: float = 0.95) -> DataFrame:
    """Pooled estimate, variances, lambda, degrees of freedom, Wald test and interval per term.

    ``m`` is the number of imputations (by default the rows found per term) and ``n_obs`` the
    rows of one data set. Without variation between imputations lambda is zero, the old degrees
    of freedom are infinite and the observed ones are used. ``converged`` is true where every pooled
    fit had settled; a term with an unfinished or singular fit is reported, but marked.
    """
    est = F.col(estimate)
    settled = F.min("converged") if "converged" in coefs.columns else F.lit(None).cast("boolean")
    groups = coefs.groupBy(*keys).agg(
        F.avg(est).alias("estimate"), (F.var_pop(est) * F.count(est)).alias("_ss"),
        F.avg(F.col(std_error) * F.col(std_error)).alias("var_within"),
        F.count(est).alias("imputations"), settled.alias("converged"))
    size = F.lit(float(m)) if m is not None else F.col("imputations").cast("double")
    dof = float(n_obs - params)
    out = groups.withColumn("_m", size)
    out = out.withColumn("var_between", F.when(F.col("_m") > 1, F.col("_ss") / (F.col("_m") - 1)).otherwise(0.0))
    out = out.withColumn("var_total", F.col("var_within") + F.col("var_between")
                         + F.col("var_between") / F.col("_m"))
    # a term without any variance (a regressor that never varies) has lambda 0 and no test
    out = out.withColumn("lambda", F.coalesce(F.try_divide(
        F.col("var_between") + F.col("var_between") / F.col("_m"), F.col("var_total")), F.lit(0.0)))
    lam = F.col("lambda")
    out = out.withColumns({
        "df_old": F.when(lam * lam > 0, (F.col("_m") - 1) / (lam * lam)).otherwise(F.lit(float("inf"))),
        "df_obs": F.lit((dof + 1) / (dof + 3) * dof) * (1 - lam),
        "wald": F.try_divide(F.col("estimate"), F.sqrt("var_total")),
    })
    # 1 / (1/old + 1/observed), in a form that holds for infinite and zero degrees of freedom
    out = out.withColumn("df_adj", F.col("df_obs") / (1 + F.try_divide(F.col("df_obs"), F.col("df_old"))))
    half = t_quantile_udf(F.lit(0.5 + level / 2), F.col("df_adj")) * F.sqrt("var_total")
    out = out.withColumns({"p_value": t_two_sided_udf("wald", "df_adj"), "_half": half})
    return out.select(
        *keys, "estimate", "var_within", "var_between", "var_total", "lambda", "df_old", "df_obs",
        "df_adj", "wald", "p_value", F.exp("estimate").alias("ratio"),
        F.exp(F.col("estimate") - F.col("_half")).alias("ratio_lower"),
        F.exp(F.col("estimate") + F.col("_half")).alias("ratio_upper"), "imputations", "converged")


def result_table(pooled: DataFrame, ratio: str, keys: Sequence[str] = ("term",)) -> DataFrame:
    """The reported columns: ratio (``OR`` or ``HR``), interval and p-value."""
    return pooled.select(
        *keys, F.bround("ratio", 3).alias(ratio), F.col("ratio_lower").alias(f"{ratio}_ci_lower"),
        F.col("ratio_upper").alias(f"{ratio}_ci_upper"), F.col("p_value").alias(f"pval_{ratio}"),
        F.col("converged").alias(f"converged_{ratio}"))


def paired_table(odds: DataFrame, hazards: DataFrame, keys: Sequence[str] = ("term",)) -> DataFrame:
    """Odds and hazard ratios of the same terms side by side."""
    return result_table(odds, "OR", keys).join(result_table(hazards, "HR", keys), list(keys), "left")
