"""Kaplan-Meier curves and their values at fixed times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.scans import in_blocks, running_sums

Z_95 = 1.959963984540054


def _whole_times(df: DataFrame, time: str) -> None:
    if not isinstance(df.schema[time].dataType, T.IntegralType):
        raise TypeError(f"{time} must be a whole number")


def kaplan_meier(df: DataFrame, time: str, status: str, group: Sequence[str] = ()) -> DataFrame:
    """Survival curve per group: at risk, events, censored, survival, standard error.

    Times are whole numbers of any unit. Rows are counted by time where they are read; the sums along the curve go by
    blocks of times and carries between them, so a curve with as many times as rows is spread over tasks too.
    """
    _whole_times(df, time)
    known = df.filter(F.col(time).isNotNull() & F.col(status).isNotNull())
    per_time = known.groupBy(*group, time).agg(
        F.sum(F.col(status)).cast("bigint").alias("n_event"), F.count(F.lit(1)).alias("_all"))
    blocks = in_blocks(per_time, group, [time])
    d, n = F.col("n_event"), F.col("n_risk")
    out = running_sums(blocks, group, [time], onward={"n_risk": F.col("_all")})
    # ln(1 - d/n) is undefined when everybody left fails at once; that is the curve's last time, and it is zero there
    out = running_sums(out, group, [time], upto={"_log": F.when(d < n, F.ln(1 - d / n)).otherwise(0.0),
                                                 "_var": F.when(d < n, d / (n * (n - d))).otherwise(0.0)})
    return out.select(*group, time, "n_risk", "n_event", (F.col("_all") - d).alias("n_censor"),
                      F.when(d == n, 0.0).otherwise(F.exp("_log")).alias("survival"), F.sqrt(F.when(d < n, F.col("_var"))).alias("std_err_log"))


def with_log_ci(curve: DataFrame, z: float = Z_95) -> DataFrame:
    """Confidence limits on the log scale, the upper one capped at 1."""
    s, e = F.col("survival"), F.col("std_err_log")
    return curve.withColumns({"lower": s * F.exp(-z * e),
                              "upper": F.when(e.isNotNull(), F.least(F.lit(1.0), s * F.exp(z * e)))})


def survival_at(curve: DataFrame, times: Sequence[int], time: str,
                group: Sequence[str] = ()) -> DataFrame:
    """Step lookup: survival, limits and number at risk at the given times.

    Times past the last observation give no row. The curve is scanned once, with one
    conditional aggregate per time.
    """
    limits = with_log_ci(curve)
    cells = F.struct("survival", "lower", "upper")
    aggs = [F.max(time).alias("_last")]
    for i, t in enumerate(times):
        aggs += [F.max_by(cells, F.when(F.col(time) <= t, F.col(time))).alias(f"_c{i}"),
                 F.max(F.when(F.col(time) >= t, F.col("n_risk"))).alias(f"_r{i}"),
                 F.count_if(F.col(time) <= t).alias(f"_k{i}")]
    one = limits.groupBy(*group).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(t).alias("at"), F.coalesce(F.col(f"_r{i}"), F.lit(0)).alias("n_risk"),
                 F.when(F.col(f"_k{i}") > 0, F.col(f"_c{i}.survival")).otherwise(1.0).alias("survival"),
                 F.when(F.col(f"_k{i}") > 0, F.col(f"_c{i}.lower")).otherwise(1.0).alias("lower"),
                 F.when(F.col(f"_k{i}") > 0, F.col(f"_c{i}.upper")).otherwise(1.0).alias("upper"))
        for i, t in enumerate(times)])
    return one.select(*group, "_last", F.inline(rows)).filter(F.col("at") <= F.col("_last")).drop("_last")
