"""Descriptive tables: counts, percentages, quantiles and contrasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.distributions import test_p_value_udf
from cohortloom.functions.quantiles import grouped_quantiles, wide_quantiles
from cohortloom.functions.values import mean_sd, n_pct, n_pct_without
from cohortloom.session import materialize

ALL = "ALL"


def _site_label(site: str) -> Column:
    return F.when(F.grouping(site) == 1, F.lit(ALL)).otherwise(F.col(site))


def denominators(df: DataFrame, person: str, site: str) -> DataFrame:
    """Distinct persons per site and overall (site ``ALL``) from one rollup."""
    return (df.select(person, site).distinct().rollup(site)
            .agg(_site_label(site).alias("_site"), F.countDistinct(person).alias("n"))
            .select(F.col("_site").alias(site), "n"))


def _counts_by_site(df: DataFrame, label: str, person: str, site: str) -> DataFrame:
    """Distinct persons per label for each site and for all sites."""
    slim = df.select(label, site, person).distinct()
    return (slim.groupingSets([[label, site], [label]], label, site)
            .agg(_site_label(site).alias("_site"), F.countDistinct(person).alias("cnt"))
            .select(label, F.col("_site").alias(site), "cnt"))


def _with_total(counts: DataFrame, totals: DataFrame, site: str) -> DataFrame:
    """Joins the totals of each site; a missing site is a site like any other."""
    totals = totals.select(F.col(site).alias("_site"), "total")
    return counts.join(totals, counts[site].eqNullSafe(F.col("_site"))).drop("_site")


def table_one(df: DataFrame, person: str, site: str, age: str,
              categories: Mapping[str, str]) -> DataFrame:
    """Long table of text cells ``(summ_var, site, summ_val)``.

    Rows: ``1_N``, ``2_<age>`` as mean (sd) and, per entry of ``categories`` (prefix to column),
    ``<prefix>:<level>``. All categorical rows come from one unpivot and one grouping.
    """
    labels = F.array(F.lit("1_N"), *[
        F.concat(F.lit(f"{prefix}:"), F.col(col)) for prefix, col in categories.items()])
    counted = _counts_by_site(df.select(person, site, F.explode(labels).alias("summ_var")),
                              "summ_var", person, site)
    totals = denominators(df, person, site).withColumnRenamed("n", "total")
    cells = _with_total(counted, totals, site).select(
        "summ_var", site, n_pct(F.col("cnt"), F.col("total")).alias("summ_val"))
    ages = df.rollup(site).agg(
        _site_label(site).alias("_site"), F.avg(age).alias("_mean"), F.stddev_samp(age).alias("_sd"))
    age_cells = ages.select(F.lit(f"2_{age}").alias("summ_var"), F.col("_site").alias(site),
                            mean_sd(F.col("_mean"), F.col("_sd")).alias("summ_val"))
    return cells.unionByName(age_cells)


def pivot_sites(cells: DataFrame, site: str, sites: Sequence[str], label: str = "summ_var",
                value: str = "summ_val") -> DataFrame:
    """One column per listed site in order (``SITE1`` ..) plus ``ALL``, sorted by label."""
    picks = [F.max(F.when(F.col(site) == s, F.col(value))).alias(f"SITE{i}")
             for i, s in enumerate(sites, 1)]
    overall = F.max(F.when(F.col(site) == ALL, F.col(value))).alias(ALL)
    return cells.groupBy(label).agg(*picks, overall).orderBy(label)


def endpoint_table(cohort: DataFrame, endpoints: DataFrame, person: str, site: str,
                   endpoint: str = "endpoint") -> DataFrame:
    """Cells for persons with (``_w``) and without (``_wo``) each endpoint, by site and overall."""
    totals = denominators(cohort, person, site).withColumnRenamed("n", "total")
    size = totals.select(F.lit("1_N").alias("summ_var"), site,
                         n_pct(F.col("total"), F.col("total")).alias("summ_val"))
    counts = _with_total(_counts_by_site(endpoints, endpoint, person, site), totals, site)
    name = F.concat(F.lit("2_"), F.col(endpoint))
    both = F.array(
        F.struct(F.concat(name, F.lit("_w")).alias("summ_var"),
                 n_pct(F.col("cnt"), F.col("total")).alias("summ_val")),
        F.struct(F.concat(name, F.lit("_wo")).alias("summ_var"),
                 n_pct_without(F.col("cnt"), F.col("total")).alias("summ_val")))
    return size.unionByName(counts.select(site, F.inline(both)))


def yearly_denominators(df: DataFrame, person: str, year: str) -> DataFrame:
    return df.groupBy(year).agg(F.countDistinct(person).alias("n_year"))


def first_treatment_rates(df: DataFrame, person: str, year: str, first: str = "trt1") -> DataFrame:
    """Per year and first treatment: persons, treated persons of the year, and their ratio."""
    given = df.filter(F.col(first).isNotNull())
    per = given.groupBy(year, F.col(first).alias("var")).agg(F.countDistinct(person).alias("n"))
    total = given.groupBy(year).agg(F.countDistinct(person).alias("n_year"))
    return per.join(total, year).select(
        year, "n_year", "var", "n", F.bround(F.col("n") / F.col("n_year"), 3).alias("p"))


def any_treatment_rows(rates: DataFrame, yearly: DataFrame, year: str) -> DataFrame:
    """Append one ``any`` row per year: treated persons over all persons of the year."""
    anyone = (rates.select(year, F.col("n_year").alias("n")).distinct()
              .join(yearly, year, "left")
              .select(year, "n_year", F.lit("any").alias("var"), "n",
                      F.bround(F.col("n") / F.col("n_year"), 3).alias("p")))
    return rates.unionByName(anyone)


def time_to_first(df: DataFrame, time: str, first: str = "trt1", within: int = 365) -> DataFrame:
    """Five quantiles of the days to the first treatment, for those within ``within`` days."""
    kept = materialize(df.filter(F.col(first).isNotNull() & (F.col(time) <= within)).select(first, time))
    names = ["q0", "q25", "q50", "q75", "q100"]
    quantiles = wide_quantiles(kept, first, time, [0, 0.25, 0.5, 0.75, 1], names)
    return kept.groupBy(first).agg(F.count(F.lit(1)).alias("n")).join(quantiles, first).select(first, "n", *names)


def missingness_rates(df: DataFrame, person: str, year: str, flags: Sequence[str]) -> DataFrame:
    """Sum and share of presence flags per year; the unpivot follows the aggregation."""
    per_year = df.groupBy(year).agg(
        F.countDistinct(person).alias("n_year"), *[F.sum(F.col(f"`{f}`")).alias(f) for f in flags])
    long = per_year.unpivot([year, "n_year"], [F.col(f"`{f}`") for f in flags], "var", "n")
    return long.select(year, "n_year", "var", "n",
                       F.bround(F.col("n") / F.col("n_year"), 3).alias("p"))


def _subset_rows(df: DataFrame, subsets: Mapping[str, tuple[Column, Column]], person: Column | None = None) -> DataFrame:
    """_subset, _in, _value, _person of every row and subset, written once: what follows reads thin rows several times."""
    entries = F.array(*[F.struct(F.lit(name).alias("_subset"), F.coalesce(cond, F.lit(False)).alias("_in"), value.cast("double").alias("_value"))
                        for name, (value, cond) in subsets.items()])
    person = F.lit(None).cast("string") if person is None else person
    return materialize(df.select(person.alias("_person"), F.inline(entries)))


def _by_subset(rows: DataFrame, subsets: Mapping, sizes: DataFrame, names: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Sizes and quantiles of every subset, of one without rows too."""
    inside = rows.filter("_in").select("_subset", "_value")
    every = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in subsets])).alias("_subset"))
    return every.join(sizes, "_subset", "left").join(wide_quantiles(inside, "_subset", "_value", probs, names), "_subset", "left")


def quartiles_by_outcome(df: DataFrame, person: str, time: str,
                         groups: Mapping[str, Column]) -> DataFrame:
    """Count of persons, share of all rows, median and quartiles of a column per named subgroup."""
    subsets = {name: (F.col(time), cond) for name, cond in groups.items()}
    rows = _subset_rows(df, subsets, F.col(person))
    n = F.countDistinct(F.when(F.col("_in"), F.col("_person")))
    sizes = rows.groupBy("_subset").agg(n.alias("n"), (n / F.count(F.lit(1))).alias("p"))
    out = _by_subset(rows, subsets, sizes, ["q1", "med", "q3"], [0.25, 0.5, 0.75])
    return out.select(F.col("_subset").alias("grp"), F.coalesce("n", F.lit(0)).alias("n"), "p", "med", "q1", "q3")


def six_numbers(df: DataFrame, subsets: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Count, min, q1, median, mean, q3, max of a column per named row subset."""
    subsets = {name: (F.col(col), cond) for name, (col, cond) in subsets.items()}
    rows = _subset_rows(df, subsets)
    sizes = rows.groupBy("_subset").agg(F.count_if("_in").alias("n"), F.avg(F.when(F.col("_in"), F.col("_value"))).alias("mean"))
    out = _by_subset(rows, subsets, sizes, ["min", "q1", "median", "q3", "max"], [0, 0.25, 0.5, 0.75, 1])
    return out.select(F.col("_subset").alias("subset"), F.coalesce("n", F.lit(0)).alias("n"), "min", "q1", "median", "mean", "q3", "max")


def _long_values(df: DataFrame, columns: Sequence[str], kind: str, keep: Sequence[Column]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("var"), F.col(f"`{c}`").cast(kind).alias("val"))
                        for c in columns])
    return df.select(*keep, F.inline(entries))


def univariate_summary(df: DataFrame, variables: Sequence[str], categorical: Sequence[str],
                       group: str | None = None) -> DataFrame:
    """Summary per variable, overall and by group, with a test between the groups.

    Numeric variables give mean (sd), categorical ones n (share) per level, both with the count
    of missing values; the test is one-way F or Pearson chi-square, from aggregated moments and
    counts. Rows without a group count for ``ALL`` only and enter no test. Output: ``(var, level, grp, n, missing, mean, sd, share, test, statistic, df1, df2,
    p_value)`` with the group ``ALL`` for everybody.
    """
    numeric = [v for v in variables if v not in categorical]
    factors = [v for v in variables if v in categorical]
    grp = (F.col(f"`{group}`").cast("string") if group else F.lit(ALL)).alias("grp")
    parts = []
    if numeric:
        long = _long_values(df, numeric, "double", [grp])
        by = long.filter("grp is not null").groupBy("var", "grp").agg(
            F.count("val").alias("n"), F.count_if(F.col("val").isNull()).alias("missing"),
            F.avg("val").alias("mean"), F.stddev_samp("val").alias("sd"),
            F.var_pop("val").alias("vp"))
        whole = long.groupBy("var").agg(
            F.lit(ALL).alias("grp"), F.count("val").alias("n"),
            F.count_if(F.col("val").isNull()).alias("missing"),
            F.avg("val").alias("mean"), F.stddev_samp("val").alias("sd"), F.var_pop("val").alias("vp"))
        cells = whole.unionByName(by) if group else whole
        if group:
            grand = by.groupBy("var").agg(
                F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("gm"))
            within = F.sum(F.col("n") * F.col("vp"))
            between = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("gm"), 2))
            k, n = F.count_if(F.col("n") > 0), F.sum("n")
            tests = by.join(grand, "var").groupBy("var").agg(
                F.try_divide(between / F.nullif(k - 1, F.lit(0)), F.nullif(within, F.lit(0.0))
                             / F.nullif(n - k, F.lit(0))).alias("statistic"),
                (k - 1).cast("double").alias("df1"), (n - k).cast("double").alias("df2"))
            cells = cells.join(tests.withColumn("test", F.lit("F")), "var", "left")
        parts.append(cells.withColumn("level", F.lit(None).cast("string"))
                     .withColumn("share", F.lit(None).cast("double")).drop("vp"))
    if factors:
        long = _long_values(df, factors, "string", [grp])
        counts = long.groupBy("var", "grp", F.col("val").alias("level")).agg(
            F.count(F.lit(1)).alias("n"))
        whole = counts.groupBy("var", "level").agg(F.sum("n").alias("n")).withColumn("grp", F.lit(ALL))
        counts = counts.filter("grp is not null")
        cells = whole.unionByName(counts) if group else whole
        sizes = cells.groupBy("var", "grp").agg(
            F.sum(F.when(F.col("level").isNotNull(), F.col("n")).otherwise(0)).alias("_known"),
            F.sum(F.when(F.col("level").isNull(), F.col("n")).otherwise(0)).alias("missing"))
        cells = (cells.filter(F.col("level").isNotNull()).join(sizes, ["var", "grp"])
                 .withColumn("share", F.col("n") / F.col("_known")).drop("_known"))
        if group:
            seen = counts.filter(F.col("level").isNotNull())
            rows = seen.groupBy("var", "level").agg(F.sum("n").alias("r"))
            cols = seen.groupBy("var", "grp").agg(F.sum("n").alias("c"))
            total = seen.groupBy("var").agg(
                F.sum("n").alias("t"), F.countDistinct("level").alias("nr"),
                F.countDistinct("grp").alias("nc"))
            # empty cells of the contingency table add up to t - sum of the expected seen ones
            expected = F.col("r") * F.col("c") / F.col("t")
            tests = (seen.join(rows, ["var", "level"]).join(cols, ["var", "grp"]).join(total, "var")
                     .groupBy("var", "t", "nr", "nc")
                     .agg((F.sum(F.pow(F.col("n") - expected, 2) / expected)
                           + F.first("t") - F.sum(expected)).alias("statistic"))
                     .select("var", "statistic",
                             ((F.col("nr") - 1) * (F.col("nc") - 1)).cast("double").alias("df1"),
                             F.lit(None).cast("double").alias("df2"), F.lit("chi2").alias("test")))
            cells = cells.join(tests, "var", "left")
        parts.append(cells.withColumn("mean", F.lit(None).cast("double"))
                     .withColumn("sd", F.lit(None).cast("double")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    base = ["var", "level", "grp", "n", "missing", "mean", "sd", "share"]
    if not group:
        return out.select(*base)
    p = test_p_value_udf("test", "statistic", "df1", "df2")
    tested = out.select("var", "test", "statistic", "df1", "df2").distinct().withColumn("p_value", p)
    return out.select(*base).join(tested, "var", "left")


def imputation_check(observed: DataFrame, imputed: DataFrame, columns: Sequence[str],
                     imp: str = "imp", probs: Sequence[float] = (0, 0.25, 0.5, 0.75, 1)) -> DataFrame:
    """Quantiles per variable and imputation; imputation 0 is the observed data."""
    long = _long_values(imputed, columns, "double", [F.col(imp).cast("int").alias("imp")]).unionByName(
        _long_values(observed, columns, "double", [F.lit(0).alias("imp")]))
    return grouped_quantiles(long, ["imp", "var"], "val", probs)
