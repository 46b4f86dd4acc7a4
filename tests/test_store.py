"""Tables laid out by person: joins and groupings by person read them without a shuffle."""

import pytest
from pyspark.sql import functions as F

from cohortloom.catalog.sources import q_person_store
from cohortloom.session import scratch_dir
from cohortloom.sources.tables import create_store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_by_person_without_exchange(spark):
    out = q_person_store(spark, SF)
    assert "Exchange" not in plan(out) and "SortMergeJoin" in plan(out)
    assert out.count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_store_keeps_all_rows(spark):
    """Missing keys, repeated rows and a person with most rows stay; a cohort outside is brought to the buckets; a site list prunes."""
    rows = [(None, "a", 1), (1, "a", 2), (1, "a", 2), (2, "b", 3), *[(7, "b", k) for k in range(500)]]
    df = spark.createDataFrame(rows, "patid long, site string, v int")
    store = create_store(df, "store_rows", scratch_dir(spark), ["patid"], 8, ["site"])
    assert sorted(store.select("patid", "site", "v").collect(), key=str) == sorted(df.collect(), key=str)
    cohort = spark.createDataFrame([(1, 0), (7, 5)], "patid long, t0 int")
    joined = store.join(cohort.hint("merge"), "patid")
    assert plan(joined).count("Exchange hashpartitioning") == 1 and joined.count() == 502
    assert "PartitionFilters: [isnotnull(site" in plan(store.filter(F.col("site") == "b"))
    again = create_store(df.limit(0), "store_rows", scratch_dir(spark), ["patid"], 8, ["site"])
    assert again.count() == 0
    with pytest.raises(ValueError, match="person"):
        create_store(df, "store_rows", scratch_dir(spark), ["person"], 8)
