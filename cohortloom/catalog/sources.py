"""Sources and sinks: every query writes data derived from the tables and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortloom.catalog import query
from cohortloom.catalog import star
from cohortloom.catalog.star import table
from cohortloom.session import scratch_dir
from cohortloom.sources.contracts import schema
from cohortloom.sources.reference_files import read_codeset, read_growth_reference
from cohortloom.sources.tables import (
    append_table,
    conform,
    create_store,
    create_table,
    read_sites,
    read_table,
    snapshot,
    union_sites,
)


@query("read_sites", """
SELECT c_mktsegment AS site, CAST(count(*) AS BIGINT) AS n, CAST(min(c_custkey) AS BIGINT) AS first_key
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""")
def q_read_sites(spark, sf):
    root = scratch_dir(spark)
    people = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "site")
    people.write.partitionBy("site").parquet(f"{root}/person")
    back = read_sites(spark, root, "person", ["BUILDING", "MACHINERY"])
    return back.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key"))


@query("union_sites", """
SELECT CASE o_orderstatus WHEN 'F' THEN 'north' WHEN 'P' THEN 'south' ELSE 'west' END AS site, CAST(count(*) AS BIGINT) AS n,
       round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1""")
def q_union_sites(spark, sf):
    o = table(spark, sf, "orders")
    both = union_sites({"north": o.filter("o_orderstatus = 'F'"), "south": o.filter("o_orderstatus = 'P'"),
                        "west": o.filter("o_orderstatus NOT IN ('F', 'P')")})
    return both.groupBy("site").agg(F.count(F.lit(1)).alias("n"),
                                    F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("read_dictionary", "SELECT p_partkey, p_name, p_type FROM part")
def q_read_dictionary(spark, sf):
    return read_table(spark, f"{sf}/part.parquet", ["p_partkey", "p_name", "p_type"])


@query("read_codeset", """
SELECT p_type AS code_group, 'PART' AS code_type, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code,
       p_name || ', "' || p_brand || '"' AS label FROM part""")
def q_read_codeset(spark, sf):
    path = scratch_dir(spark)
    part = table(spark, sf, "part").select(
        F.col("p_type").alias("code_group"), F.lit("PART").alias("code_type"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"),
        F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("label"))
    part.write.option("header", True).option("escape", '"').csv(path)
    return read_codeset(spark, path)


@query("read_growth_reference", """
SELECT CAST(1 + p_partkey % 2 AS DOUBLE) AS sex, CAST(p_size + 0.5 AS DOUBLE) AS agemos, CAST(p_size % 5 - 2 AS DOUBLE) AS l,
       CAST(10 + p_size AS DOUBLE) AS m, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(0.25 AS DOUBLE) END AS s
FROM part WHERE p_partkey % 10 <> 0""")
def q_read_growth_reference(spark, sf):
    path = scratch_dir(spark)
    bad = F.col("p_partkey") % 10 == 0
    curve = table(spark, sf, "part").select(
        F.when(bad, "Sex").otherwise((1 + F.col("p_partkey") % 2).cast("string")).alias("Sex"),
        F.when(bad, "Agemos").otherwise((F.col("p_size") + 0.5).cast("string")).alias("Agemos"),
        F.when(bad, "L").otherwise((F.col("p_size") % 5 - 2).cast("string")).alias("L"),
        F.when(bad, "M").otherwise((F.col("p_size") + 10).cast("string")).alias("M"),
        F.when(bad, "S").when(F.col("p_size") % 4 == 0, "n/a").otherwise("0.25").alias("S"))
    curve.write.option("header", True).csv(path)
    return read_growth_reference(spark, path)


PRICE_SCHEMA = schema("key bigint, price int, day date, status string")


@query("create_table", """
SELECT o_orderkey AS key, CAST(round(o_totalprice) AS INTEGER) AS price, CAST(o_orderdate AS DATE) AS day,
       o_orderstatus AS status FROM orders""")
def q_create_table(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"))
    return create_table(o, scratch_dir(spark), PRICE_SCHEMA)


@query("append_table", """
SELECT status, CAST(count(*) AS BIGINT) AS n, CAST(sum(price) AS BIGINT) AS total FROM (
  SELECT o_orderstatus AS status, CAST(round(o_totalprice) AS BIGINT) AS price FROM orders
  WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT 'X', CAST(round(o_totalprice) AS BIGINT) FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1""")
def q_append_table(spark, sf):
    path = scratch_dir(spark)
    o = table(spark, sf, "orders")
    rows = o.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    create_table(rows.filter("o_orderstatus = 'F'").toDF(*PRICE_SCHEMA.names), path, PRICE_SCHEMA)
    second = rows.filter("o_orderstatus <> 'F'").withColumn("o_orderstatus", F.lit("X"))
    both = append_table(second, path, PRICE_SCHEMA)
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"),
                                      F.sum(F.col("price").cast("bigint")).alias("total"))


@query("person_store", """
SELECT c_custkey, c_mktsegment AS site, CAST(count(o_orderkey) AS BIGINT) AS n_orders, CAST(min(o_orderdate) AS DATE) AS first_order
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def q_person_store(spark, sf):
    """Events and persons in the same buckets: joined and counted by person without a shuffle of either."""
    root, run = scratch_dir(spark), uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = create_store(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"),
                          f"events_{run}", f"{root}/events", ["o_custkey"], buckets)
    people = create_store(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("site")),
                          f"people_{run}", f"{root}/people", ["c_custkey"], buckets, ["site"])
    joined = people.hint("merge").join(events, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey", "site").agg(F.count("o_orderkey").alias("n_orders"), F.min("o_orderdate").cast("date").alias("first_order"))


@query("snapshot", """
SELECT 'customer' AS name, CAST(count(*) AS BIGINT) AS n, CAST(max(c_custkey) AS BIGINT) AS last FROM customer
UNION ALL SELECT 'orders', CAST(count(*) AS BIGINT), CAST(max(o_orderkey) AS BIGINT) FROM orders""")
def q_snapshot(spark, sf):
    frames = snapshot({"customer": table(spark, sf, "customer").select("c_custkey"),
                       "orders": table(spark, sf, "orders").select("o_orderkey", "o_custkey")},
                      scratch_dir(spark))
    c = frames["customer"].agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last"))
    o = frames["orders"].agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    return c.select(F.lit("customer").alias("name"), "n", "last").unionByName(
        o.select(F.lit("orders").alias("name"), "n", "last"))


@query("persist_codeset", star.sql("SELECT p_partkey, p_name, p_type, therapy FROM codeset", star.CODESET_SQL))
def q_persist_codeset(spark, sf):
    return create_table(star.codeset(spark, sf), scratch_dir(spark), partition_by=["therapy"])


@query("load_analysis_set", star.sql_cohort(
    "SELECT person_id, site, index_date, age, age_days, sex, race FROM cohort"))
def q_load_analysis_set(spark, sf):
    people = star.cohort(spark, sf).select("person_id", "site", "index_date", "age", "age_days", "sex", "race")
    return snapshot({"aset": people}, scratch_dir(spark))["aset"]


@query("preview_filter", star.sql(
    "SELECT p_partkey, p_name, therapy FROM codeset WHERE therapy = 'step_1'", star.CODESET_SQL))
def q_preview_filter(spark, sf):
    return star.codeset(spark, sf).filter("therapy = 'step_1'").select("p_partkey", "p_name", "therapy")


@query("round_on_insert", """
SELECT l_orderkey AS k, l_linenumber AS line, CAST(round(l_extendedprice) AS INTEGER) AS price FROM lineitem""")
def q_round_on_insert(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("price"))
    return conform(li, schema("k bigint, line int, price int"))
