"""Schemas of the persisted tables and checks on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "date": T.DateType(),
}


def schema(text: str) -> T.StructType:
    """Schema from ``name type, ...``; unlike DDL parsing this needs no running session."""
    fields = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


ATTRITION = schema("criterion string, pat_cnt int, site string")
COHORT = schema(
    "patid string, birth_date date, index_date date, age_at_index int, age_at_index_days int, "
    "enc_type_at_index string, sex string, race string, hispanic string, site string")
ENDPOINTS = schema(
    "patid string, index_date date, endpoint string, endpoint_date date, days int, site string")
VITALS = schema(
    "patid string, site string, vital_type string, vital_val double, vital_unit string, "
    "measure_date date, days int")
VITALS_INTEGER = schema(
    "patid string, site string, vital_type string, vital_val int, vital_unit string, "
    "measure_date date, days int")
ENCOUNTERS = schema(
    "patid string, site string, enc_type string, admit_date date, discharge_date date, "
    "admit_days int, los int")
LABS = schema(
    "patid string, site string, lab_name string, lab_order_date date, specimen_date date, "
    "result_date date, result_num double, result_qual string, result_unit string, "
    "norm_modifier_high string, order_days int, specimen_days int, result_days int")
DIAGNOSES = schema(
    "patid string, site string, dx_group string, dx string, dx_date date, days int")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise if a key occurs twice; the warehouse declares such keys but never enforces them."""
    bad = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"duplicate key {bad[0].asDict()}")
    return df


def assert_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]).first()
    bad = {c: counts[c] for c in columns if counts[c]}
    if bad:
        raise ValueError(f"missing values: {bad}")
    return df
