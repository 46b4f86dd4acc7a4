"""Site tables, dictionaries, snapshots and persisted result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_sites(spark: SparkSession, root: str, table: str, sites: Sequence[str] | None = None,
               site_col: str = "site") -> DataFrame:
    """One table of all sites from ``root/table/site=<name>/``.

    The site is a partition column, so a site list prunes folders instead of starting a loop.
    """
    df = spark.read.parquet(f"{root.rstrip('/')}/{table}")
    df = df.withColumn(site_col, F.col(site_col).cast("string"))
    return df if sites is None else df.filter(F.col(site_col).isin(*sites))


def union_sites(frames: Mapping[str, DataFrame], site_col: str = "site") -> DataFrame:
    """Stack per-site frames, adding the site name; for sites kept in separate schemas."""
    tagged = [df.withColumn(site_col, F.lit(site)) for site, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast by name to a contract; fractional input of an integer column is rounded."""
    out = []
    for field in schema.fields:
        col = F.col(f"`{field.name}`")
        source = df.schema[field.name].dataType
        fractional = isinstance(source, (T.DoubleType, T.FloatType, T.DecimalType))
        if fractional and isinstance(field.dataType, T.IntegralType):
            col = F.round(col)
        out.append(col.cast(field.dataType).alias(field.name))
    return df.select(*out)


def create_table(df: DataFrame, path: str, schema: T.StructType | None = None,
                 partition_by: Sequence[str] = ()) -> DataFrame:
    """Create or replace a persisted table under a fixed schema and read it back."""
    shaped = conform(df, schema) if schema is not None else df
    shaped.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(shaped.schema).parquet(path)


def append_table(df: DataFrame, path: str, schema: T.StructType,
                 partition_by: Sequence[str] = ()) -> DataFrame:
    """Append rows by position, cast to the target schema, as an ``INSERT ... SELECT`` would."""
    named = df.toDF(*[f.name for f in schema.fields])
    conform(named, schema).write.mode("append").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def create_store(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int,
                 partition_by: Sequence[str] = ()) -> DataFrame:
    """Create or replace the catalog table ``name`` at ``path``, bucketed and sorted by person and partitioned (by site).

    Joins and groupings by ``keys`` read it without a shuffle, as do joins of two stores with the same keys and number of
    buckets; a cohort that is not laid out so is brought to its buckets. ``buckets`` should be at least
    ``spark.sql.shuffle.partitions``, else Spark may shuffle both sides to gain tasks. Rows are dealt by bucket
    first, so a task writes one file per bucket and site. A bucket is read by one task: a person with a large share of all
    rows belongs in a plain table, which ``skew_join`` spreads. Rows with a missing key are kept. Nothing of the table
    is replaced before ``df`` is checked for the key columns.
    """
    missing = [c for c in (*keys, *partition_by) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the rows: {missing}")
    spark = df.sparkSession
    dealt = df.repartition(buckets, *[F.col(f"`{c}`") for c in keys])
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return spark.table(name)


def snapshot(frames: Mapping[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Write several tables side by side and return them re-read; nothing reaches the driver."""
    out = {}
    for name, df in frames.items():
        path = f"{root.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        out[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return out
