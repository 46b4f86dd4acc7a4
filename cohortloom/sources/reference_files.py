"""Small text files: static code sets and growth-reference curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODESET_SCHEMA = "code_group string, code_type string, code string, label string"


def read_codeset(spark: SparkSession, path: str) -> DataFrame:
    """Static code set with quoted labels; codes stay text to keep leading zeros."""
    return (spark.read.schema(CODESET_SCHEMA)
            .option("header", True).option("quote", '"').option("escape", '"')
            .csv(path))


def read_growth_reference(spark: SparkSession, path: str) -> DataFrame:
    """Reference curve ``Sex,Agemos,L,M,S`` read as text and converted.

    Rows whose sex is not a number, such as a header repeated in mid-file, are dropped.
    """
    names = ["sex", "agemos", "l", "m", "s"]
    raw = (spark.read.option("header", True)
           .schema(", ".join(f"{n} string" for n in names))
           .csv(path))
    typed = raw.select(*[F.col(n).try_cast("double").alias(n) for n in names])
    return typed.filter(F.col("sex").isNotNull())
