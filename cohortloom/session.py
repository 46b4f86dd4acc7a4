"""Session settings and lineage cutting."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(app: str = "cohortloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle partition counts are left to adaptive execution: it starts from
    ``initialPartitionNum`` and merges small ones, so one setting serves a laptop and a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder of this run below the shared checkpoint folder of the cluster.

    Only a local master without that setting, as in tests, gets a folder of its own, which is then set.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder name in this run's scratch folder."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove all that this run has written to its scratch folder, once the results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="cohortloom-")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage so that a lost executor costs one re-read, not a recomputation, and gives
    Catalyst true table sizes for the joins that follow.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
