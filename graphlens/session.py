"""Sessions, and the shared folder that iterative operators cut their lineage with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(name: str = "graphlens", shuffle_partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder (``spark.checkpoint.dir``) and read again: iterations do not grow the plan. Its
    shuffle files go when it is written. Where the setting is unset, a local session gets a folder of its own; on a cluster that is an error."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(spark, "_graphlens_folder", None) or tempfile.mkdtemp(prefix="graphlens-")
        spark._graphlens_folder = folder
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
