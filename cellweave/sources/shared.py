"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Where the session says; a folder of our own only where it says nothing and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read again."""
    path = f"{shared_dir(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stored_in_ranges(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows, written once in ranges of ``keys`` that Spark samples, with the range's number as _r.

    Ranges hold about equally many rows however the keys are spread, and follow
    each other in key order; equal keys share a range.
    """
    path = f"{shared_dir(rows.sparkSession)}/ranges-{uuid.uuid4().hex}"
    rows.repartitionByRange(*keys).withColumn("_r", F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)
