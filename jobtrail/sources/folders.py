"""Folders that the driver and all executors reach, and what is in them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir; on one machine, where that is unset, below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors reach")
    return f"{qualified(spark, named or spark.conf.get('spark.sql.warehouse.dir') + '/shared').rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI, by the cluster's own default file system where it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written_once(df: DataFrame, path: str) -> None:
    """Write df, unless that was done to the end before: the writer's mark is its last file."""
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replace the partitions that df has rows of; others stay. A run that is repeated replaces its own."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
