"""Writers: tables replaced by partition, so that what runs twice is there once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.operators.files import batches, by_day, record_of_batch
from jobtrail.operators.flows import APP
from jobtrail.sources.folders import exists, overwrite_partitions


def write_history(jobs: DataFrame, tasks: DataFrame, raw: DataFrame, folder: str, *keys: str) -> None:
    """The job, task and raw tables of one batch of files, each by its partitions."""
    for name, df in (("jobs", jobs), ("tasks", tasks), ("raw", raw)):
        overwrite_partitions(df, f"{folder}/{name}", *keys)


def write_batches(files: DataFrame, size: int, folder: str, run: str) -> DataFrame:
    """Write a manifest of the files of each batch of a run; returns the run's process records.

    Other runs into the same folder stay as they are; process_log.preprocess() does this with a log of states.
    """
    overwrite_partitions(batches(files, size).withColumn("run", F.lit(run)), f"{folder}/manifests", "run", "batch")
    mine = files.sparkSession.read.parquet(f"{folder}/manifests").where(F.col("run") == run)
    return record_of_batch(mine, f"{folder}/manifests/run={run}").withColumn("run", F.lit(run))


def put_records(records: DataFrame, folder: str) -> None:
    """Put process records, in place of those of the same run, state and batch."""
    overwrite_partitions(records.select("*", F.col("run").alias("of_run"), F.col("state").alias("in_state"), F.col("batch").alias("of")), folder, "of_run", "in_state", "of")


def partition_by_day(files: DataFrame, folder: str, key: str = "path") -> None:
    """Add files by year, month and day of their modification in UTC; a file (by key) that its day has already is left as it is."""
    at = [key, "year", "month", "day"]
    days = files.select("*", *by_day(F.col("mtime"))).dropDuplicates(at)
    if exists(files.sparkSession, folder):
        days = days.join(files.sparkSession.read.schema(days.schema).parquet(folder).select(*at), at, "left_anti")
    days.select(*files.columns, *at[1:]).write.mode("append").partitionBy(*at[1:]).parquet(folder)


def write_flows(flows: DataFrame, folder: str, parts: int | None = None) -> None:
    """Flows in key order, file by file and within each, so that a page reads the few row groups that its bounds meet."""
    order = [F.asc(c) for c in APP] + [F.desc("run_id")]
    ranged = flows.repartitionByRange(parts, *order) if parts else flows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(folder)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table of buckets by a key, sorted by it within each; two such tables of as many buckets are joined on it without a shuffle."""
    df.repartition(buckets, key).sortWithinPartitions(key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def append_events(events: DataFrame, folder: str) -> None:
    """Add flow events; each keeps its sequence number."""
    events.write.mode("append").parquet(folder)


def aggregate_once(spark: SparkSession, jobs: DataFrame, done: str, batch: int) -> DataFrame:
    """The jobs of a batch that no other batch has aggregated; they are marked as this batch's.

    The mark is written before the rows are used and is by batch, so a batch that is run again gets the same jobs.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(done)
    ids = jobs.select("job_seq").distinct()
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        others = spark.read.parquet(done).where(F.col("batch") != batch).select("job_seq")
        ids = ids.join(others, "job_seq", "left_anti")
    overwrite_partitions(ids.withColumn("batch", F.lit(batch)), done, "batch")
    mine = spark.read.parquet(done).where(F.col("batch") == batch).select("job_seq")
    return jobs.join(mine, "job_seq", "left_semi")
