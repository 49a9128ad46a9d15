"""Streams: new files since the last run, events after a sequence, distinct runs with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

#: How long a run id is remembered.
RUN_TTL = "30 days"


def new_files(spark: SparkSession, path: str, schema: StructType | str, checkpoint: str, out: str, form: str = "parquet", **options: str) -> StreamingQuery:
    """Append what was added below path since the last call; the checkpoint is the high-water mark.

    Any file source of Spark is a form: parquet, text (with wholetext a history file is a row), binaryFile, json.
    """
    source = spark.readStream.schema(schema).format(form).options(recursiveFileLookup="true", **options).load(path)
    return source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_after(events: DataFrame, sequence: int) -> DataFrame:
    """Works on streams and tables: events beyond a sequence number."""
    return events.where(F.col("sequence") > sequence)


def first_of_runs(jobs: DataFrame) -> DataFrame:
    """A stream of jobs (at timestamp, cluster, user, app, run_id) less those of runs seen in the last 30 days."""
    day = F.date_trunc("day", "at").alias("day")
    return jobs.select("*", day).withWatermark("at", RUN_TTL).dropDuplicatesWithinWatermark(["cluster", "user", "app", "day", "run_id"])


def daily_counts(runs: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Write each batch of first runs by day; a batch that is run again overwrites its own files only. merged() adds them up."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("cluster", "user", "app", "day").agg(F.count("*").alias("runs")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return runs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def merged(spark: SparkSession, out: str) -> DataFrame:
    """One row per application and day of what daily_counts() wrote in any number of batches."""
    return spark.read.parquet(out).groupBy("cluster", "user", "app", "day").agg(F.sum("runs").alias("runs"))
