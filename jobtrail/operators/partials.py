"""Aggregates of applications that are kept up batch by batch.

A batch of jobs becomes a partial aggregate: sums of all measures per (application, run, queue). Partials
merge: sums add up, runs and queues are sets. So days and weeks come out of any number of batches as out
of all jobs at once, and few rows are read for it.

    state/jobs/batch=<n>      ids of the jobs that the batch was the first to bring (the ledger)
    state/partials/batch=<n>  its partial aggregate
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from jobtrail.operators.apps import queues
from jobtrail.operators.flows import APP, MEASURES
from jobtrail.sources.folders import delete, exists, overwrite_partitions

KEY = (*APP, "run_id", "queue")
SUMMED = (*MEASURES, "slot_millis")
#: The batch that holds what compact() has put together; batches are numbered from 0.
COMPACTED = -1


def partial(jobs: DataFrame) -> DataFrame:
    """Count and sums of the measures that jobs have per (application, run, queue)."""
    return jobs.groupBy(*KEY).agg(F.count("*").alias("total_jobs"), *(F.sum(m).alias(m) for m in SUMMED if m in jobs.columns))


def added(partials: DataFrame) -> DataFrame:
    """Partials of several batches as one."""
    return partials.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in partials.columns if c == "total_jobs" or c in SUMMED))


def rolled(partials: DataFrame, bucket: Column) -> DataFrame:
    """Per (bucket, application) what the jobs of the partials sum up to; in all columns that of apps.app_agg()."""
    sums = [F.sum(c).alias(c) for c in ("total_jobs", *SUMMED) if c in partials.columns]
    return partials.groupBy(bucket.alias("bucket"), *APP).agg(F.count_distinct("run_id").alias("number_runs"), *sums, queues().alias("queues"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The ledger or the partials; none where nothing was folded."""
    settle(spark, folder)
    path = f"{folder}/state/{name}"
    return spark.read.parquet(path) if exists(spark, path) else None


def settle(spark: SparkSession, folder: str) -> None:
    """Put the state back that a compaction took away before it stopped."""
    if not exists(spark, f"{folder}/state") and exists(spark, f"{folder}/state-old"):
        renamed(spark, f"{folder}/state-old", f"{folder}/state")


def renamed(spark: SparkSession, old: str, new: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not path(old).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(old), path(new)):
        raise OSError(f"{old} was not renamed to {new}")


def fold(jobs: DataFrame, folder: str, batch: int, job: tuple[str, ...] = ("cluster", "job_seq")) -> None:
    """Take a batch of jobs into the aggregates, each job once.

    Jobs that another batch brought are left out, and a job that comes twice in this one counts once
    (any of its rows). The ledger is written first and the partial is made from it, each as a folder of the
    batch, so a batch that stops anywhere, or comes again, gives the same. Of a batch that was compacted
    nothing is new. Batches are folded one after another.
    """
    spark = jobs.sparkSession
    others, mine = table(spark, folder, "jobs"), jobs.select(*job).distinct()
    if others is not None:
        same = [F.col(f"m.{c}").eqNullSafe(F.col(f"o.{c}")) for c in job]
        mine = mine.alias("m").join(others.where(F.col("batch") != batch).select(*job).alias("o"), same, "left_anti")
    if mine.isEmpty():
        return
    overwrite_partitions(mine.withColumn("batch", F.lit(batch)), f"{folder}/state/jobs", "batch")
    same = [F.col(f"j.{c}").eqNullSafe(F.col(f"m.{c}")) for c in job]
    ours = table(spark, folder, "jobs").where(F.col("batch") == batch).select(*job)
    once = jobs.dropDuplicates(list(job)).alias("j").join(ours.alias("m"), same, "left_semi")
    overwrite_partitions(partial(once).withColumn("batch", F.lit(batch)), f"{folder}/state/partials", "batch")


def merged(spark: SparkSession, folder: str, bucket: Column) -> DataFrame:
    """The aggregates of all batches so far, by a bucket of run_id (a day, a week)."""
    return rolled(table(spark, folder, "partials"), bucket)


def compact(spark: SparkSession, folder: str) -> None:
    """Put all batches into one, so that as many rows are read as there are runs and queues, whatever the number of batches.

    Ledger and partials are written beside the state and take its place together; a compaction that
    stopped leaves the state as it was. No batch may be folded meanwhile.
    """
    draft, old = f"{folder}/state-draft", f"{folder}/state-old"
    jobs, partials = table(spark, folder, "jobs"), table(spark, folder, "partials")
    for name, df in (("jobs", jobs.drop("batch")), ("partials", added(partials))):
        df.withColumn("batch", F.lit(COMPACTED)).write.mode("overwrite").partitionBy("batch").parquet(f"{draft}/{name}")
    delete(spark, old)
    renamed(spark, f"{folder}/state", old)
    renamed(spark, draft, f"{folder}/state")
    delete(spark, old)


def aggregated(jobs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream of jobs into the aggregates: each batch of the stream is folded under its number, also if it comes again."""
    return jobs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: fold(batch, folder, number)).start()
