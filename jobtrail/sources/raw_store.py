"""Raw history and configuration of jobs, stored by ranges of job ids.

Ids count up within an epoch, so blocks of so many of them are ranges of much the same size. A block is a
partition and its rows are sorted: a scan from one id to another lists the folders of the blocks it meets
and no others, one job is read from one block, and columns that are not asked for are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.functions.scalars import job_epoch, job_seq
from jobtrail.operators.files import batches, pending
from jobtrail.sources.folders import exists, overwrite_partitions

#: Ids of one block.
BLOCK = 1000
PARTS = ("cluster", "job_epoch", "block")
RAW = ("conf", "history")


def write_raw(raw: DataFrame, folder: str, ids: int = BLOCK) -> None:
    """Store rows (cluster, job_id, ...); blocks that raw has rows of are written anew with what else they had.

    A block has so many ids; a store is written and read with one number of them. A job that is there
    already is replaced as a whole; ids that are no job_<epoch>_<sequence> fail.
    """
    spark, bad = raw.sparkSession, F.concat(F.lit("not a job id: "), F.coalesce("job_id", F.lit("none")))
    number = lambda of: F.coalesce(of(F.col("job_id")), F.raise_error(bad).cast("bigint"))
    rows = raw.withColumns({"job_epoch": number(job_epoch), "job_seq": number(job_seq)}).withColumn("block", F.floor(F.col("job_seq") / ids).cast("bigint"))
    if exists(spark, folder):
        there = raw_store(spark, folder)
        touched, new = rows.select(*PARTS).distinct(), rows.select("cluster", "job_id")
        kept = there.join(touched, list(PARTS), "left_semi").join(new, ["cluster", "job_id"], "left_anti")
        rows = rows.unionByName(kept, allowMissingColumns=True)
    # what is read of the folder lies in partitions that are replaced only when all is written
    overwrite_partitions(rows.repartition(*PARTS).sortWithinPartitions(*PARTS, "job_seq"), folder, *PARTS)


def raw_store(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def parsed(job_id: str) -> tuple[int, int]:
    _, epoch, seq = job_id.split("_")
    return int(epoch), int(seq)


def in_range(raw: DataFrame, cluster: str, least: str | None = None, most: str | None = None, ids: int = BLOCK) -> DataFrame:
    """Rows of a cluster from one job id to another, both of them included; without one that side is open.

    Ids compare by epoch, then by sequence, as numbers. Every bound is also put on the partitions.
    """
    c = F.col
    raw = raw.where(c("cluster") == cluster)
    if least:
        epoch, seq = parsed(least)
        raw = raw.where((c("job_epoch") > epoch) | (c("job_epoch") == epoch) & (c("block") >= seq // ids)).where((c("job_epoch") > epoch) | (c("job_seq") >= seq))
    if most:
        epoch, seq = parsed(most)
        raw = raw.where((c("job_epoch") < epoch) | (c("job_epoch") == epoch) & (c("block") <= seq // ids)).where((c("job_epoch") < epoch) | (c("job_seq") <= seq))
    return raw


def scan(raw: DataFrame, cluster: str, least: str | None = None, most: str | None = None, reprocess: bool = False, include_raw: bool = False, ids: int = BLOCK) -> DataFrame:
    """Jobs of a range that are ready: both files there and not yet processed; with reprocess those that are marked for it. Contents only if asked for."""
    rows = in_range(raw, cluster, least, most, ids)
    both = (F.coalesce("conf_mtime", F.lit(0)) > 0) & (F.coalesce("history_mtime", F.lit(0)) > 0)
    ready = rows.where(both & (F.coalesce("reprocess", F.lit("")) == "true")) if reprocess else pending(rows)
    return ready if include_raw else ready.drop(*RAW)


def of_job(raw: DataFrame, cluster: str, job_id: str, ids: int = BLOCK) -> DataFrame:
    """The row of one job, from the one block that may have it."""
    epoch, seq = parsed(job_id)
    c = F.col
    return raw.where((c("cluster") == cluster) & (c("job_epoch") == epoch) & (c("block") == seq // ids) & (c("job_seq") == seq))


def content(raw: DataFrame, cluster: str, job_id: str, what: str = "history", as_text: bool = True, ids: int = BLOCK) -> str | bytes | None:
    """The configuration or history of one job as text or bytes; none if the job, or that file of it, is not there."""
    row = of_job(raw, cluster, job_id, ids).select(F.col(what).cast("string" if as_text else "binary")).first()
    return None if row is None or row[0] is None else row[0] if as_text else bytes(row[0])


def ranges(raw: DataFrame, cluster: str, least: str | None, most: str | None, size: int, reprocess: bool = False, ids: int = BLOCK) -> DataFrame:
    """Consecutive ranges of so many ready jobs: min_id and max_id of each, as ids, and how many jobs it has."""
    ready = scan(raw, cluster, least, most, reprocess, ids=ids).select("job_epoch", "job_seq", "job_id").withColumn("mtime", F.col("job_epoch")).withColumn("id", F.col("job_seq"))
    place = F.struct("job_epoch", "job_seq")
    return batches(ready, size).groupBy("batch").agg(F.min_by("job_id", place).alias("min_id"), F.max_by("job_id", place).alias("max_id"), F.count("*").alias("jobs"))
