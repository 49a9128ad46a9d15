"""Process records as an append-only log of states, and listings that go on from the newest of them.

A run lists files, cuts them into batches, writes a manifest of each batch and logs the batch's state
after every step. Entries are only added: what a record's state is, its newest entry says. A run has a
stamp of its own, so runs never meet in one folder; one that failed is started again under its stamp
and finds what it had done. Everything is by whole folders that Spark writes at once:

    listing/<run>            the files of the run, once
    manifests/run=<run>/batch=<n>
    log/run=<run>/step=<k>   an entry for each batch
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.operators.files import batch_min_max, batches
from jobtrail.sources.folders import exists, overwrite_partitions, written_once

#: Fixed: states of a record.
CREATED, PREPROCESSED, LOADED, PROCESSED = range(4)
RECORD = ("cluster", "run", "batch")
ENTRY = "cluster string, batch long, state int, min_mtime long, max_mtime long, files long, min_id long, max_id long, manifest string, run string, step int"


def new_run(now: int) -> str:
    """A stamp that sorts by time and that no other run has."""
    return f"{now:013d}-{uuid.uuid4().hex[:8]}"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of the log; none where nothing was logged."""
    path = f"{folder}/log"
    return spark.read.schema(ENTRY).parquet(path) if exists(spark, path) else spark.createDataFrame([], ENTRY)


def current(log: DataFrame) -> DataFrame:
    """Each record as its newest entry has it (the highest step; a step that ran twice replaced its own)."""
    rest = [c for c in log.columns if c not in RECORD]
    return log.groupBy(*RECORD).agg(F.max_by(F.struct(*rest), "step").alias("x")).select(*RECORD, *(f"x.{c}" for c in rest))


def append(records: DataFrame, folder: str, step: int) -> None:
    """Log records of one run as its step; the step run again replaces its entries, others are never touched."""
    overwrite_partitions(records.select(*(c.split()[0] for c in ENTRY.split(", ") if c != "step int")).withColumn("step", F.lit(step)), f"{folder}/log", "run", "step")


def low_water(records: DataFrame) -> DataFrame:
    """Per cluster from which modification time on files are to be listed, from records as they are now.

    `newest` is the end of the newest record past creation; `low` is that, or just before the first
    file of a batch that was never finished, if that is earlier.
    """
    begun, failed = F.col("state") != CREATED, F.col("state") == CREATED
    newest, oldest = F.max(F.when(begun, F.col("max_mtime"))), F.min(F.when(failed, F.col("min_mtime") - 1))
    return records.groupBy("cluster").agg(F.coalesce(newest, F.lit(0)).alias("newest"), F.coalesce(F.least(newest, oldest), F.lit(0)).alias("low"))


def manifests(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """The files of all manifests: the columns of files with batch and run."""
    path, schema = f"{folder}/manifests", f"{', '.join(f'{n} {t}' for n, t in files.dtypes)}, run string, batch long"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def unlisted(files: DataFrame, log: DataFrame, listed: DataFrame, cluster: str, now: int, lateness: int | None = None) -> DataFrame:
    """Files (id, mtime, ...) of a cluster that are to be processed in a run that begins now.

    These are the ones modified up to now that no manifest of a batch past creation has: new ones, ones
    that came late, and those of batches that failed. With a lateness, files modified longer than that
    before the low-water mark are not looked at any more; without one every file is. A newest record that
    is later than now is an error. Files without a modification time are always looked at.
    """
    records = current(log.where(F.col("cluster") == cluster))
    mark = low_water(records).first()  # one row of one cluster
    if mark and mark.newest > now:
        raise ValueError(f"the newest record is later than now: {mark.newest}")
    if mark and lateness is not None:
        files, listed = (df.where(F.col("mtime").isNull() | (F.col("mtime") > mark.low - lateness)) for df in (files, listed))
    past = records.where(F.col("state") != CREATED).select(F.col("run").alias("of_run"), F.col("batch").alias("of_batch"))
    done = listed.join(past, (F.col("run") == F.col("of_run")) & (F.col("batch") == F.col("of_batch")), "left_semi").select("id")
    return files.where(F.col("mtime").isNull() | (F.col("mtime") <= now)).join(done, "id", "left_anti")


def preprocess(files: DataFrame, folder: str, cluster: str, now: int, size: int, run: str | None = None, lateness: int | None = None) -> str:
    """One run over files (id, mtime, ...): list what is to be done, batch it, write manifests, log the states. Returns the run's stamp.

    A run that stopped anywhere is called again with its stamp: the listing is taken once, every later
    step is made from it, and all steps replace their own output. A run without files logs nothing.
    """
    spark, run = files.sparkSession, run or new_run(now)
    listing = f"{folder}/listing/{run}"
    if not exists(spark, f"{listing}/_SUCCESS"):
        log = entries(spark, folder).where(F.col("run") != run)
        written_once(batches(unlisted(files, log, manifests(spark, folder, files), cluster, now, lateness), size), listing)
    batched = spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in files.dtypes)}, batch long").parquet(listing)
    told = batch_min_max(batched).withColumns({"cluster": F.lit(cluster), "run": F.lit(run), "manifest": F.concat(F.lit(f"{folder}/manifests/run={run}/batch="), F.col("batch").cast("string"))})
    append(told.withColumn("state", F.lit(CREATED)), folder, 0)
    overwrite_partitions(batched.withColumn("run", F.lit(run)).repartition("batch"), f"{folder}/manifests", "run", "batch")
    append(told.withColumn("state", F.lit(PREPROCESSED)), folder, 1)
    return run


def advance(spark: SparkSession, folder: str, run: str, state: int, step: int, ok: Column | None = None) -> None:
    """Log a new state of a run's records, of all or of those that ok holds for; by default steps are numbered as states are."""
    now = current(entries(spark, folder).where((F.col("run") == run) & (F.col("step") < step)))
    append((now if ok is None else now.where(ok)).withColumn("state", F.lit(state)), folder, step)


def todo(records: DataFrame, state: int) -> DataFrame:
    """Records that have come to the state before this one and no further, oldest first: what the next step takes."""
    return records.where(F.col("state") == state - 1).orderBy("max_mtime", "run", "batch")
