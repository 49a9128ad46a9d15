"""File listings, raw status, process records and row-level upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modified_between(files: DataFrame, low: int, high: int) -> DataFrame:
    """Files with low < mtime <= high."""
    return files.where((F.col("mtime") > low) & (F.col("mtime") <= high))


def prune_oversized(files: DataFrame, most: int) -> DataFrame:
    """Without files larger than most and all files of the same job."""
    large = files.where(F.col("size") > most).select("job_id").distinct()
    return files.join(large, "job_id", "left_anti")


#: Files without a modification time are sorted as if it were this.
LEAST = -(1 << 63)


def range_cuts(files: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Pairs (mtime, id) that cut the files into about so many equal ranges; a hot time is cut by id."""
    at = F.coalesce("mtime", F.lit(LEAST))
    times = files.select(F.percentile_approx(at, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    hot = {t: times.count(t) for t in times if times.count(t) > 1}
    cuts = [(t, LEAST) for t in set(times)]
    if hot:
        most = max(hot.values())
        share = F.percentile_approx("id", [k / most for k in range(1, most)], 10_000)
        for r in files.select(at.alias("at"), "id").where(F.col("at").isin(list(hot))).groupBy("at").agg(share.alias("ids")).collect():  # at most parts rows
            cuts += [(r["at"], i) for i in set(r.ids)]
    return sorted(cuts)


def batches(files: DataFrame, size: int, parts: int = 200) -> DataFrame:
    """Consecutive batches of files by (mtime, id); files without mtime come first.

    The rows of each of so many ranges are counted, so a file's number is that of the ranges before
    plus its place within its own: no task ranks the whole, or a hot day, or a hot time.
    """
    cuts = range_cuts(files, parts) if parts > 1 else []
    key = F.struct(F.coalesce("mtime", F.lit(LEAST)).alias("t"), F.col("id").cast("bigint").alias("i"))
    bounds = [F.struct(F.lit(t).cast("bigint").alias("t"), F.lit(i).cast("bigint").alias("i")) for t, i in cuts]
    part = F.size(F.filter(F.array(*bounds), lambda b: b <= key)) if bounds else F.lit(0)
    ranged = files.withColumn("part", part)
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_first("mtime"), "id"))
    batch = F.floor((F.col("before") + place - 1) / size).cast("bigint")
    return ranged.join(F.broadcast(before), "part").withColumn("batch", batch).drop("part", "before")


def batch_min_max(batched: DataFrame) -> DataFrame:
    return batched.groupBy("batch").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.min("mtime").alias("min_mtime"), F.max("mtime").alias("max_mtime"), F.count("*").alias("files"))


def retain_newest(files: DataFrame, n: int, group: str) -> DataFrame:
    """The newest n files of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("mtime"), F.desc("id")))
    return files.withColumn("place", place).where(F.col("place") <= n)


def by_day(mtime: Column) -> list[Column]:
    """Year, month and day of a modification time in UTC, for partitioned writing."""
    at = F.timestamp_millis(mtime)
    return [F.date_format(at, f).alias(n) for n, f in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))]


def pending(raw: DataFrame) -> DataFrame:
    """Jobs with both files that are not yet processed or are to be processed again."""
    both = (F.coalesce("conf_mtime", F.lit(0)) > 0) & (F.coalesce("history_mtime", F.lit(0)) > 0)
    todo = (F.coalesce("reprocess", F.lit("")) == "true") | (F.coalesce("success", F.lit("")) != "true")
    return raw.where(both & todo)


def partial(raw: DataFrame) -> DataFrame:
    """Jobs that lack one of the files."""
    return raw.where(F.col("conf_mtime").isNull() | F.col("history_mtime").isNull())


def partial_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs without an id of their own."""
    return jobs.where(F.coalesce("job_id", F.lit("")) == "")


def to_reprocess(raw: DataFrame, job_seqs: DataFrame, again: bool = True) -> DataFrame:
    """Raw files with the jobs of job_seqs marked to be processed again, or that mark taken off."""
    marked = job_seqs.select("job_seq", F.lit(True).alias("marked")).distinct()
    flag = F.when(F.col("marked"), F.lit("true" if again else None).cast("string")).otherwise(F.col("reprocess"))
    return raw.join(marked, "job_seq", "left").withColumn("reprocess", flag).select(*raw.columns)


def paired(confs: DataFrame, histories: DataFrame) -> DataFrame:
    return confs.join(histories, "job_seq")


def records_by_state(records: DataFrame, state: int | None = None, within: str | None = None, other: bool = False) -> DataFrame:
    """Records of a state, or with other those not of it, whose manifest's path has a text in it."""
    same = F.col("state") != state if other else F.col("state") == state
    records = records.where(same) if state is not None else records
    return records.where(F.col("manifest").contains(within)) if within else records


def latest_record(records: DataFrame) -> DataFrame:
    """The newest record that is past its creation; of equally new ones the first by manifest."""
    return records.where("state <> 0").orderBy(F.desc("max_mtime"), "manifest").limit(1)


def records_listing(records: DataFrame) -> DataFrame:
    """All records, oldest first, with the number of files so far."""
    so_far = F.sum("files").over(Window.orderBy("max_mtime", "manifest"))  # a row for each batch of files: few
    return records.withColumn("files_so_far", so_far).orderBy("max_mtime", "manifest")


def record_of_batch(batched: DataFrame, folder: str) -> DataFrame:
    """A process record per batch: its time span, number of files, manifest path, and the first state (preprocessed)."""
    g = batch_min_max(batched)
    return g.select("batch", "max_mtime", "min_mtime", "files", "min_id", "max_id", F.lit(1).alias("state"), F.concat(F.lit(folder.rstrip("/") + "/batch="), F.col("batch").cast("string")).alias("manifest"))


def with_state(records: DataFrame, manifests: list[str], state: int) -> DataFrame:
    """The records with some of them in another state."""
    return records.withColumn("state", F.when(F.col("manifest").isin(manifests), state).otherwise(F.col("state")))


def outcome(rows: DataFrame, ok: Column) -> DataFrame:
    """Counts of rows that were taken and that failed."""
    return rows.agg(F.count_if(ok).alias("success"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("error"))


def upsert_collapse(rows: DataFrame, key: str, ordinal: str, columns: list[str]) -> DataFrame:
    """One row per key; of each column the last value that is not null."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*last)
