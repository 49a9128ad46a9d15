"""Applications: daily and weekly rollups, summaries, versions, new applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.functions.scalars import day_bucket, week_bucket
from jobtrail.operators.flows import APP, MEASURES, in_window


def queues(c: str = "queue") -> Column:
    return F.concat_ws("!", F.array_sort(F.collect_set(c)))


def app_agg(jobs: DataFrame, bucket: Column) -> DataFrame:
    """Sums of the measures that jobs have per (bucket, application), distinct runs, and the set of queues as text."""
    sums = [F.sum(m).alias(m) for m in (*MEASURES, "slot_millis") if m in jobs.columns]
    return jobs.groupBy(bucket.alias("bucket"), *APP).agg(F.count("*").alias("total_jobs"), F.count_distinct("run_id").alias("number_runs"), *sums, queues().alias("queues"))


def app_agg_daily(jobs: DataFrame) -> DataFrame:
    return app_agg(jobs, day_bucket(F.col("run_id")))


def app_agg_weekly(jobs: DataFrame) -> DataFrame:
    return app_agg(jobs, week_bucket(F.col("run_id")))


def all_apps_summary(daily: DataFrame, start: int, end: int, limit: int = 0) -> DataFrame:
    """Daily rows of the days of start to end summed per application."""
    inside = daily.where(F.col("bucket").between(start - start % 86_400_000, end - end % 86_400_000))
    out = inside.groupBy(*APP).agg(
        F.min("bucket").alias("first_day"), F.max("bucket").alias("last_day"), F.sum("total_jobs").alias("total_jobs"), F.sum("number_runs").alias("number_runs"), F.sum("mb_millis").alias("mb_millis"),
        F.concat_ws("!", F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("queues", "!")))))).alias("queues"),
    )
    return out.orderBy(*APP).limit(limit) if limit else out


def app_versions(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(*APP, "version").agg(F.min("submit").alias("first_seen"))


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy(*APP).agg(F.max_by("version", F.struct("first_seen", "version")).alias("version"), F.max("first_seen").alias("first_seen"), F.count("*").alias("versions"))


def new_app_keys(versions: DataFrame, start: int, end: int) -> DataFrame:
    """Applications whose first version was first seen in [start, end]."""
    return versions.groupBy(*APP).agg(F.min("first_seen").alias("first_seen")).where(F.col("first_seen").between(start, end))


def new_apps(jobs: DataFrame, start: int, end: int) -> DataFrame:
    """New applications with their runs in (start, end]; possibly none."""
    keys = new_app_keys(app_versions(jobs), start, end)
    runs = in_window(jobs, start, end).groupBy(*APP).agg(F.count_distinct("run_id").alias("number_runs"), F.count("*").alias("total_jobs"), F.sum("mb_millis").alias("mb_millis"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return keys.join(runs, list(APP), "left").select(*APP, "first_seen", zero("number_runs"), zero("total_jobs"), zero("mb_millis"))


def versions_newest_first(versions: DataFrame) -> DataFrame:
    """Versions of every application, the one that appeared last at the top."""
    return versions.orderBy(*APP, F.desc("first_seen"), F.desc("version"))


def app_summary(flows: DataFrame) -> DataFrame:
    """Per application over its flows: runs, sums, the set of queues, first and last run. Cost is not summed."""
    return flows.groupBy(*APP).agg(
        F.count("*").alias("number_runs"), F.sum("job_count").alias("total_jobs"), F.sum("total_maps").alias("total_maps"), F.sum("total_reduces").alias("total_reduces"),
        F.sum("map_slot_millis").alias("map_slot_millis"), F.sum("reduce_slot_millis").alias("reduce_slot_millis"), F.sum("mb_millis").alias("mb_millis"), queues().alias("queues"),
        F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"),
    )


def app_cost(jobs: DataFrame, bucket: Column) -> DataFrame:
    """Cost summed per (bucket, application)."""
    return jobs.groupBy(bucket.alias("bucket"), *APP).agg(F.sum("cost").alias("cost"))


def job_statistics(jobs: DataFrame, measures: list[str], by_app: bool = False, order: str | None = None, limit: int = -1) -> DataFrame:
    """Job count and sums of chosen measures per user, or per user and application; largest of one measure first; -1 is no limit."""
    keys = ["user", "app"] if by_app else ["user"]
    sums = jobs.groupBy(*keys).agg(F.count("*").alias("jobs"), *(F.sum(m).alias(m) for m in measures))
    sums = sums.orderBy(F.desc(order), *keys) if order else sums
    return sums if limit < 0 else sums.limit(limit)


def job_level_statistics(jobs: DataFrame, limit: int = -1) -> DataFrame:
    """Sums per user and application, largest first; -1 is no limit."""
    g = jobs.groupBy("user", "app").agg(F.count("*").alias("jobs"), F.sum("mb_millis").alias("mb_millis"), F.sum("slot_millis").alias("slot_millis"))
    ordered = g.orderBy(F.desc("mb_millis"), "user", "app")
    return ordered if limit < 0 else ordered.limit(limit)
