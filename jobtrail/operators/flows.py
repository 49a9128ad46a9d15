"""Flows: all jobs of one run of an application (cluster, user, app, run_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

APP = ("cluster", "user", "app")
FLOW = (*APP, "run_id")


def in_window(jobs: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """Runs in (start, end]; 0 leaves that side open. A run exactly at start is out."""
    jobs = jobs.where(F.col("run_id") > start) if start else jobs
    return jobs.where(F.col("run_id") <= end) if end else jobs


def of_version(jobs: DataFrame, version: str | None) -> DataFrame:
    """Jobs of a version; those without one pass. A flow may come back in part."""
    return jobs.where((F.col("version") == version) | F.col("version").isNull()) if version else jobs


def flow_rollup(jobs: DataFrame, keys: tuple = FLOW) -> DataFrame:
    """Sums per flow; queue of the job submitted first, version of the last by id."""
    return jobs.groupBy(*keys).agg(
        F.count("*").alias("job_count"), F.sum("total_maps").alias("total_maps"), F.sum("slot_millis").alias("slot_millis"), F.sum("mb_millis").alias("mb_millis"),
        F.min_by("queue", F.struct("submit", "job_seq")).alias("queue"), F.max_by("version", "job_seq").alias("version"),
    )


#: Measures of a job that a flow sums.
MEASURES = (
    "total_maps", "total_reduces", "map_file_bytes_read", "map_file_bytes_written", "reduce_file_bytes_read", "hdfs_bytes_read", "hdfs_bytes_written",
    "map_slot_millis", "reduce_slot_millis", "mb_millis", "cost", "reduce_shuffle_bytes",
)


def flow_sums(jobs: DataFrame, keys: tuple = FLOW) -> DataFrame:
    """Job count and the sum of every measure per flow; queue and hadoop version of the job submitted first, version of the last by id."""
    first = lambda c: F.min_by(c, F.struct("submit", "job_seq")).alias(c)
    return jobs.groupBy(*keys).agg(F.count("*").alias("job_count"), *(F.sum(m).alias(m) for m in MEASURES), first("queue"), first("hadoop_version"), F.max_by("version", "job_seq").alias("version"))


def flow_wallclock(jobs: DataFrame) -> DataFrame:
    """Least submit and launch (0 is unset), largest finish, duration and wall clock."""
    unset = lambda c: F.nullif(F.col(c), F.lit(0))
    g = jobs.groupBy(*FLOW).agg(F.min(unset("submit")).alias("submit"), F.min(unset("launch")).alias("launch"), F.max("finish").alias("finish"))
    return g.withColumn("duration", F.col("finish") - F.col("launch")).withColumn("wall_clock", F.col("finish") - F.col("submit"))


def flow_rollup_zero_run(jobs: DataFrame) -> DataFrame:
    """As flow_rollup, but every job with run id 0 is a flow of its own."""
    own = F.when(F.col("run_id") == 0, F.col("job_seq")).otherwise(F.lit(0)).alias("own_job")
    return flow_rollup(jobs.withColumn("own_job", own), (*FLOW, "own_job"))


def flow_counters(jobs: DataFrame, counters: DataFrame) -> DataFrame:
    """Sum of each counter over a flow's jobs, a row per (flow, group, name)."""
    per_job = counters.groupBy("job_seq", "group", "name").agg(F.sum("value").alias("value"))
    return per_job.join(jobs.select(*FLOW, "job_seq"), "job_seq").groupBy(*FLOW, "group", "name").agg(F.sum("value").alias("value"))


def flow_counters_by_scope(jobs: DataFrame, counters: DataFrame) -> DataFrame:
    """As flow_counters, apart for the scopes total, map and reduce."""
    per_job = counters.groupBy("job_seq", "scope", "group", "name").agg(F.sum("value").alias("value"))
    return per_job.join(jobs.select(*FLOW, "job_seq"), "job_seq").groupBy(*FLOW, "scope", "group", "name").agg(F.sum("value").alias("value"))


def counter_maps(flow_counters: DataFrame) -> DataFrame:
    """Long-form counters of flows as one map per scope: "group.name" -> value; an empty one for a scope without counters."""
    entry = F.struct(F.concat_ws(".", "group", "name"), "value")
    of = lambda scope: F.map_from_entries(F.collect_list(F.when(F.col("scope") == scope, entry))).alias(f"{scope}_counters")
    return flow_counters.groupBy(*FLOW).agg(*map(of, SCOPES))


def flow_series(jobs: DataFrame, n: int, start: int = 0, end: int = 0, version: str | None = None) -> DataFrame:
    """The jobs of each application's last n flows; ranks flows, not jobs, so that a hot application's jobs are never in one task."""
    jobs = of_version(in_window(jobs, start, end), version)
    rank = F.row_number().over(Window.partitionBy(*APP).orderBy(F.desc("run_id")))
    last = jobs.select(*FLOW).distinct().withColumn("flow_rank", rank).where(F.col("flow_rank") <= n)
    return jobs.join(last, list(FLOW)).select(*jobs.columns, "flow_rank")


def latest_flow(jobs: DataFrame) -> DataFrame:
    return flow_series(jobs, 1)


def flow_by_key(jobs: DataFrame, cluster: str, user: str, app: str, run_id: int) -> DataFrame:
    return jobs.where((F.col("cluster") == cluster) & (F.col("user") == user) & (F.col("app") == app) & (F.col("run_id") == run_id))


def job_by_id(jobs: DataFrame, job_seq: int) -> DataFrame:
    return jobs.where(F.col("job_seq") == job_seq)


def flow_by_job_id(jobs: DataFrame, job_seq: int) -> DataFrame:
    """All jobs of the flow that holds a job."""
    return jobs.join(F.broadcast(job_by_id(jobs, job_seq).select(*FLOW)), list(FLOW), "left_semi")


def flow_stats_page(jobs: DataFrame, size: int, cursor: int | None = None) -> DataFrame:
    """One page of flow statistics per application; the row after the page gives the next cursor."""
    jobs = jobs.where(F.col("run_id") <= cursor) if cursor is not None else jobs
    page = flow_rollup(flow_series(jobs, size + 1))
    rank = F.row_number().over(Window.partitionBy(*APP).orderBy(F.desc("run_id")))
    marked = page.withColumn("place", rank)
    following = F.max(F.when(F.col("place") == size + 1, F.col("run_id"))).over(Window.partitionBy(*APP))
    return marked.withColumn("next_run_id", following).where(F.col("place") <= size)


def flow_with_tasks(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Jobs with count and sum of their tasks; 0 where there are none."""
    per_job = tasks.groupBy("job_seq").agg(F.count("*").alias("task_count"), F.sum("slot_millis").alias("task_slot_millis"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return jobs.select(*FLOW, "job_seq").join(per_job, "job_seq", "left").select(*FLOW, "job_seq", zero("task_count"), zero("task_slot_millis"))


def flow_task_rows(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each job of a flow beside each of its tasks; a job without tasks stays, a task of no job goes."""
    return jobs.select(*FLOW, "job_seq").join(tasks, "job_seq", "left")


def of_status(jobs: DataFrame, status: str | None, framework: str | None = None) -> DataFrame:
    """Jobs of a status, of which those without one pass; of a framework those without one do not."""
    jobs = jobs.where((F.col("status") == status) | F.col("status").isNull()) if status else jobs
    return jobs.where(F.col("framework") == framework) if framework else jobs


def submitted_between(jobs: DataFrame, start: int, end: int) -> DataFrame:
    """Jobs with start <= submit < end."""
    return jobs.where((F.col("submit") >= start) & (F.col("submit") < end))


def job_tasks(tasks: DataFrame, job_seq: int) -> DataFrame:
    return tasks.where(F.col("job_seq") == job_seq)


def remove_job(jobs: DataFrame, tasks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and tasks without those of the job_seqs in gone."""
    ids = gone.select("job_seq").distinct()
    return jobs.join(ids, "job_seq", "left_anti"), tasks.join(ids, "job_seq", "left_anti")


#: Scopes of counters, and of each derived measure its scope, its group under either naming scheme, and its name.
SCOPES = ("total", "map", "reduce")
FILES = ("FileSystemCounters", "org.apache.hadoop.mapreduce.FileSystemCounter")
SLOTS = ("org.apache.hadoop.mapred.JobInProgress$Counter", "org.apache.hadoop.mapreduce.JobCounter")
TASKS = ("org.apache.hadoop.mapred.Task$Counter", "org.apache.hadoop.mapreduce.TaskCounter")
DERIVED = (
    ("map_file_bytes_read", "map", FILES, "FILE_BYTES_READ"),
    ("map_file_bytes_written", "map", FILES, "FILE_BYTES_WRITTEN"),
    ("reduce_file_bytes_read", "reduce", FILES, "FILE_BYTES_READ"),
    ("hdfs_bytes_read", "total", FILES, "HDFS_BYTES_READ"),
    ("hdfs_bytes_written", "total", FILES, "HDFS_BYTES_WRITTEN"),
    ("map_slot_millis", "total", SLOTS, "SLOTS_MILLIS_MAPS"),
    ("reduce_slot_millis", "total", SLOTS, "SLOTS_MILLIS_REDUCES"),
    ("reduce_shuffle_bytes", "reduce", TASKS, "REDUCE_SHUFFLE_BYTES"),
)


def job_details(jobs: DataFrame, counters: DataFrame) -> DataFrame:
    """Per job the measures derived from its counters (job_seq, scope, group, name, value).

    Groups are named by the job's hadoop_version, ONE or TWO; a job without one is ONE. A missing counter is 0.
    """
    version = jobs.select("job_seq", F.coalesce("hadoop_version", F.lit("ONE")).alias("hadoop_version"))
    two = F.col("hadoop_version") == "TWO"
    known = counters.where(F.col("name").isin([n for *_, n in DERIVED])).join(version, "job_seq")
    of = lambda scope, group, name: (F.col("scope") == scope) & (F.col("group") == F.when(two, group[1]).otherwise(group[0])) & (F.col("name") == name)
    sums = known.groupBy("job_seq").agg(*(F.sum(F.when(of(*where), F.col("value"))).alias(m) for m, *where in DERIVED))
    return version.join(sums, "job_seq", "left").select("job_seq", "hadoop_version", *(F.coalesce(m, F.lit(0)).cast("bigint").alias(m) for m, *_ in DERIVED))


#: Columns of a task by type; splits are a list written with commas.
TASK_TEXTS = ("task_id", "type", "status", "attempt_id", "tracker_name", "hostname", "state", "error")
TASK_NUMBERS = ("start_time", "finish_time", "shuffle_finished", "sort_finished", "http_port")


def task_details(tasks: DataFrame) -> DataFrame:
    """Tasks as typed columns from text ones; a text that is no number is 0, one without splits has none."""
    number = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)).alias(c)
    splits = F.when(F.coalesce("splits", F.lit("")) != "", F.split("splits", ",")).otherwise(F.array().cast("array<string>"))
    return tasks.select("job_seq", *TASK_TEXTS, *map(number, TASK_NUMBERS), splits.alias("splits"))


def in_key_order(df: DataFrame) -> DataFrame:
    """By application, newest run first, then by job."""
    return df.orderBy(*APP, F.desc("run_id"), *(["job_seq"] if "job_seq" in df.columns else []))


def counter_include(counters: DataFrame, names: list[str]) -> DataFrame:
    """Counters whose group.name is one of the names, summed per job."""
    kept = counters.where(F.concat_ws(".", "group", "name").isin(names))
    return kept.groupBy("job_seq", "group", "name").agg(F.sum("value").alias("value"))


def from_row(flows: DataFrame, row: tuple) -> DataFrame:
    """Flows at or behind a row key (cluster, user, app, run_id) in key order: newest run first within an application.

    The first column is bounded by itself too, so that readers can skip what lies before it.
    """
    cluster, user, app, run_id = row
    c = F.col
    behind = (c("cluster") > cluster) | (c("cluster") == cluster) & ((c("user") > user) | (c("user") == user) & ((c("app") > app) | (c("app") == app) & (c("run_id") <= run_id)))
    return flows.where((c("cluster") >= cluster) & behind)


def flow_page(flows: DataFrame, size: int, row: tuple | None = None, app: tuple = ()) -> DataFrame:
    """A page of flows in key order from a row key on, and the row behind it, which begins the next page.

    app narrows the pages to a cluster, to one of its users, or to one of its applications.
    """
    for name, value in zip(APP, app):
        flows = flows.where(F.col(name) == value)
    flows = from_row(flows, row) if row else flows
    return flows.orderBy(*APP, F.desc("run_id")).limit(size + 1)


def next_row(page: DataFrame, size: int) -> tuple | None:
    """Where the page behind this one begins; none behind the last."""
    rows = page.orderBy(*APP, F.desc("run_id")).select(*FLOW).offset(size).take(1)
    return tuple(rows[0]) if rows else None
