"""Domain views (jobs, tasks, counters, events, ...) over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.functions.scalars import format_job_id
from jobtrail.operators.flows import DERIVED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(c: str) -> Column:
    """Epoch milliseconds of a zone-less time taken as UTC."""
    return F.unix_millis(F.col(c).cast("timestamp"))


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("job_seq"), F.col("l_quantity").cast("bigint").alias("slot_millis"), ms("l_shipdate").alias("finish"), F.col("l_linestatus").alias("task_status"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: key (cluster, user, app, run_id, job_seq), times, queue, measures."""
    orders, customer, nation, region = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    spans = tasks(spark, sf_dir).groupBy("job_seq").agg(F.min("finish").alias("launch"), F.max("finish").alias("finish"), F.count("*").alias("total_maps"), F.sum("slot_millis").alias("slot_millis"))
    places = customer.join(F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")
    month = F.unix_millis(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")))
    base = orders.join(places, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("r_name").alias("cluster"), F.col("c_mktsegment").alias("user"), F.col("o_orderpriority").alias("app"), month.alias("run_id"), F.col("o_orderkey").alias("job_seq"),
        F.col("o_orderstatus").alias("status"), F.col("n_name").alias("queue"), F.year("o_orderdate").cast("string").alias("version"), ms("o_orderdate").alias("submit"), cents("o_totalprice").alias("mb_millis"),
    )
    return base.join(spans, "job_seq", "left").select(*base.columns, "launch", "finish", F.coalesce("total_maps", F.lit(0)).cast("bigint").alias("total_maps"), F.coalesce("slot_millis", F.lit(0)).cast("bigint").alias("slot_millis"))


def jobs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jobs() with the further measures and the hadoop version (a third has none)."""
    j, c = jobs(spark, sf_dir), F.col
    reduces = c("total_maps") % 3
    more = {
        "total_reduces": reduces, "map_file_bytes_read": c("total_maps") * 100, "map_file_bytes_written": c("total_maps") * 50, "reduce_file_bytes_read": reduces * 70,
        "hdfs_bytes_read": c("slot_millis") * 1024, "hdfs_bytes_written": c("slot_millis") * 512 + c("job_seq") % 7, "map_slot_millis": c("slot_millis"), "reduce_slot_millis": c("slot_millis") * 3,
        "cost": c("mb_millis") % 1000, "reduce_shuffle_bytes": reduces * 30, "hadoop_version": F.when(c("job_seq") % 3 == 0, "ONE").when(c("job_seq") % 3 == 1, "TWO"),
    }
    return j.select("*", *(v.alias(k) for k, v in more.items()))


def scoped_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as counters in three scopes, by part key, under both naming schemes."""
    t = table(spark, sf_dir, "lineitem")
    known = F.array(*(F.struct(F.lit(scope).alias("scope"), F.lit(g).alias("group"), F.lit(name).alias("name")) for _, scope, group, name in DERIVED for g in group))
    return t.select(F.col("l_orderkey").alias("job_seq"), known[(F.col("l_partkey") % (2 * len(DERIVED))).cast("int")].alias("k"), F.col("l_quantity").cast("bigint").alias("value")).select("job_seq", "k.*", "value")


def raw_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tasks whose columns are all text."""
    t, text = table(spark, sf_dir, "lineitem"), lambda c: F.col(c).cast("string")
    no = text("l_linenumber")
    return t.select(
        F.col("l_orderkey").alias("job_seq"), F.concat(F.lit("task_"), no).alias("task_id"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("status"), F.concat(F.lit("attempt_"), no).alias("attempt_id"),
        F.concat(F.lit("tracker_"), F.col("l_linestatus")).alias("tracker_name"), F.concat(F.lit("host"), text("l_suppkey")).alias("hostname"), F.lit("").alias("state"), F.lit(None).cast("string").alias("error"),
        ms("l_shipdate").cast("string").alias("start_time"), (ms("l_shipdate") + F.col("l_linenumber") * 1000).cast("string").alias("finish_time"), F.when(F.col("l_linenumber") % 2 == 0, no).otherwise("none").alias("shuffle_finished"), F.lit(None).cast("string").alias("sort_finished"), text("l_suppkey").alias("http_port"),
        F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, F.concat(F.lit("a,b,"), no)).otherwise(no).alias("splits"),
    )


def storage_measures() -> list[Column]:
    """The measures of storage that are made from k."""
    k = prop_k()
    made = {"dir_count": k % 5, "quota": k * 10, "space_quota": k * 1000, "tmp_file_count": k % 7, "tmp_space_consumed": k % 11, "trash_file_count": k % 3, "trash_space_consumed": k % 13, "access_cost": k * 2, "storage_cost": k * 3}
    return [v.alias(n) for n, v in made.items()]


def jobs_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; several runs fall into a day."""
    e = table(spark, sf_dir, "events")
    hour = F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return e.select(
        F.col("event_type").alias("cluster"), (F.col("user_id") % 10).cast("string").alias("user"), (F.col("user_id") % 3).cast("string").alias("app"), hour.alias("run_id"), F.col("event_id").alias("job_seq"),
        ms("ts").alias("submit"), (prop_k() % 4).cast("string").alias("queue"), cents("value").alias("mb_millis"), F.lit(1).cast("bigint").alias("total_maps"), prop_k().alias("slot_millis"),
    )


def prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("job_seq"), F.col("l_returnflag").alias("group"), F.col("l_linestatus").alias("name"), F.col("l_quantity").cast("bigint").alias("value"))


def flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = ms("ts") - ms("ts") % 86_400_000
    return e.select(F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("app"), day.alias("run_id"), F.col("event_id").alias("sequence"), ms("ts").alias("at"), F.col("props").alias("data"))


def flow_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    status = F.when(F.col("status") == "O", "r").when(F.col("status") == "F", "s").otherwise("f")
    return j.select("cluster", status.alias("status"), F.col("submit").alias("at"), F.col("job_seq").alias("flow_id"), F.col("user").alias("username"), F.col("app").alias("flowname"))


def hdfs_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seconds = F.floor(ms("ts") / 1000).cast("bigint")
    return e.select(
        F.col("event_type").alias("cluster"), F.concat(F.lit("/user/"), (F.col("user_id") % 10).cast("string")).alias("path"), (seconds - seconds % 3600).alias("hour"), (prop_k() % 3).cast("string").alias("namespace"),
        cents("value").alias("space_consumed"), prop_k().alias("access_count"), F.lit(1).cast("bigint").alias("file_count"), F.col("user_id").cast("string").alias("owner"), *storage_measures(),
    )


def conf(spark: SparkSession, sf_dir: str, full: bool = False) -> DataFrame:
    """Events as jobs with a configuration map made from k; full ones have versions and run times of frameworks too."""
    e = table(spark, sf_dir, "events")
    k = prop_k()
    text = k.cast("string")
    pairs = [
        ("pig.version", F.when(k % 3 == 0, "0.12")), ("cascading.flow.id", F.when(k % 3 == 1, F.concat(F.lit("AB"), text))), ("batch.desc", F.when(k % 5 == 0, F.concat(F.lit("batch! "), text))),
        ("mapred.job.name", F.when(k % 2 == 0, F.concat(F.lit("job "), text, F.lit(" [step]")))), ("mapreduce.job.name", F.concat(F.lit("name "), text)),
        ("mapreduce.job.queuename", F.when(k % 4 == 0, "default").when(k % 4 == 1, F.concat(F.lit("q"), text))), ("mapred.fairscheduler.pool", F.when(k % 4 == 2, F.concat(F.lit("pool"), text))), ("user.name", F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))),
    ]
    stamp = lambda when, base: F.when(when, (k + base).cast("string"))
    pairs += [
        ("pig.script.version", F.when(k % 6 == 0, F.concat(F.lit("v"), text))), ("pig.logfile", F.concat(F.lit("/tmp/pig_"), stamp(k % 9 == 0, 1_700_000_000_000), F.lit(".log"))), ("scalding.flow.class.signature", F.when(k % 6 == 4, F.concat(F.lit("sig"), text))),
        ("scalding.flow.submitted.timestamp", stamp(k % 7 == 1, 1_600_000_000_000)), ("mapred.app.submitted.timestamp", stamp(k % 7 == 2, 1_500_000_000_000)),
    ] if full else []
    entries = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in pairs)), lambda x: x["value"].isNotNull())
    return e.select("event_id", "user_id", "ts", F.map_from_entries(entries).alias("conf"), k.alias("k"))


def raw_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files of jobs: the order stands for the conf file, its first line item for the history file."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_seq"), ms("o_orderdate").alias("conf_mtime"), F.col("o_orderstatus").alias("status"))
    h = tasks(spark, sf_dir).groupBy("job_seq").agg(F.min("finish").alias("history_mtime"))
    success = F.when(F.col("status") == "F", "true").when(F.col("status") == "O", "false")
    return o.join(h, "job_seq", "full").select("job_seq", "conf_mtime", "history_mtime", success.alias("success"), F.when(F.col("job_seq") % 11 == 0, "true").alias("reprocess"))


def process_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per order day: batch of files with its newest time and a state 0 to 3."""
    o = table(spark, sf_dir, "orders").select(ms("o_orderdate").alias("at"), F.col("o_orderkey").alias("job_seq"))
    day = (F.col("at") - F.col("at") % 86_400_000).alias("day")
    g = o.groupBy(day).agg(F.max("at").alias("max_mtime"), F.min("at").alias("min_mtime"), F.count("*").alias("files"), F.min("job_seq").alias("min_job"), F.max("job_seq").alias("max_job"))
    return g.withColumn("state", (F.floor(F.col("day") / 86_400_000) % 4).cast("int")).withColumn("manifest", F.concat(F.lit("/process/"), F.col("day").cast("string")))


def process_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries of a record for each order day: as many steps as the day says, and a failure at the end of every fifth."""
    o = table(spark, sf_dir, "orders").select(ms("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    day = F.floor(F.col("at") / 86_400_000).cast("bigint")
    g = o.groupBy(day.alias("batch")).agg(F.min("at").alias("min_mtime"), F.max("at").alias("max_mtime"), F.count("*").alias("files"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
    b = F.col("batch")
    last = (b % 4).cast("int")
    steps = F.concat(F.transform(F.sequence(F.lit(0), last), lambda s: F.struct(s.alias("step"), s.alias("state"))), F.when(b % 5 == 0, F.array(F.struct((last + 1).alias("step"), F.lit(0).alias("state")))).otherwise(F.array().cast("array<struct<step:int,state:int>>")))
    return g.select("*", F.concat(F.lit("c"), (b % 3).cast("string")).alias("cluster"), F.concat(F.lit("run"), F.floor(b / 30).cast("string")).alias("run"), F.explode(steps).alias("e")).select("*", "e.step", "e.state", F.concat(F.lit("/m/"), b.cast("string")).alias("manifest")).drop("e")


def raw_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_status() as rows of a raw store: ids of three epochs and two clusters, with contents."""
    r, seq = raw_status(spark, sf_dir), F.col("job_seq")
    job = format_job_id(seq % 3 + 1000, seq)
    return r.select(F.concat(F.lit("c"), (seq % 2).cast("string")).alias("cluster"), job.alias("job_id"), "conf_mtime", "history_mtime", "success", "reprocess", F.concat(F.lit("<conf>"), job, F.lit("</conf>")).alias("conf"), F.concat(F.lit("history of "), job).cast("binary").alias("history"))
