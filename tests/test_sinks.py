"""Writers by round trips, side inputs, details of jobs and tasks, detail levels."""

from pyspark.sql import functions as F

from jobtrail.functions import scalars
from jobtrail.operators import files, flows, progress
from jobtrail.sources import edge, side, sinks
from jobtrail.streaming import incremental


def test_cost_and_cluster_properties(spark, tmp_path):
    (tmp_path / "costs.properties").write_text("# costs\ndefault.computecost=1.5\ndefault.machinememory = 2048\nbig.one.computecost: 3\nodd.machinememory=none\n\nother=1\n")
    props = side.properties(spark, str(tmp_path / "costs.properties"))
    costs = {r.machine: (r.compute_tco, r.machine_mb) for r in side.machine_costs(props).collect()}
    assert costs == {"default": (1.5, 2048), "big.one": (3.0, 0), "odd": (0.0, 0)}
    jobs = spark.createDataFrame([(1, "default", 2048 * 86400000), (2, "big.one", 5), (3, "nowhere", 5)], "job_seq long, machine string, mb_millis long")
    assert {r.job_seq: r["cost"] for r in side.with_cost(jobs, side.machine_costs(props), "machine").collect()} == {1: 1.5, 2: 0.0, 3: 0.0}
    (tmp_path / "clusters.properties").write_text("jt1.example=c1\njt2.example=c2\n")
    named = side.with_cluster(spark.createDataFrame([("jt1.example",), ("x",)], "host string"), side.properties(spark, str(tmp_path / "clusters.properties")), F.col("host"))
    assert {r.host: r.cluster for r in named.collect()} == {"jt1.example": "c1", "x": None}


def test_properties_by_the_rules_of_the_format(spark, tmp_path):
    text = "k = 9\nk = 10\nk=2\nlong=a\\\n   b\\\n  # no comment\nkey\\ with\\=odd\\:signs v w\n  ! none\ntab\\tin=x\\u00e9\\ny\nbare\nend=two\\\\\n: nameless\r\nlast:\\"
    (tmp_path / "a.properties").write_text(text)
    got = {r.key: r.value for r in side.properties(spark, str(tmp_path / "a.properties")).collect()}
    assert got == {"k": "2", "long": "ab# no comment", "key with=odd:signs": "v w", "tab\tin": "x\u00e9\ny", "bare": "", "end": "two\\", "": "nameless", "last": ""}


def test_raw_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "job_1_conf.xml").write_bytes(b"<x/>")
    r = side.raw_files(spark, str(tmp_path)).first()
    assert (r.file_name, bytes(r.content)) == ("job_1_conf.xml", b"<x/>") and r.mtime > 1_000_000_000_000


def test_job_row(spark):
    rows = [
        (1, {"pig.version": "0.12", "mapred.job.name": "PigLatin:report.pig", "pig.script.version": "v1", "user.name": "ann", "mapred.job.queue.name": "q1"}, 1000),
        (2, {"mapred.job.name": "plain job", "mapred.app.submitted.timestamp": "77", "user.name": "bob", "mapreduce.job.queuename": "default"}, 2000),
        (3, {}, 3000),
    ]
    out = {r.job_seq: r for r in side.job_row(spark.createDataFrame(rows, "job_seq long, conf map<string,string>, submit long")).collect()}
    assert (out[1].framework, out[1].version, out[1].user) == ("PIG", "v1", "ann") and (out[2].framework, out[2].run_id, out[2].queue) == ("NONE", 77, "bob")
    assert out[3].user is None and out[3].run_id == 3000


def test_history_is_written_once(spark, tmp_path):
    jobs = spark.createDataFrame([("c", d, k) for d in (1, 2) for k in (1, 2)], "cluster string, day int, job_seq long")
    for _ in range(2):
        sinks.write_history(jobs, jobs, jobs.where("day = 2"), str(tmp_path), "cluster", "day")
    assert [spark.read.parquet(f"{tmp_path}/{n}").count() for n in ("jobs", "tasks", "raw")] == [4, 4, 2]
    sinks.overwrite_partitions(jobs.where("day = 2 and job_seq = 1"), f"{tmp_path}/jobs", "cluster", "day")
    assert spark.read.parquet(f"{tmp_path}/jobs").count() == 3


def test_batches_manifests_and_records(spark, tmp_path):
    found = spark.createDataFrame([(1, 5), (2, None), (3, 6), (4, 6), (5, 6), (6, 6)], "id long, mtime long")
    assert {r.id: r.batch for r in files.batches(found, 2, 3).collect()} == {2: 0, 1: 0, 3: 1, 4: 1, 5: 2, 6: 2}
    hot = spark.range(1000).select("id", F.when(F.col("id") < 900, 7).otherwise(F.col("id")).alias("mtime"))
    assert all(r.batch == r.id // 10 for r in files.batches(hot, 10, 20).collect())
    assert len(files.range_cuts(hot, 20)) > 15
    records = sinks.write_batches(found, 2, str(tmp_path), "r1")
    assert sorted((r.batch, r.files, r.state) for r in records.collect()) == [(0, 2, 1), (1, 2, 1), (2, 2, 1)]
    more = sinks.write_batches(spark.createDataFrame([(7, 9), (8, 9)], "id long, mtime long"), 2, str(tmp_path), "r2")
    assert [(r.batch, r.files, r.run) for r in more.collect()] == [(0, 2, "r2")]
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/manifests").collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    for _ in range(2):
        sinks.put_records(records, f"{tmp_path}/records")
    sinks.put_records(records.where("batch = 1").withColumn("state", F.lit(3)), f"{tmp_path}/other")
    sinks.put_records(records.where("batch = 1"), f"{tmp_path}/other")
    assert sorted(r.state for r in spark.read.parquet(f"{tmp_path}/other").collect()) == [1, 3]
    kept = spark.read.parquet(f"{tmp_path}/records")
    done = files.with_state(kept, [f"{tmp_path}/manifests/run=r1/batch=1"], 3)
    assert kept.count() == 3 and {r.batch: r.state for r in done.collect()} == {0: 1, 1: 3, 2: 1}
    assert files.records_by_state(done, 3, other=True).count() == 2 and files.records_by_state(done, 3, "batch=1").count() == 1
    assert [r.files_so_far for r in files.records_listing(done).collect()][-1] == 6
    assert files.outcome(done, F.col("state") == 3).first().asDict() == {"success": 1, "error": 2}


def test_latest_record_of_equally_new_ones(spark):
    rows = [(5, 1, "/b"), (5, 1, "/a"), (9, 0, "/c")]
    assert files.latest_record(spark.createDataFrame(rows, "max_mtime long, state int, manifest string")).first().manifest == "/a"


def test_files_that_are_there_are_left(spark, tmp_path):
    day = 86_400_000
    sinks.partition_by_day(spark.createDataFrame([(1, 5), (2, day + 5)], "id long, mtime long"), f"{tmp_path}/days", "id")
    for _ in range(2):
        sinks.partition_by_day(spark.createDataFrame([(1, 6), (9, 7), (3, 2 * day)], "id long, mtime long"), f"{tmp_path}/days", "id")
    assert sorted((r.id, r.mtime) for r in spark.read.parquet(f"{tmp_path}/days").collect()) == [(1, 5), (2, day + 5), (3, 2 * day), (9, 7)]


def test_events_and_queue(spark, tmp_path):
    events = spark.createDataFrame([(1, "a"), (2, "b")], "sequence long, data string")
    for k in (1, 2):
        sinks.append_events(events.where(F.col("sequence") == k), f"{tmp_path}/events")
    assert progress.events_since(spark.read.parquet(f"{tmp_path}/events"), 1).first().data == "b"
    queue = spark.createDataFrame([("c", "r", 1, 10, "u", "f"), ("c", "r", 3, 11, "u", "f"), ("c", "r", 2, 12, "u", "f")], "cluster string, status string, at long, flow_id long, username string, flowname string")
    change = spark.createDataFrame([("c", "s", 9, 10, "u", "f"), ("c", "r", 8, 13, "u", "f")], queue.schema)
    now = progress.upserted(queue, change)
    assert [r.flow_id for r in progress.queue_by_status(now, "c", "r").collect()] == [13, 11, 12]
    assert [r.flow_id for r in progress.queue_by_status(now, "c", "s").collect()] == [10]


def test_jobs_are_aggregated_once(spark, tmp_path):
    jobs = spark.createDataFrame([(k,) for k in range(4)], "job_seq long")
    done = f"file://{tmp_path}/done"
    assert sinks.aggregate_once(spark, jobs.where("job_seq < 3"), done, 1).count() == 3
    assert sorted(r.job_seq for r in sinks.aggregate_once(spark, jobs, done, 2).collect()) == [3]
    assert sinks.aggregate_once(spark, jobs.where("job_seq < 3"), done, 1).count() == 3  # run again


def test_day_counts_are_merged(spark, tmp_path):
    rows = spark.createDataFrame([("c", "u", "a", "2020-01-01", 2)], "cluster string, user string, app string, day string, runs long")
    for k in (1, 2):
        rows.write.parquet(f"{tmp_path}/batch={k}")
    assert [(r.day, r.runs) for r in incremental.merged(spark, str(tmp_path)).collect()] == [("2020-01-01", 4)]


def test_job_details_under_both_schemes(spark):
    jobs = spark.createDataFrame([(1, "ONE"), (2, "TWO"), (3, None), (4, "TWO")], "job_seq long, hadoop_version string")
    rows = [
        (1, "map", "FileSystemCounters", "FILE_BYTES_READ", 5), (1, "reduce", "FileSystemCounters", "FILE_BYTES_READ", 7), (1, "map", "org.apache.hadoop.mapreduce.FileSystemCounter", "FILE_BYTES_READ", 100),
        (2, "total", "org.apache.hadoop.mapreduce.JobCounter", "SLOTS_MILLIS_MAPS", 9), (2, "reduce", "org.apache.hadoop.mapreduce.TaskCounter", "REDUCE_SHUFFLE_BYTES", 3), (2, "total", "FileSystemCounters", "HDFS_BYTES_READ", 50),
        (3, "total", "FileSystemCounters", "HDFS_BYTES_WRITTEN", 11), (3, "map", "FileSystemCounters", "HDFS_BYTES_READ", 70),
    ]
    out = {r.job_seq: r for r in flows.job_details(jobs, spark.createDataFrame(rows, "job_seq long, scope string, group string, name string, value long")).collect()}
    assert (out[1].map_file_bytes_read, out[1].reduce_file_bytes_read, out[2].map_slot_millis, out[2].reduce_shuffle_bytes, out[2].hdfs_bytes_read) == (5, 7, 9, 3, 0)
    assert (out[3].hadoop_version, out[3].hdfs_bytes_written, out[3].hdfs_bytes_read, out[4].map_slot_millis) == ("ONE", 11, 0, 0)


def test_counter_maps(spark):
    rows = [("c", "u", "a", 1, "total", "g", "x", 5), ("c", "u", "a", 1, "map", "g", "x", 2)]
    r = flows.counter_maps(spark.createDataFrame(rows, "cluster string, user string, app string, run_id long, scope string, group string, name string, value long")).first()
    assert (r.total_counters, r.map_counters, r.reduce_counters) == ({"g.x": 5}, {"g.x": 2}, {})


def test_levels_and_limits(spark):
    flow = spark.createDataFrame([("c", 1, 2, 3, 4, [1])], "cluster string, submit long, launch long, finish long, cost long, jobs array<int>")
    assert edge.at_level(flow, "EVERYTHING").columns == flow.columns
    assert edge.at_level(flow, "FLOW_SUMMARY_STATS_ONLY").columns == ["cluster", "cost"]
    assert edge.at_level(flow, "FLOW_SUMMARY_STATS_WITH_JOB_STATS").columns == ["cluster", "cost", "jobs"]
    app = spark.createDataFrame([("c", "u", "a", "q", 9, 8)], "cluster string, user string, app string, queues string, total_jobs long, cost long")
    assert edge.at_level(app, "APP_SUMMARY_STATS_NEW_JOBS_ONLY").columns == ["cluster", "user", "app", "queues"]
    assert edge.at_level(app, "APP_SUMMARY_STATS_ALL_APPS").columns == ["cluster", "user", "app", "queues", "total_jobs"]
    many = spark.range(300)
    assert [edge.limited(many, k).count() for k in ("flow", "flow_stats", "hdfs")] == [1, 100, 300] and edge.limited(many, "flow", 7).count() == 7


def test_integers_stay_whole(spark):
    big = 9007199254740993
    r = spark.range(1).select(
        scalars.corrected_slot_millis(F.lit(big), F.lit(1), F.lit(1)).alias("a"), scalars.xmx_total_mb(F.lit(1000)).alias("b"), scalars.batch_count(F.lit(7), F.lit(3)).alias("c"), scalars.batch_count(F.lit(7), F.lit(0)).alias("d"),
        scalars.batch_count(F.lit(-1), F.lit(3)).alias("e"), scalars.end_of_day(F.lit(86_400_001)).alias("f"), scalars.corrected_slot_millis(F.lit(10), F.lit(None).cast("bigint"), F.lit(2048)).alias("g"),
    ).first()
    assert tuple(r) == (big, 1333, 3, 0, 0, 2 * 86_400_000 - 1, 5)
