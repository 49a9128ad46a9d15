from pyspark.sql import functions as F

from jobtrail.operators import apps, files, flows, progress, storage

JOB = "cluster string, user string, app string, run_id bigint, job_seq bigint, version string, queue string, submit bigint, launch bigint, finish bigint, total_maps bigint, slot_millis bigint, mb_millis bigint"


def job(run, seq, version="v", queue="q", submit=500, n=10, app="a", user="u"):
    return ("c", user, app, run, seq, version, queue, submit, submit + 500, submit + 1500, n, n, n)


def test_flow_rollup_and_wallclock(spark):
    jobs = spark.createDataFrame([job(1, 1, queue="q1", submit=100), job(1, 2, version="w", queue="q2", submit=200), job(1, 3, submit=0)], JOB)
    f = flows.flow_rollup(jobs.where("submit > 0")).first()
    assert (f.job_count, f.total_maps, f.queue, f.version) == (2, 20, "q1", "w")
    w = flows.flow_wallclock(jobs).first()
    assert (w.submit, w.launch, w.finish, w.duration) == (100, 500, 1700, 1200)


def test_series_window_version(spark):
    jobs = spark.createDataFrame([job(r, 10 * r + k, version=f"v{r}") for r in (1, 2, 3) for k in (1, 2)], JOB)
    assert {r.run_id for r in flows.latest_flow(jobs).collect()} == {3}
    assert flows.flow_series(jobs, 2).count() == 4
    assert {r.run_id for r in flows.flow_series(jobs, 5, 1, 2).collect()} == {2}
    assert flows.of_version(jobs, "v1").count() == 2
    assert flows.flow_by_job_id(jobs, 21).count() == 2
    assert flows.flow_rollup_zero_run(jobs.withColumn("run_id", F.lit(0))).count() == 6
    page = flows.flow_stats_page(jobs, 2).orderBy(F.desc("run_id")).collect()
    assert [r.run_id for r in page] == [3, 2] and page[0].next_run_id == 1
    left, _ = flows.remove_job(jobs, jobs.select("job_seq"), jobs.where("job_seq = 11"))
    assert left.count() == 5


def test_daily_and_all_apps(spark):
    jobs = spark.createDataFrame([job(1402704960000, 1, queue="queue_1", n=10), job(1402712160000, 2, queue="queue_2", n=20)], JOB)
    d = apps.app_agg_daily(jobs).first()
    assert (d.bucket, d.total_maps, d.number_runs, d.total_jobs, d.queues) == (1402704000000, 30, 2, 2, "queue_1!queue_2")
    s = apps.all_apps_summary(apps.app_agg_daily(jobs), 1402704000000, 1402800000000).first()
    assert (s.total_jobs, s.queues) == (2, "queue_1!queue_2")


def test_versions_and_new_apps(spark):
    jobs = spark.createDataFrame([job(t, t, version=v, submit=t) for v, t in (("v1", 10), ("v2", 20), ("v3", 30), ("v2.5", 25), ("v1", 11))], JOB)
    v = apps.app_versions(jobs)
    assert apps.latest_version(v).first().version == "v3" and apps.latest_version(v).first().versions == 4
    assert apps.new_app_keys(v, 0, 15).count() == 1 and apps.new_app_keys(v, 20, 35).count() == 0


def test_files(spark):
    f = spark.createDataFrame([(k, k * 1000, k % 2, k) for k in range(1, 11)], "id bigint, mtime bigint, job_id bigint, size bigint")
    got = files.batch_min_max(files.batches(f, 3)).orderBy("batch").collect()
    assert [(r.min_id, r.max_id) for r in got] == [(1, 3), (4, 6), (7, 9), (10, 10)]
    assert files.prune_oversized(f, 9).count() == 5
    assert files.modified_between(f, 1000, 3000).count() == 2
    assert {r.id for r in files.retain_newest(f, 1, "job_id").collect()} == {9, 10}
    rows = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, 5), ("k", 3, "b", None)], "key string, n int, x string, y int")
    assert tuple(files.upsert_collapse(rows, "key", "n", ["x", "y"]).first()) == ("k", "b", 5)
    raw = spark.createDataFrame([(1, 5, 6, None, None), (2, 5, 6, "true", None), (3, 5, 6, "true", "true"), (4, 5, None, None, None)], "job_seq int, conf_mtime bigint, history_mtime bigint, success string, reprocess string")
    assert {r.job_seq for r in files.pending(raw).collect()} == {1, 3} and files.partial(raw).count() == 1


def test_queue_and_events(spark):
    q = spark.createDataFrame([("c", "r", 5, 1, "u", "f"), ("c", "s", 9, 2, "u", "f"), ("c", "r", 7, 3, "w", "f")], "cluster string, status string, at bigint, flow_id bigint, username string, flowname string")
    assert [r.flow_id for r in progress.queue_by_status(q, "c", "r", limit=9).collect()] == [3, 1]
    assert progress.queue_by_status(q, "c", "r", user="u").count() == 1
    assert progress.queue_by_status(progress.moved(q, [1], "s"), "c", "s").count() == 2
    assert [r.flow_id for r in progress.queue_page(q, "c", "r", 1, (5, 1)).collect()] == [1]
    assert {(r.username, r.status) for r in progress.flow_from_queue(q).collect()} == {("u", "r"), ("w", "r")}
    assert progress.events_since(spark.range(10).withColumnRenamed("id", "sequence"), 4).count() == 5


def test_storage(spark):
    u = spark.createDataFrame([("c", "/d/1", 7200, n, 3, 2, 1, f"o{n}") for n in ("a", "b")] + [("c", "/e", 3600, None, 1, 1, 1, "o")], "cluster string, path string, hour bigint, namespace string, space_consumed bigint, access_count bigint, file_count bigint, owner string")
    r = storage.dirs(u, "c", "/d").first()
    assert (r.space_consumed, r.file_count, r.owner) == (6, 2, "ob")
    assert storage.dirs(u, "c", "/x").count() == 0 and storage.dirs(u, "c", "/", 1).count() == 1
    assert storage.path_series(u, "c", "/D/1", 7200, 0).count() == 1
    assert {x.path for x in storage.latest_before(u, 4000).collect()} == {"/e"}
